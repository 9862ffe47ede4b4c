"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeworks.plans import general, reference

_MODULES = (general, reference)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["nj_tree"](spark, d)
