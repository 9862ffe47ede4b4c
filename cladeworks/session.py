"""Session helpers: lineage cuts, partition counts, size checks before broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "cladeworks") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers find this package where it lies, from whatever folder the driver was started."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut: the session's ``spark.checkpoint.dir``.

    Only on a single machine (a ``local[n]`` master) may it be unset, and one is made; on a cluster it has to name a folder
    that all executors see, so that what is written there survives lost executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = _made.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="cladeworks-"))
    return folder


_made: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return the table: its lineage is the files, its size is known.

    checkpoint() would do as well but for loops: it hands on the size that the optimiser guesses, which for a join is the
    product of both sides; from round to round its number of digits doubles. The table goes when the session's JVM ends, or
    by release(). The shuffles behind df go as soon as the table is written: they would stay on disk until the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cladeworks-{uuid.uuid4().hex}"
    free, had = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        had = spark.conf.get(free, None)
        spark.conf.set(free, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(free) if had is None else spark.conf.set(free, had)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _cuts[out] = path
    return out


_cuts: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut(), now that nothing is going to read them again."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_cuts.pop(df))
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions: the unit in which all salts are counted."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast when it is counted to have at most max_rows rows; else leave the join to Catalyst and AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row within keys, without ever sorting one key's rows in a single task.

    Rows of a key are spread over salts by a hash of the order columns; a rank is the place within (key, salt) plus the
    number of rows in the key's smaller salts, which is read from a table of (key, salt) counts. The order is thus
    deterministic but not that of the columns: use it where any fixed numbering will do. Rows equal in keys and order
    get different ranks in no particular order.
    """
    from pyspark.sql import Window

    salts = salts or shuffle_width(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_salt").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_s")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        ranked.join(offsets, on)
        .withColumn(out, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_salt", "_rank", "_before", "_s", *[f"_k{i}" for i in range(len(keys))])
    )


def stream_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Call fn on each group of keys, groups streaming through sorted partitions.

    Cheaper than applyInPandas for very many small groups, as Arrow batches hold many groups each. A group must be of
    bounded size: callers split or aggregate hot keys first.
    """
    spread = df.repartition(shuffle_width(df.sparkSession), *(partition_by or keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            change = (batch[keys].ne(batch[keys].shift())).any(axis=1).to_numpy()
            change[0] = False
            if held:
                change[0] = tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0])
            cuts = [0, *change.nonzero()[0].tolist(), len(batch)]
            out = []
            for k in range(len(cuts) - 1):
                if k > 0 or (change[0] and held):
                    if held:
                        out.append(fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                    held = []
                if cuts[k + 1] > cuts[k]:
                    held.append(batch.iloc[cuts[k] : cuts[k + 1]])
            out = [x for x in out if x is not None and len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            last = fn(pd.concat(held, ignore_index=True))
            if last is not None and len(last):
                yield last

    return spread.mapInPandas(run, schema)
