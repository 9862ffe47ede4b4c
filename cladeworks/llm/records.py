"""Records and their letters, copies folded into classes, and numpy helpers shared by the sequence operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import cut

SALTS = 16
CHUNK = 1 << 20  # letters handled at once in numpy; a longer record is handled alone


def records(
    sequences: DataFrame, record_id: str = "record_id", residues: str = "residues", loaded: str | None = "loaded_at"
) -> DataFrame:
    """(record_id, letters): each record once, letters upper-cased without ``-``, ``_``, ``*``.

    Of a record delivered more than once, the row with the greatest loaded_at holds; then the greatest residues. Null
    residues are no letters. Rows without a record_id are no records.
    """
    newest = F.struct(*([F.col(loaded).alias("l")] if loaded in sequences.columns else []), F.col(residues).cast("string").alias("r"))
    return (
        sequences.where(F.col(record_id).isNotNull())
        .select(F.col(record_id).cast("long").alias("record_id"), newest.alias("v"))
        .groupBy("record_id")
        .agg(F.max("v").alias("v"))
        .select("record_id", F.translate(F.upper(F.coalesce("v.r", F.lit(""))), "-_*", "").alias("letters"))
    )


def classes(recs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(rep, letters, copies) of the different texts of at least ``least`` letters, and (record_id, rep) of their records.

    rep is the smallest record_id of a text. Equal texts are folded before the shuffle, so that a text that makes up a
    third of all rows is one row afterwards.
    """
    long = recs.where(F.length("letters") >= least).withColumns({"h": F.xxhash64("letters", F.lit(1)), "h2": F.xxhash64("letters", F.lit(2))})
    reps = cut(long.groupBy("h", "h2", "letters").agg(F.min("record_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # only keys of 128 bits are joined, and copies of one text are dealt to SALTS tasks
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    many = reps.where("copies > 1").select(F.col("h").alias("k"), F.col("h2").alias("k2"), "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    keyed = long.select("record_id", "h", "h2", salt.alias("salt"))
    joined = keyed.join(many, (F.col("h") == F.col("k")) & (F.col("h2") == F.col("k2")) & (F.col("salt") == F.col("s")), "left")
    return reps.select("rep", "letters", "copies"), joined.select("record_id", F.coalesce("rep", "record_id").alias("rep"))


def chunks(ids: list, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch of about CHUNK letters: ids, texts, code points of all letters, starts and lengths."""
    at = 0
    while at < len(ids):
        end, letters = at, 0
        while end < len(ids) and (end == at or letters + len(texts[end]) <= CHUNK):
            letters += len(texts[end])
            end += 1
        part = texts[at:end]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        yield np.asarray(ids[at:end]), part, codes, np.cumsum(lengths) - lengths, lengths
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def stretch_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k letters that start at each place (places near the end run into zeros)."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(k, np.uint64)])
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + padded[i : i + n] + np.uint64(1)
    return mix(h)
