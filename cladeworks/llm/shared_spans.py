"""Long stretches that stand verbatim in more than one record, by suffix automata of reference shards.

A suffix automaton of the whole collection fits no executor, and streaming every record past every broadcast shard grows
with the square of the collection. So the shards are made by content: each record is cut into pieces, one for every run of
``span``-letter windows that share their minimizer (the window's SEED-letter stretch of smallest hash). Equal windows have
equal minimizers, so all pieces that could share a window meet in the minimizer's shard, and only there. Pieces are folded
to different texts with the smallest and largest record they stand in, shards with a single record are dropped, and for
each remaining shard an automaton is built and its pieces are streamed past it for their matching statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.llm.records import chunks, classes, records, stretch_hashes
from cladeworks.session import cut, shuffle_width

SPAN, SEED = 40, 20
SHARD = 4096  # different pieces in one automaton; a larger shard is split by windows


class Automaton:
    """Suffix automaton of several texts; each state knows the smallest and largest owner of its occurrences."""

    def __init__(self) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.low: list[float] = [float("inf")]
        self.high: list[float] = [float("-inf")]

    def _state(self, size: int, step: dict[str, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.low.append(float("inf"))
        self.high.append(float("-inf"))
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """The state of p's longest text plus c, cut out of q where q also has longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        twin = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, text: str, low: int, high: int) -> None:
        last = 0
        for c in text:
            known = self.step[last].get(c)
            if known is not None:
                last = self._split(last, c, known)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.step[p][c])
                last = new
            self.low[last] = min(self.low[last], low)
            self.high[last] = max(self.high[last], high)

    def close(self) -> None:
        """Hand owners down the suffix links, longest states first."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            self.low[p] = min(self.low[p], self.low[v])
            self.high[p] = max(self.high[p], self.high[v])

    def shared(self, text: str, span: int) -> list[tuple[int, int]]:
        """Maximal (from, to) of text's letters that lie in a span-letter match owned by more than one record."""
        out: list[tuple[int, int]] = []
        v = length = 0
        for i, c in enumerate(text):
            while v and c not in self.step[v]:
                v = self.link[v]
                length = self.size[v]
            if c in self.step[v]:
                v, length = self.step[v][c], length + 1
            while self.link[v] >= 0 and self.size[self.link[v]] >= span:
                v = self.link[v]
                length = min(length, self.size[v])
            if length >= span and self.low[v] != self.high[v]:
                if out and i + 1 - span <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i + 1 - span, i + 1))
        return out


def cut_pieces(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record place, seed hash, from, to) of the pieces of a chunk, from and to counted from the chunk's first letter."""
    seed = min(SEED, span)
    wide = span - seed + 1
    n = len(codes) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = stretch_hashes(codes, seed)
    rec = np.repeat(np.arange(len(lengths)), lengths)
    # sliding minimum by doubling widths; the place in the low bits lets the leftmost of equal hashes win
    low = np.uint64(len(codes).bit_length())
    least, size = (h >> low << low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    at = (least[:n] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    inside = np.flatnonzero(rec[:n] == rec[span - 1 :])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(inside), bool)
    new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (np.diff(inside) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return rec[inside[first]], h[at[inside[first]]].view(np.int64), inside[first], inside[last] + span


def pieces(reps: DataFrame, span: int) -> DataFrame:
    """(seed, rep, start, n) of all pieces: which shard, and where in which text; the text itself is not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, codes, starts, lengths in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rec, seed, begin, end = cut_pieces(codes, starts, lengths, span)
                yield pa.RecordBatch.from_pydict(
                    {"seed": pa.array(seed, pa.int64()), "rep": pa.array(ids[rec], pa.int64()), "start": pa.array(begin - starts[rec], pa.int64()), "n": pa.array(end - begin, pa.int64())}
                )

    return reps.select("rep", "letters").mapInArrow(run, "seed long, rep long, start long, n long")


def _judge(shards: DataFrame, span: int) -> DataFrame:
    """(seed, text, spans) of the pieces of shards (seed, text, low, high) that hold something shared."""
    sort = shards.repartition(shuffle_width(shards.sparkSession), "seed").sortWithinPartitions("seed")

    def shard(members: list[tuple[int, str, int, int]]) -> list[tuple[int, str, list[dict]]]:
        if len(members) == 1:
            seed, text, low, high = members[0]
            return [(seed, text, [{"f": 0, "t": len(text)}])] if low != high else []
        automaton = Automaton()
        for _, text, low, high in members:
            automaton.add(text, low, high)
        automaton.close()
        found = ((seed, text, automaton.shared(text, span)) for seed, text, _, _ in members)
        return [(seed, text, [{"f": f, "t": t} for f, t in spans]) for seed, text, spans in found if spans]

    kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, int, int]] = []
        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    rows += shard(held)
                    held = []
                held.append(row)
            yield out(rows)
        yield out(shard(held) if held else [])

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], kind)], names=["seed", "text", "spans"]
        )

    return sort.select("seed", "text", "low", "high").mapInArrow(run, "seed long, text string, spans array<struct<f:int,t:int>>")


def _judge_large(shards: DataFrame, span: int) -> DataFrame:
    """The same for shards of any size: windows, not pieces, are brought together, folded as they go."""
    windows = shards.select(
        "seed", "text", "low", "high", F.explode(F.sequence(F.lit(0), F.length("text") - span)).alias("f")
    ).withColumn("w", F.expr(f"substring(text, f + 1, {span})"))
    shared = windows.groupBy("w").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("w")
    held = windows.select("seed", "text", "f", "w").join(shared, "w")
    return held.groupBy("seed", "text").agg(
        F.collect_list(F.struct(F.col("f").alias("f"), (F.col("f") + span).alias("t"))).alias("spans")  # a piece has few windows
    )


def shared_spans(sequences: DataFrame, span: int = SPAN, shard: int = SHARD, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Runs (record_id, span_from, span_to) of letters that lie in a ``span``-letter stretch that stands in another record,
    and all records (record_id, letters) as a text.

    Records count once each (see records.records); those shorter than span have no run. A record whose whole text stands
    in another record is one run. A stretch repeated within one record only is not shared. Equal texts are folded before
    anything is compared and unfolded at the end, so copies cost one text.
    """
    recs = records(sequences, **columns)
    reps, members = classes(recs, span)
    # most shards hold a single text: they are told by their numbers alone, and only what is left fetches its letters
    seeds = pieces(reps, span).groupBy("seed").agg(F.min("rep").alias("l"), F.max("rep").alias("h")).where("l <> h").select("seed")
    placed = pieces(reps, span).join(seeds, "seed")
    cutp = cut(placed.join(reps.select("rep", "letters"), "rep").selectExpr("seed", "rep", "start", "substring(letters, cast(start as int) + 1, cast(n as int)) as text"))
    different = cutp.groupBy("seed", "text").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    counted = cut(different)
    sizes = counted.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select("seed", "n")
    live = counted.join(sizes, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    judged = _judge(live.where(F.col("n") <= shard), span)
    large = live.where(F.col("n") > shard)
    if large.limit(1).count():
        judged = judged.unionByName(_judge_large(large, span))
    spans = (
        cutp.join(judged, ["seed", "text"])
        .select("rep", "start", F.explode("spans").alias("s"))
        .select("rep", (F.col("start") + F.col("s.f")).alias("f"), (F.col("start") + F.col("s.t")).alias("t"))
    )
    copied = reps.where("copies > 1").select("rep", F.lit(0).cast("long").alias("f"), F.length("letters").cast("long").alias("t"))
    by_place = Window.partitionBy("rep").orderBy("f", "t")  # one text's own spans
    before = F.max("t").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        spans.unionByName(copied)
        .withColumn("new", F.when(F.col("f") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rep", "island")
        .agg(F.min("f").alias("span_from"), F.max("t").alias("span_to"))
    )
    own = islands.select(F.col("rep").alias("record_id"), "span_from", "span_to")
    # the other records of a text with copies are shared as a whole: nothing has to be joined by a text that may be hot
    others = members.where("record_id <> rep").select("record_id").join(recs, "record_id")
    whole = others.select("record_id", F.lit(0).cast("long").alias("span_from"), F.length("letters").cast("long").alias("span_to"))
    return own.unionByName(whole), recs


def without_shared(spans: DataFrame, recs: DataFrame) -> DataFrame:
    """(record_id, letters) of every record with its shared spans taken out; the letters left over close up."""
    own = spans.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("span_from", "span_to"))).alias("s"))  # one record's
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("s", lambda x: x["span_to"].cast("long")))
    ends = F.concat(F.transform("s", lambda x: x["span_from"].cast("long")), F.array(F.length("letters").cast("long")))
    kept = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring("letters", x["b"] + 1, x["e"] - x["b"]))
    return recs.join(own, "record_id", "left").select("record_id", F.when(F.col("s").isNull(), F.col("letters")).otherwise(F.array_join(kept, "")).alias("letters"))


def shared_share(spans: DataFrame, recs: DataFrame) -> DataFrame:
    """(record_id, letters, shared) for every record: its number of letters and of shared ones."""
    shared = spans.groupBy("record_id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared"))
    sized = recs.select("record_id", F.length("letters").cast("long").alias("letters"))
    return sized.join(shared, "record_id", "left").select("record_id", "letters", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
