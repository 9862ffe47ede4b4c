"""Occurrences and record counts of every term, with last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.records import chunks, records
from cladeworks.session import shuffle_width

TERM, RARE, COMMON = 4, 2, 0.25
PIECE = 1 << 20  # letters of a record counted at once


class LastSeen:
    """Per term: occurrences, records, and the record seen last. Counts arrive with records in order, so comparing with
    the last one tells a new record from one that goes on, without a set of records."""

    def __init__(self) -> None:
        self.term: str | None = None
        self.occurrences = self.records = 0
        self.last: int | None = None

    def add(self, first: int, last: int, occurrences: int, records: int) -> None:
        """Records ``first`` to ``last``, in order, hold the term so often; the first may be the one seen last."""
        self.occurrences += occurrences
        self.records += records - (first == self.last)
        self.last = last


def counted(ids: np.ndarray, texts: list[str], term: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(term, first record, last record, occurrences, records) of texts in order of their ids.

    A term is its letters packed in an integer where they fit 63 bits, else the number of its text in the chunk. Sorting
    by term keeps each term's records in order, and a record is new where it is not the one the term was last seen in.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(codes) - term + 1
    if n <= 0:
        return
    rec = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(rec[:n] == rec[term - 1 :])
    if not len(at):
        return
    letters, dense = np.unique(codes, return_inverse=True)
    base = len(letters)
    code = np.zeros(len(at), np.int64)
    for i in range(term):
        if i and base ** (i + 1) >= 1 << 63:  # too many letters to pack: number what is there so far
            code = np.unique(code, return_inverse=True)[1]
            if (int(code.max()) + 1) * base >= 1 << 63:
                raise ValueError("too many different terms in one chunk")
        code = code * base + dense[at + i]
    o = np.argsort(code, kind="stable")
    code, place = code[o], at[o]
    own = rec[place]
    new_term = np.ones(len(code), bool)
    new_term[1:] = code[1:] != code[:-1]
    new_record = new_term.copy()
    new_record[1:] |= own[1:] != own[:-1]
    begin = np.flatnonzero(new_term)
    end = np.append(begin[1:], len(code))
    records = np.add.reduceat(new_record.astype(np.int64), begin)
    whole = "".join(texts)
    for p, f, last, c, r in zip(place[begin].tolist(), ids[own[begin]].tolist(), ids[own[end - 1]].tolist(), (end - begin).tolist(), records.tolist(), strict=True):
        yield whole[p : p + term], f, last, c, r


def term_counts(recs: DataFrame, term: int = TERM) -> DataFrame:
    """(term, occurrences, records) over (record_id, letters) with each record on one row.

    Terms are hash-partitioned, and within a partition a term's counts come ordered by record; a last-seen counter adds
    them up, so no task holds a set of records or more than one term. Before they are shuffled, counts are folded per
    task, for runs of whole records in order; a term that stands in a third of all records thus costs a row a task. A
    record longer than PIECE letters is counted in pieces, each a run of its own, which the counter joins again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["term", "first", "last", "o", "r"])

        def flush() -> pa.RecordBatch:
            rows = [(t, *c) for t, c in held.items()]
            held.clear()
            return out(rows)

        def fold(ids: np.ndarray, texts: list[str]) -> None:
            for t, first, last, o, r in counted(ids, texts, term):
                c = held.get(t)
                if c is None:
                    held[t] = [first, last, o, r]
                else:
                    c[0], c[1], c[2], c[3] = min(c[0], first), max(c[1], last), c[2] + o, c[3] + r

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            short = sorted((i, t) for i, t in zip(ids, texts, strict=True) if len(t) <= PIECE)
            for part, own, *_ in chunks([i for i, _ in short], [t for _, t in short]):
                fold(part, own)
            for i, t in zip(ids, texts, strict=True):
                if len(t) > PIECE:
                    for at in range(0, len(t) - term + 1, PIECE):
                        yield out([x for x in counted(np.array([i]), [t[at : at + PIECE + term - 1]], term)])
            if len(held) > 500_000:
                yield flush()
        yield flush()

    partial = recs.select("record_id", "letters").mapInArrow(run, "term string, first long, last long, o long, r long")
    width = shuffle_width(recs.sparkSession)
    ordered = partial.repartition(width, "term").sortWithinPartitions("term", "first", "last")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LastSeen()
        for b in batches:
            rows = []
            for t, *c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if t != counter.term:
                    if counter.term is not None:
                        rows.append((counter.term, counter.occurrences, counter.records))
                    counter = LastSeen()
                    counter.term = t
                counter.add(*c)
            yield done(rows)
        yield done([(counter.term, counter.occurrences, counter.records)] if counter.term is not None else [])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["term", "occurrences", "records"])

    return ordered.mapInArrow(add_up, "term string, occurrences long, records long")


def term_frequencies(sequences: DataFrame, term: int = TERM, rare: int = RARE, common: float = COMMON, **columns: str) -> DataFrame:
    """(term, occurrences, records, mark): every term of ``term`` letters, mark rare, common or null.

    rare: in at most ``rare`` records; common: in at least the share ``common`` of all record_ids, those without letters
    included. A term that is both (tables of a few records) is rare. Each record_id counts once (see records.records);
    records shorter than a term have none; an empty table gives an empty result.
    """
    recs = records(sequences, **columns)
    name = columns.get("record_id", "record_id")
    total = sequences.select(name).where(F.col(name).isNotNull()).distinct().count()
    return term_counts(recs, term).select(
        "term", "occurrences", "records",
        F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.lit(common * total), "common").alias("mark"),
    )
