"""Evaluation passages in a corpus, by a prefix-filtered set join verified over item-sized windows.

An item is the set of its shingles of ten words. Shingles are ordered by rarity: by the number of texts that their rarest
word stands in. A text that holds a share of an item's shingles holds at least one of its rarest ones, as many as the
share leaves over plus one: the item's necessary prefix (all of them where one shingle is enough). Only the rarest words
of prefix shingles are looked up in the texts. The word's place in the item tells where an item-sized window of the text
begins (positional bound), texts too short for the share are passed over (length bound), and the window is then compared
with the item word for word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import cut

SHINGLE = 10
SEGMENT = 4096  # shingles of an item handled together
BLOCK = 1_000_000  # words of items broadcast at once; more items are looked up block by block
BROADCAST_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def segments(items: DataFrame, n: int = SHINGLE, eval_id: str = "eval_id", text: str = "item_text") -> DataFrame:
    """(item, eval_id, total, begin, words): the items' words in segments of SEGMENT shingles, n - 1 words overlapping.

    item numbers the rows, total is a row's number of shingles; rows with fewer than n words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words_of(t)
                total = len(w) - n + 1
                rows += [(k, i, total, s, w[s : s + SEGMENT + n - 1]) for s in range(0, total, SEGMENT)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "eval_id", "total", "begin", "words"])

    cols = [F.monotonically_increasing_id().alias("k"), F.col(eval_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")]
    return items.where(F.col(eval_id).isNotNull()).select(*cols).mapInArrow(run, "item long, eval_id long, total long, begin long, words array<string>")


def _small_set(df: DataFrame, column: str) -> frozenset[str] | None:
    """The column's values if they are at most BROADCAST_WORDS, else None."""
    got = df.select(column).distinct().limit(BROADCAST_WORDS + 1).collect()
    return frozenset(r[0] for r in got) if len(got) <= BROADCAST_WORDS else None


def word_rarity(docs: DataFrame, wanted: frozenset[str] | None, text: str) -> DataFrame:
    """(word, texts): in how many texts each wanted word stands (all words if wanted is None); counted per task first."""
    seen_by_all = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts = seen_by_all.value, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                found = set(words_of(t))
                counts.update(found if keep is None else found & keep)
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("texts"))


def prefix_places(texts: list[int | None], n: int, keep: int) -> list[tuple[int, int]]:
    """(shingle, place of its rarest word) of the ``keep`` rarest shingles of words that stand in so many texts each.

    Shingles with a word that no text has cannot be found and count as rarest; they are left out.
    """
    ranked = []
    for s in range(len(texts) - n + 1):
        own = texts[s : s + n]
        if None in own:
            ranked.append((-1, s, s))
        else:
            least = min(own)
            ranked.append((least, s, s + own.index(least)))
    ranked.sort()
    return [(s, place) for count, s, place in ranked[:keep] if count >= 0]


def probe(docs: DataFrame, block: list, n: int, share: float, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, item, eval_id, total, start, shared): shingles that each text shares with an item of the block in the
    item-sized window beginning at word start, segment by segment."""
    by_all = docs.sparkSession.sparkContext.broadcast(block)
    schema = "row long, doc_id long, item long, eval_id long, total long, start long, shared long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list[tuple[int, int, int]]] = defaultdict(list)  # word: segment, its place, the shingle's place
        for k, (_, _, total, _, words, counts) in enumerate(by_all.value):
            spare = total - max(1, math.ceil(share * total - 1e-9))
            for s, place in prefix_places(counts, n, spare + 1):
                table[words[place]].append((k, place, s))
        for b in batches:
            rows = []
            for row, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words_of(t)
                if len(w) < n:
                    continue
                met: set[tuple[int, int]] = set()
                for p, x in enumerate(w):
                    for k, place, s in table.get(x, ()):
                        start = p - place
                        if start + s < 0 or start + s + n > len(w) or (k, start) in met:
                            continue
                        item, eval_id, total, begin, words, _ = by_all.value[k]
                        if len(w) - n + 1 < share * total or w[start + s : start + s + n] != words[s : s + n]:
                            continue
                        met.add((k, start))
                        run_, shared = 0, 0
                        for j in range(max(0, -start), min(len(words), len(w) - start)):
                            run_ = run_ + 1 if w[start + j] == words[j] else 0
                            shared += run_ >= n
                        rows.append((row, i, item, eval_id, total, start - begin, shared))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in schema.split(", ")])

    cols = [F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")]
    return docs.where(F.col(doc_id).isNotNull()).select(*cols).mapInArrow(run, schema)


def leaks(
    docs: DataFrame, items: DataFrame, n: int = SHINGLE, share: float = 0.0, doc_id: str = "doc_id", text: str = "text",
    eval_id: str = "eval_id", item_text: str = "item_text",
) -> DataFrame:
    """(doc_id, eval_id, shared_shingles, item_shingles, containment) of all texts and items with n consecutive words in common.

    containment is the share of the item's shingles that one item-sized window of the text holds at the same places, the
    best window counting; pairs below ``share`` have no row. Items and texts of fewer than n words, null and empty ones,
    and rows without an id have no row. Of several rows of one doc_id or eval_id the best pair counts. Items are
    broadcast in blocks of about BLOCK words, cut into segments, so that no broadcast grows with them; every block is
    looked up in all texts. Item words are broadcast as a set up to BROADCAST_WORDS, beyond that all words are counted.
    """
    own = cut(segments(items, n, eval_id, item_text))
    empty = "doc_id long, eval_id long, shared_shingles long, item_shingles long, containment double"
    size = own.agg(F.sum(F.size("words"))).first()[0]
    if not size:
        return docs.sparkSession.createDataFrame([], empty)
    placed = own.select("item", "eval_id", "total", "begin", F.posexplode("words").alias("place", "word"))
    rarity = word_rarity(docs, _small_set(placed, "word"), text)
    keys = ["item", "eval_id", "total", "begin"]
    ordered = F.sort_array(F.collect_list(F.struct("place", "word", "texts")))  # a segment has at most SEGMENT + n words
    counted = cut(placed.join(rarity, "word", "left").groupBy(*keys).agg(ordered.alias("w")))
    blocks = -(-size // BLOCK)
    found = None
    for k in range(blocks):
        part = counted.where(F.pmod(F.xxhash64("item", "begin"), F.lit(blocks)) == k).collect()
        block = [(r.item, r.eval_id, r.total, r.begin, [x.word for x in r.w], [x.texts for x in r.w]) for r in part]
        one = probe(docs, block, n, share, doc_id, text)
        found = one if found is None else found.unionByName(one)
    windows = found.groupBy("row", "doc_id", "item", "eval_id", "total", "start").agg(F.sum("shared").alias("shared"))
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("c"), "shared", "total")).alias("v")
    out = windows.groupBy("doc_id", "eval_id").agg(best)
    return out.select(
        "doc_id", "eval_id", F.col("v.shared").alias("shared_shingles"), F.col("v.total").alias("item_shingles"), F.col("v.c").alias("containment")
    ).where(F.col("containment") >= share)
