"""Keyword-stuffed, tag-list and link-list texts, by the shapes of their lines and what the collection's words do in them.

Links are lifted out of a text first; what is left is cut into lines, and lines at sentence ends. Each piece is reduced to
its shape: how many words, capitals, separators, links and repeated words it has, and whether it begins and ends like a
sentence. Some shapes are lists and some are sentences whatever their words (``sure`` ones); the rest are open. Grouped
over the whole collection, the sure shapes say of every word how often it stands in lists and how often in sentences, and
an open piece is a list if its words are mostly list words. No word, language or product is known beforehand: a word that
the collection does not know counts as a sentence's. A text is flagged if lists hold more than half of its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import broadcast_if_small, cut

_LINK = r"<a\s[^>]*>.*?</a>|\[url[^\]]*\].*?\[/url\]|\[[^\]\n]*\]\([^)\s]*\)|(?:https?|hxxps?|ftp)://\S+|www\.\S+"
_SPELLED = r"[\w-]+\ [\[(]?[^\W\d_]{2,5}[\])]?\ [\w-]+(?:\ /\ [\w-]+)+"  # name dot domain / part / part
_LINKS = {False: re.compile(_LINK, re.IGNORECASE | re.DOTALL), True: re.compile(f"{_LINK}|{_SPELLED}", re.IGNORECASE | re.DOTALL)}
_MAYBE_LINK = re.compile(r"://|www\.|\]\(|<a\s|\[url", re.IGNORECASE)
_MARK = "￼"
_QUOTED = re.compile(r"^>[ ]?(.*(?:\n>.*)*)", re.MULTILINE)
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|div|li|ul|ol|h\d|tr|td)(?:\s[^>]*)?>|\r?\n", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_NUMBERING = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*+•])\s+")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
_ENDS = re.compile(r"[.!?…][\"')\]\s" + _MARK + r"]*$")
_WORD = re.compile(r"[^\W_]+")
_SEPARATOR = re.compile(r"[,;|•·/–]| - |\t")
_HASHTAG = re.compile(r"#\w")

ITEM, SENTENCE, REPEATS, SHORT = 6, 4, 12, 8  # most words of a list item; least of a sentence; of a repeated run; of a list without links or tags
LISTED, DOUBTED = 0.35, 0.1  # least mean weight of an open piece; of one that has the shape of a list and a sentence's words
PLAIN, KNOWN_IN = 0.1, 3  # a sentence word's largest weight; least times a word is seen
BROADCAST_WORDS = 300_000

#: Kinds of pieces that are lists whatever their words.
SURE_LISTS = ("link", "label", "tags")


def _bucket(n: int) -> str:
    return "0" if n == 0 else "1" if n == 1 else "few" if n <= 7 else "some" if n <= 20 else "many"


def pieces(text: str | None) -> list[tuple[str, str, list[str]]]:
    """(kind, shape, lower-case words) of a text's pieces; kind is one of SURE_LISTS, sentence, items, repeats or open."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out: list[tuple[str, str, list[str]]] = []

    def lift(m: re.Match) -> str:
        out.append(("link", "link", [w.lower() for w in _WORD.findall(m[0])]))
        return f" {_MARK} "

    spelled = " / " in text
    flat = _LINKS[spelled].sub(lift, text) if spelled or _MAYBE_LINK.search(text) else text
    if ">" in flat:
        flat = _QUOTED.sub(lambda m: m[1].replace("\n>", " "), flat)  # a quoted passage is one line, however wrapped
    for raw in _BREAK.split(flat):
        line = _NUMBERING.sub("", _TAG.sub(" ", raw) if "<" in raw else raw)
        for piece in _SENTENCE_END.split(line):
            own = _WORD.findall(piece)
            n = len(own)
            if not n:
                continue
            words = [w.lower() for w in own]
            links, tags, separators = piece.count(_MARK), len(_HASHTAG.findall(piece)) if "#" in piece else 0, len(_SEPARATOR.findall(piece))
            capitals = sum(w[0].isupper() for w in own)
            distinct = len(set(words))
            ends = _ENDS.search(piece) is not None
            begins = own[0][0].isupper() or own[0][0].isdigit()
            if tags >= 2 and tags * 5 >= n:
                kind = "tags"
            elif links and n <= ITEM * links and not ends:
                kind = "label"
            elif separators >= 3 and n <= ITEM * (separators + 1) and not ends:
                kind = "items"
            elif n >= REPEATS and distinct * (5 if n <= 5 * REPEATS else 6) < n * 2:  # long texts repeat words of themselves
                kind = "repeats"
            elif ends and begins and n >= SENTENCE and capitals * 2 <= n and separators < 3 and distinct * 3 >= n * 2:
                kind = "sentence"
            else:
                kind = "open"
            case = "C" if capitals * 2 > n else "c" if capitals else "-"
            again = "r" if distinct * 3 < n * 2 else "-"
            shape = f"w:{_bucket(n)} case:{case} sep:{_bucket(separators)} links:{_bucket(links)} tags:{_bucket(tags)} again:{again} end:{'.' if ends else '-'}"
            out.append((kind, shape, words))
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))


_KIND = pa.list_(pa.struct([("shape", pa.string()), ("n", pa.int64()), ("again", pa.bool_()), ("w", pa.list_(pa.string()))]))
_SURE_KIND = pa.list_(pa.struct([("shape", pa.string()), ("n", pa.int64())]))
_READ = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64()), ("tagged", pa.bool_()), ("sure", _SURE_KIND), ("rest", _KIND),
     ("word", pa.string()), ("l", pa.int64()), ("p", pa.int64())]
)
_READ_SQL = (
    "row long, doc_id long, words long, tagged boolean, sure array<struct<shape:string,n:bigint>>, "
    "rest array<struct<shape:string,n:bigint,again:boolean,w:array<string>>>, word string, l long, p long"
)


def read_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: a row for each, with its sure lists and, where they can turn its verdict, its other pieces;
    and rows (word, l, p) of how often a word stands in lists and in sentences, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: Counter[str] = Counter()
        plain: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(listed.keys() | plain.keys())
            cols = [pa.nulls(len(words), f.type) for f in _READ][:6]
            cols += [pa.array(words, pa.string()), pa.array([listed[w] for w in words], pa.int64()), pa.array([plain[w] for w in words], pa.int64())]
            listed.clear()
            plain.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_READ)

        for b in batches:
            total, sure, undecided, tagged = [], [], [], []
            for t in b.column(2).to_pylist():
                found = pieces(t)
                lists: Counter[str] = Counter()
                for k, shape, w in found:
                    if k == "sentence":
                        plain.update(w)
                    elif k != "open" and k != "link":  # not the words of addresses
                        listed.update(w)
                    if k in SURE_LISTS:
                        lists[f"{k} {shape}" if k != "link" else k] += len(w)
                n, m = sum(len(w) for *_, w in found), sum(lists.values())
                rest = [{"shape": s, "n": len(w), "again": k != "open", "w": w} for k, s, w in found if k in ("open", "items", "repeats")]
                total.append(n)
                sure.append([{"shape": s, "n": c} for s, c in lists.items()])
                undecided.append(rest if 2 * m <= n < 2 * (m + sum(x["n"] for x in rest)) else [])
                tagged.append(any(k in ("link", "tags") for k, *_ in found))
            none = [pa.nulls(len(total), f.type) for f in _READ][6:]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(tagged, pa.bool_()), pa.array(sure, _SURE_KIND), pa.array(undecided, _KIND), *none],
                schema=_READ,
            )
            if len(listed) + len(plain) > 500_000:
                yield flush()
        yield flush()

    numbered = _texts(docs, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "t")
    return numbered.mapInArrow(run, _READ_SQL)


def word_roles(read: DataFrame) -> DataFrame:
    """(word, listed, plain) of read_texts: how often each word stands in sure lists and in sure sentences of all texts."""
    return read.where("word is not null").groupBy("word").agg(F.sum("l").alias("listed"), F.sum("p").alias("plain"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, listed, top_shapes, stuffed) of every text.

    listed: words in links and lists; top_shapes: the share of them that the text's three largest list shapes hold;
    stuffed: listed words are more than half, and at least SHORT of them unless they are links or tags. Null and empty
    texts have 0 words and are not stuffed; neither are short remarks. Each row is judged by itself, whatever its id, but
    by the word roles of the whole table. Only pieces that can turn a text's verdict are joined with the roles.
    """
    everything = cut(read_texts(docs, doc_id, text))
    read = everything.where("row is not null")
    open_ = read.where(F.size("rest") > 0).select("row", F.posexplode("rest").alias("piece", "p"))
    each = open_.select("row", "piece", "p.shape", "p.n", "p.again", F.explode("p.w").alias("word"))
    roles = word_roles(everything).where(F.col("listed") + F.col("plain") >= KNOWN_IN)
    weights = roles.select("word", (F.col("listed") / (F.col("listed") + F.col("plain"))).alias("weight"))
    met = each.join(broadcast_if_small(cut(weights), BROADCAST_WORDS), "word", "left")
    scored = met.groupBy("row", "piece", "shape", "n", "again").agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"), F.count_if(F.col("weight") < PLAIN).alias("plain")
    )
    mean = F.col("s") / F.col("n")
    is_list = F.when(F.col("again"), (F.col("plain") * 6 < F.col("n")) | (mean >= DOUBTED)).otherwise(mean >= LISTED)
    turned = scored.where(is_list).groupBy("row", "shape").agg(F.sum("n").alias("n")).groupBy("row").agg(F.collect_list(F.struct("shape", "n")).alias("more"))
    lists = F.concat("sure", F.coalesce("more", F.array().cast("array<struct<shape:string,n:bigint>>")))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)
    whole = read.join(turned, "row", "left").select("doc_id", "words", "tagged", F.transform(lists, lambda s: s["n"]).alias("n"))
    sums = whole.select("doc_id", "words", "tagged", add(F.col("n")).alias("listed"), add(F.slice(F.reverse(F.array_sort("n")), 1, 3)).alias("top"))
    return sums.select(
        "doc_id", "words", "listed", F.when(F.col("listed") > 0, F.col("top") / F.col("listed")).alias("top_shapes"),
        ((F.col("listed") * 2 > F.col("words")) & ((F.col("listed") >= SHORT) | F.col("tagged"))).alias("stuffed"),
    )


def corpus_shapes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, shape, texts, words) over all texts: which shapes the collection has; words add up to the texts' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter[tuple[str, str]] = Counter()
        words: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = pieces(t)
                texts.update({(k, s) for k, s, _ in found})
                for k, s, w in found:
                    words[k, s] += len(w)
        keys = list(texts)  # shapes are few
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array([k for k, _ in keys], pa.string()), "shape": pa.array([s for _, s in keys], pa.string()),
             "t": pa.array([texts[k] for k in keys], pa.int64()), "w": pa.array([words[k] for k in keys], pa.int64())}
        )

    each = _texts(docs, doc_id, text).select("t").mapInArrow(run, "kind string, shape string, t long, w long")
    return each.groupBy("kind", "shape").agg(F.sum("t").alias("texts"), F.sum("w").alias("words"))
