"""Operators on sequences and alignments: gaps, columns, maps, frequencies, distances."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions.alphabet import BY_NAME, GAP
from cladeworks.session import cut, shuffle_width
from cladeworks.tables import family_facts

BLOCK = 256


def gapless(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("residues", F.translate("residues", GAP, ""))


def align_map(seqs: DataFrame) -> DataFrame:
    """Each row's residues as an array: the residue's position without gaps, null at a gap.

    Built from the runs of residues between gaps, so that its cost follows the number of gaps, not the square of the length.
    """
    none = F.array(F.lit(None).cast("int"))
    runs = F.transform(F.split("residues", GAP, -1), F.length)

    def add(a, n):
        own = F.when(n > 0, F.sequence(a["n"], a["n"] + n - 1)).otherwise(F.array().cast("array<int>"))
        before = F.when(a["first"], F.array().cast("array<int>")).otherwise(none)
        return F.struct((a["n"] + n).alias("n"), F.lit(False).alias("first"), F.concat(a["m"], before, own).alias("m"))

    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("first"), F.array().cast("array<int>").alias("m"))
    return seqs.withColumn("map", F.aggregate(runs, start, add, lambda a: a["m"]))


def apply_map(mapped: DataFrame) -> DataFrame:
    """The gapped text of a gapless one (letters) and its map: the inverse of align_map."""
    text = lambda chars: F.array_join(F.transform("map", lambda i: F.coalesce(F.get(chars, i), F.lit(GAP))), "")
    return mapped.withColumn("gapped", F.transform(F.array(F.split("letters", "")), text)[0])  # split once, bound as chars


def columns_of_gaps(seqs: DataFrame) -> DataFrame:
    """(family_id, col) of the columns of aligned families that are gaps in every row.

    Rows are folded block by block: each gives an array of gap flags of BLOCK columns, of which families take the
    position-wise ``and``; so a family of any number of rows is aggregated before it is shuffled.
    """
    aligned = family_facts(seqs).where("aligned and longest > 0").select("family_id")
    blocks = seqs.join(aligned, "family_id").select(
        "family_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("residues") - 1) / BLOCK).cast("int"))).alias("b"), "residues"
    )
    chunk = F.col("residues").substr(F.col("b") * BLOCK + 1, F.lit(BLOCK))
    # a row's set of columns with a letter, as 64-bit words, folds by bit_or
    words = []
    for w in range(BLOCK // 64):
        part = chunk.substr(F.lit(w * 64 + 1), F.lit(64))
        bits = F.conv(F.rpad(F.regexp_replace(F.regexp_replace(part, "[^-]", "1"), "-", "0"), 64, "0"), 2, -10).cast("long")
        words.append(F.bit_or(bits).alias(f"w{w}"))
    folded = blocks.groupBy("family_id", "b").agg(*words, F.max(F.length(chunk)).alias("n"))
    bit = F.expr("cast(shiftrightunsigned(case k div 64 " + " ".join(f"when {w} then w{w}" for w in range(BLOCK // 64)) + " end, 63 - k % 64) & 1 as int)")
    return (
        folded.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .where(bit == 0)
        .select("family_id", (F.col("b") * BLOCK + F.col("k")).cast("int").alias("col"))
    )


def drop_gap_columns(seqs: DataFrame) -> DataFrame:
    """Rows of aligned families without the columns that are gaps in all of the family's rows; other families unchanged.

    What is left of a row are the runs between columns that go, so its cost follows their number.
    """
    gone = columns_of_gaps(seqs).groupBy("family_id").agg(F.sort_array(F.collect_list("col")).alias("gone"))
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda c: c + 1))
    ends = F.concat(F.col("gone"), F.array(F.length("residues")))
    runs = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: r["e"] > r["b"])
    short = F.array_join(F.transform(runs, lambda r: F.substring("residues", r["b"] + 1, r["e"] - r["b"])), "")
    return seqs.join(gone, "family_id", "left").withColumn("residues", F.when(F.col("gone").isNull(), F.col("residues")).otherwise(short)).drop("gone")


def record_by_id(seqs: DataFrame, seq_id: str) -> DataFrame:
    """The rows of that name, the first by record_id of each family; none if there is none."""
    found = seqs.where(F.col("seq_id") == seq_id)
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("family_id").orderBy("record_id"))).where("rn = 1").drop("rn")


def as_fasta(seqs: DataFrame) -> DataFrame:
    """(seq_id, text) of each row as a FASTA record."""
    head = F.concat(F.lit(">"), F.col("seq_id"), F.coalesce(F.concat(F.lit(" "), F.col("descr")), F.lit("")))
    return seqs.select("seq_id", F.concat(head, F.lit("\n"), F.col("residues"), F.lit("\n")).alias("text"))


def symbol_counts(seqs: DataFrame) -> DataFrame:
    """(family_id, ch, n): letters counted per row first, gaps included, so that a row sends a number for each letter it has."""
    own = seqs.where(F.length("residues") > 0).select("family_id", "residues", F.explode(F.array_distinct(F.split("residues", ""))).alias("ch")).where("ch <> ''")
    counted = own.select("family_id", "ch", (F.length("residues") - F.length(F.replace("residues", F.col("ch"), F.lit("")))).alias("n"))
    return counted.groupBy("family_id", "ch").agg(F.sum("n").cast("long").alias("n"))


def alphabet_table(spark) -> DataFrame:
    """(alphabet, ch, symbol, idx, share): each letter with the symbols it stands for; at most some hundred rows."""
    rows = [
        (a.name, c, s, a.symbols.index(s), 1.0 / len(a.members(c)))
        for a in BY_NAME.values()
        for c in a.symbols + a.codes
        for s in a.members(c)
    ]
    return spark.createDataFrame(rows, "alphabet string, ch string, symbol string, idx int, share double")


def empirical_freqs(seqs: DataFrame) -> DataFrame:
    """(family_id, symbol, freq): shares of the symbols of each family's alphabet, gaps left out.

    An ambiguous letter counts evenly for its members; a symbol that does not occur counts 1 before the shares are taken.
    Families of no alphabet have no rows.
    """
    spark = seqs.sparkSession
    lut = F.broadcast(alphabet_table(spark))
    facts = family_facts(seqs).where("alphabet <> 'none'").select("family_id", "alphabet")
    counts = symbol_counts(gapless(seqs)).join(facts, "family_id")
    sums = counts.join(lut, ["alphabet", "ch"]).groupBy("family_id", "symbol").agg(F.sum(F.col("n") * F.col("share")).alias("x"))
    symbols = F.broadcast(alphabet_table(spark).select("alphabet", "symbol").distinct())
    every = facts.join(symbols, "alphabet").select("family_id", "symbol")
    full = every.join(sums, ["family_id", "symbol"], "left").withColumn("x", F.when(F.coalesce("x", F.lit(0.0)) == 0, 1.0).otherwise(F.col("x")))
    return full.withColumn("freq", F.col("x") / F.sum("x").over(Window.partitionBy("family_id"))).select("family_id", "symbol", "freq")


def edit_distance(masks: dict[str, int], n: int, text: str) -> int:
    """Unit-cost edit distance of a text from one of n letters, given as the bit mask of each letter's places: a column of
    the table is one integer of n bits (Myers 1999, Hyyro 2003)."""
    if not n:
        return len(text)
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = every, 0, n
    for c in text:
        same = masks.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (every & ~(across | plus))
        low = plus & across
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up = (up << 1) | 1
        plus = ((low << 1) | ~(down | up)) & every
        minus = up & down
    return score


def pair_distances(rows: DataFrame, cell: int = 16) -> DataFrame:
    """(tree_id, a, b, edits, distance) for all pairs of a tree's leaves (tree_id, seq_id, residues), a before b by name.

    Rows are compared as given, gaps included, by edit distance with the Jukes-Cantor correction, saturated just below
    3/4. The pairs are the result itself. A tree's leaves are dealt to groups of about ``cell``, and all leaves are brought
    to each group, so that the pairs of one large tree are made by many tasks. The built-in levenshtein fills its table cell by cell; here a
    whole column is one integer, which is several times faster in spite of the way through Python.
    """
    salts = rows.groupBy("tree_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).alias("k"))
    sized = cut(rows.select("tree_id", "seq_id", "residues").join(salts, "tree_id"))
    a = sized.select("tree_id", F.col("seq_id").alias("a"), F.col("residues").alias("ra"), F.pmod(F.xxhash64("seq_id"), F.col("k")).alias("s"))
    a = a.repartition(4 * max(rows.sparkSession.sparkContext.defaultParallelism, shuffle_width(rows.sparkSession)), "tree_id", "s")  # few bytes, much work
    b = sized.select("tree_id", F.col("seq_id").alias("b"), F.col("residues").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("s"))
    pairs = a.join(b, ["tree_id", "s"]).where("a < b").select("tree_id", "a", "b", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, masks = None, {}
        for batch in batches:
            edits = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if x != last:
                    last, masks = x, {}
                    for i, c in enumerate(x):
                        masks[c] = masks.get(c, 0) | 1 << i
                edits.append(edit_distance(masks, len(x), y))
            longest = pc.max_element_wise(pc.utf8_length(batch.column(3)), pc.utf8_length(batch.column(4)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(edits, pa.int64()), longest.cast(pa.int64())], names=["tree_id", "a", "b", "edits", "longest"]
            )

    counted = pairs.mapInArrow(run, "tree_id string, a string, b string, edits long, longest long")
    share = F.least(F.when(F.col("longest") > 0, F.col("edits") / F.col("longest")).otherwise(0.0), F.lit(0.75) - F.lit(2.220446049250313e-16))
    return counted.select("tree_id", "a", "b", "edits", (F.lit(-0.75) * F.log(1 - F.lit(4 / 3) * share) + 0.0).alias("distance"))


def row_sums(distances: DataFrame) -> DataFrame:
    """(tree_id, name, others, total): each leaf's sum of distances."""
    both = distances.select("tree_id", F.explode(F.array("a", "b")).alias("name"), "distance")  # one pass over what is dear to make
    return both.groupBy("tree_id", "name").agg(F.count(F.lit(1)).alias("others"), F.sum("distance").alias("total"))


def nj_criterion(distances: DataFrame) -> DataFrame:
    """(tree_id, a, b, distance, q): the neighbour-joining criterion of every pair before the first join."""
    distances = cut(distances)  # dear to make, and read three times
    s = row_sums(distances)
    one = s.select("tree_id", F.col("name").alias("a"), F.col("total").alias("sa"), "others")
    two = s.select("tree_id", F.col("name").alias("b"), F.col("total").alias("sb"))
    n = F.col("others") + 1
    return distances.join(one, ["tree_id", "a"]).join(two, ["tree_id", "b"]).select(
        "tree_id", "a", "b", "distance", ((n - 2) * F.col("distance") - F.col("sa") - F.col("sb")).alias("q")
    )


def nj_first_pair(distances: DataFrame, digits: int = 6) -> DataFrame:
    """(tree_id, a, b): the pair that is joined first; of pairs equal to ``digits`` places the first by name."""
    q = nj_criterion(distances).withColumn("q", F.round("q", digits))
    return q.groupBy("tree_id").agg(F.min(F.struct("q", "a", "b")).alias("v")).select("tree_id", "v.a", "v.b")
