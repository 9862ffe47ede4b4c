"""FASTA and Newick files as DataFrames and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions import treelib
from cladeworks.functions.alphabet import PROTEIN_WORD, normalised


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, seq_id, descr, residues, error) of the records of FASTA files, residues upper-cased with ``-`` for all gap signs.

    Records are split where a line begins with ``>``, so one large file is read by many tasks. error is null for valid records, else ``no id``,
    ``not ascii`` or ``invalid sequence``; strict raises at the first such record when the rows are read.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    raw = chunks.where(F.trim("value") != "")
    head = F.regexp_replace(F.regexp_extract("value", r"^([^\n]*)", 1), r"\r$", "")
    body = normalised(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    name, rest = F.regexp_extract(head, r"^(\S*)", 1), F.trim(F.regexp_replace(head, r"^\S*", ""))
    error = (
        F.when(name == "", "no id").when(F.col("value").rlike(r"[^\x00-\x7f]"), "not ascii").when(~body.rlike(PROTEIN_WORD), "invalid sequence")
    )
    out = raw.select("file", name.alias("seq_id"), F.when(rest != "", rest).alias("descr"), body.alias("residues"), error.alias("error"))
    if strict:
        said = F.raise_error(F.concat(F.lit("FASTA: "), F.col("error"), F.lit(" in "), F.col("file")))
        out = out.withColumn("residues", F.when(F.col("error").isNotNull(), said).otherwise(F.col("residues")))
    return out


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Write (seq_id, descr, residues) as FASTA; fails if path exists."""
    head = F.concat(F.lit(">"), F.col("seq_id"), F.when(F.col("descr").isNotNull(), F.concat(F.lit(" "), F.col("descr"))).otherwise(""))
    seqs.select(F.concat(head, F.lit("\n"), F.col("residues")).alias("value")).write.mode("errorifexists").text(path)


def parse_newick(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tree, node_id, parent_id, child_ord, is_leaf, label, blen, pre_ord, post_ord, error): nodes of all trees of each
    text; a text that is no tree gives one row with its error."""
    cols = ["key", "tree", "node_id", "parent_id", "child_ord", "is_leaf", "label", "blen", "pre_ord", "post_ord", "error"]
    schema = "key string, tree int, node_id int, parent_id int, child_ord int, is_leaf boolean, label string, blen double, pre_ord int, post_ord int, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"], strict=True):
                try:
                    trees = treelib.parse_newick(t or "")
                except treelib.NewickError as e:
                    rows.append((k, *[None] * 9, str(e)))
                    continue
                for n, tree in enumerate(trees):
                    pre = {x: i for i, x in enumerate(tree.preorder())}
                    post = {x: i for i, x in enumerate(tree.postorder())}
                    for i in range(len(tree)):
                        p = tree.parent[i]
                        order = tree.children[p].index(i) if p >= 0 else None
                        rows.append((k, n, i, p if p >= 0 else None, order, tree.is_leaf(i), tree.label[i], tree.blen[i], pre[i], post[i], None))
            out = pd.DataFrame(rows, columns=cols)
            for c in ("tree", "node_id", "parent_id", "child_ord", "pre_ord", "post_ord"):
                out[c] = out[c].astype("Int32")
            yield out

    return texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all trees of Newick files, a file being read whole."""
    return parse_newick(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key"), F.col("value").alias("text")), "key", "text")


def write_newick(trees: DataFrame, path: str) -> None:
    """Write a column ``newick``, one tree a line; fails if path exists."""
    trees.select(F.col("newick").alias("value")).write.mode("errorifexists").text(path)
