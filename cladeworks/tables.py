"""The project's tables as the operators take them: sequences in force, aligned families, trees as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions.alphabet import DNA_WORD, PROTEIN_WORD, normalised

TREE_SUFFIX = r"_t\d+$"


def sequences_in_force(sequences: DataFrame) -> DataFrame:
    """(record_id, family_id, ord, seq_id, descr, residues): each record once, residues upper-cased with ``-`` as gap.

    The row with the greatest loaded_at holds, then the greatest residues. Null residues become empty. Rows without a
    record_id, family_id or seq_id cannot be joined to anything and are left out.
    """
    newest = F.max(F.struct("loaded_at", "residues", "family_id", "ord", "seq_id", "descr")).alias("v")
    return (
        sequences.where("record_id is not null and family_id is not null and seq_id is not null")
        .groupBy("record_id")
        .agg(newest)
        .select("record_id", "v.family_id", "v.ord", "v.seq_id", "v.descr", F.coalesce(normalised(F.col("v.residues")), F.lit("")).alias("residues"))
    )


def one_per_name(seqs: DataFrame) -> DataFrame:
    """One record for each (family_id, seq_id): that of the smallest record_id."""
    first = F.min(F.struct("record_id", "ord", "residues")).alias("v")
    return seqs.groupBy("family_id", "seq_id").agg(first).select("family_id", "seq_id", "v.record_id", "v.ord", "v.residues")


def nodes_in_force(nodes: DataFrame) -> DataFrame:
    """(tree_id, family_id, node_id, parent_id, child_ord, is_leaf, label, blen): the row of each node with the greatest loaded_at."""
    newest = F.max(F.struct("loaded_at", "parent_id", "blen", "child_ord", "is_leaf", "label")).alias("v")
    return (
        nodes.where("tree_id is not null and node_id is not null")
        .groupBy("tree_id", "node_id")
        .agg(newest)
        .select(
            "tree_id", F.regexp_replace("tree_id", TREE_SUFFIX, "").alias("family_id"), "node_id", "v.parent_id", "v.child_ord",
            "v.is_leaf", F.coalesce("v.label", F.lit("")).alias("label"), "v.blen",
        )
    )


def family_facts(seqs: DataFrame) -> DataFrame:
    """(family_id, records, shortest, longest, aligned, alphabet) of every family."""
    dna = F.bool_and(F.col("residues").rlike(DNA_WORD))
    return seqs.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("records"), F.min(F.length("residues")).alias("shortest"), F.max(F.length("residues")).alias("longest"),
        (F.min(F.length("residues")) == F.max(F.length("residues"))).alias("aligned"),
        F.when(dna, "dna").when(F.bool_and(F.col("residues").rlike(PROTEIN_WORD)), "protein").otherwise("none").alias("alphabet"),
    )


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the 1-based rank ``rn`` within keys."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
