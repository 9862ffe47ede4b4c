"""From files to an aligned family on a tree: what is missing is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import family_costs as fc
from cladeworks.operators import sequence_ops as so
from cladeworks.operators import tree_ops as to
from cladeworks.sources import tree_files
from cladeworks.tables import family_facts

NAME = "family"


def load_family(spark: SparkSession, fasta: str, newick: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) of one family read from a FASTA and, if given, a Newick file, in the tables' columns.

    Without a tree, one is joined from edit distances; of several trees the first is taken, none is an error. Leaves and
    sequences have to have the same names. Unaligned sequences are aligned along the tree. Errors are ValueErrors; a FASTA
    record that is none raises when it is read.
    """
    seqs = tree_files.read_fasta(spark, fasta).select(
        F.lit(NAME).alias("family_id"), F.lit(f"{NAME}_t0").alias("tree_id"), F.monotonically_increasing_id().alias("record_id"), "seq_id", "descr", "residues"
    ).withColumn("ord", F.col("record_id"))
    facts = family_facts(seqs).first()
    if facts is None:
        raise ValueError("no sequences")
    if newick is None:
        text = to.nj_trees(so.pair_distances(seqs)).select("tree_id", "newick")
        nodes = tree_files.parse_newick(text, "tree_id", "newick")
    else:
        nodes = tree_files.read_newick(spark, newick)
    wrong = nodes.where("error is not null").first()
    if wrong is not None:
        raise ValueError(f"Newick: {wrong.error}")
    nodes = nodes.where("tree = 0").select(
        F.lit(f"{NAME}_t0").alias("tree_id"), F.lit(NAME).alias("family_id"), "node_id", "parent_id", "child_ord", "is_leaf", "label", "blen", "pre_ord", "post_ord"
    )
    leaves = nodes.where("is_leaf").select(F.col("label").alias("seq_id"))
    if leaves.limit(1).count() == 0:
        raise ValueError("no trees")
    for one, two, said in ((leaves, seqs.select("seq_id"), "leaves without sequences"), (seqs.select("seq_id"), leaves, "sequences without leaves")):
        lost = sorted(r.seq_id for r in one.join(two, "seq_id", "left_anti").collect())  # one family's names
        if lost:
            raise ValueError(f"{said}: {lost}")
    if facts.aligned:
        return so.drop_gap_columns(seqs), nodes
    made = fc.aligned_rows(fc.whole_families(seqs, nodes)).select("seq_id", F.col("residues").alias("gapped"))
    return seqs.join(made, "seq_id").withColumn("residues", F.col("gapped")).drop("gapped"), nodes
