"""Operators on small frames, and queries against their SQL at the smallest scale."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cladeworks.functions import treelib
from cladeworks.operators import sequence_ops as so
from cladeworks.operators import tree_ops as to
from cladeworks.session import salted_rank, stream_groups
from cladeworks.sources import tree_files

DATA = "/root/testdata/sf0.001"


def seqs(spark, rows):
    return spark.createDataFrame(rows, "record_id long, family_id string, ord int, seq_id string, residues string")


def test_gap_columns_and_maps(spark):
    long = "A" + "-" * 700 + "C"
    df = seqs(spark, [(1, "f", 1, "a", "-A-C-"), (2, "f", 2, "b", "-AGC-"), (3, "g", 1, "c", "--"), (4, "g", 2, "d", "-"), (5, "h", 1, "e", long), (6, "i", 1, "x", "")])
    gone = {(r.family_id, r.col) for r in so.columns_of_gaps(df).collect()}
    assert gone == {("f", 0), ("f", 4)} | {("h", i) for i in range(1, 701)}
    kept = {r.record_id: r.residues for r in so.drop_gap_columns(df).collect()}
    assert kept == {1: "A-C", 2: "AGC", 3: "--", 4: "-", 5: "AC", 6: ""}
    maps = {r.record_id: r["map"] for r in so.align_map(df.where("record_id <= 2 or record_id = 6")).collect()}
    assert maps == {1: [None, 0, None, 1, None], 2: [None, 0, 1, 2, None], 6: []}


def test_freqs(spark):
    df = seqs(spark, [(1, "f", 1, "a", "AAGG"), (2, "f", 2, "b", "R--C")])
    got = {r.symbol: round(r.freq, 6) for r in so.empirical_freqs(df).collect()}
    assert got == {"A": round(2.5 / 7, 6), "G": round(2.5 / 7, 6), "C": round(1 / 7, 6), "T": round(1 / 7, 6)}


def test_distances_and_joining(spark):
    df = spark.createDataFrame([("t", n, s) for n, s in zip("abcde", ["C", "A", "AA", "A", "CC"], strict=True)], "tree_id string, seq_id string, residues string")
    d = so.pair_distances(df)
    got = {(r.a, r.b): round(r.distance, 5) for r in d.collect()}
    assert len(got) == 10 and got["b", "d"] == 0.0 and got["b", "c"] == 0.82396 and got["a", "b"] == 26.72864
    text = to.nj_trees(d).collect()[0].newick
    assert treelib.parse_newick(text)[0].leaf_set(8) == frozenset("abcde")


def test_paths_of_leaves_do_not_pass_the_driver(spark):
    """Paths are far larger than the links that the optimiser judges them by, so they must not be broadcast."""
    found = entry.queries()["leaf_descendants"](spark, DATA)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_newick_files(spark, tmp_path):
    (tmp_path / "a.nwk").write_text("((A:1,B:2):1,C:3);\n(A:1,B:1);")
    (tmp_path / "b.nwk").write_text("((A:1;")
    got = tree_files.read_newick(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in got) == 8 and sum(r.error is not None for r in got) == 1


def test_fasta_files(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">A first>one a>b\r\nac_g\r\nT*\r\n>B\nACGT\n>\nAC\n>C\nA!C\n")
    got = {r.seq_id: (r.descr, r.residues, r.error) for r in tree_files.read_fasta(spark, str(p), strict=False).collect()}
    assert got["A"] == ("first>one a>b", "AC-GT-", None) and got["B"] == (None, "ACGT", None)
    assert got[""][2] == "no id" and got["C"][2] == "invalid sequence"
    with pytest.raises(Exception, match="FASTA"):
        tree_files.read_fasta(spark, str(p)).collect()
    out = str(tmp_path / "out")
    tree_files.write_fasta(tree_files.read_fasta(spark, str(p), strict=False).where("error is null"), out)
    again = {r.seq_id: r.residues for r in tree_files.read_fasta(spark, out).collect()}
    assert again == {"A": "AC-GT-", "B": "ACGT"}
    with pytest.raises(Exception, match="exists"):
        tree_files.write_fasta(tree_files.read_fasta(spark, out), out)


def test_salted_rank(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").alias("k"), "id")
    got = salted_rank(df, ["k"], ["id"], "rank", salts=7).collect()
    for k in ("hot", None):
        ranks = sorted(r["rank"] for r in got if r.k == k)
        assert ranks == list(range(400 if k else 100))


def test_stream_groups_keeps_groups_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select((F.col("id") % 13).alias("k"), "id")
        import pandas as pd

        got = stream_groups(df, ["k"], ["id"], lambda g: pd.DataFrame({"k": [g.k.iloc[0]], "n": [len(g)], "s": [g.id.sum()]}), "k long, n long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 13 and {(r.k, r.n, r.s) for r in got} == {(k, len(range(k, 1000, 13)), sum(range(k, 1000, 13))) for k in range(13)}


SQL = [n for n in entry.oracle_sql() if not n.startswith("p") or n in ("p1_found", "p1_hierarchy", "p2_found", "p2_loaded", "partitions", "pair_distances")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    import compare

    said, _ = compare.compare(spark, compare.connect(DATA), name, DATA)
    assert said.startswith("ok"), said


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
@pytest.mark.parametrize("name", ["indel_loglik", "model_loglik", "branch_optimise", "model_optimise", "parsimony_search", "indel_alignment", "rf_to_nj"])
def test_runs(spark, name):
    rows = entry.queries()[name](spark, DATA).collect()
    for r in rows:
        if "initial" in r.asDict():
            assert r.final >= r.initial - 1e-9 or name == "model_optimise"


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["tree_id", "newick", "height"] and got.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA.replace("sf0.001", "sf0.01")), reason="test tables are not there")
def test_parsimony_search_goes_on_until_no_gain(spark, tmp_path):
    """One family of scale 0.01, which one round leaves at -674."""
    for name, own in (("sequences", "family_id = 'fam00000004'"), ("nodes", "tree_id = 'fam00000004_t0'")):
        rows = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/{name}.parquet").where(own)
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = [(r.final, r.rounds) for r in entry.queries()["parsimony_search"](spark, str(tmp_path)).collect()]
    assert got == [(-644.0, 3)]
