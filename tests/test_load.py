"""Families from files, node maps, candidate moves."""

import pytest

from cladeworks.functions import costs, models, optimise, protocols, treelib
from cladeworks.functions.alphabet import DNA
from cladeworks.functions.indel_align import ParsimonyAligner
from cladeworks.operators import family_costs as fc
from cladeworks.operators import sequence_ops as so
from cladeworks.plans.load import load_family
from cladeworks.tables import nodes_in_force


def test_load(spark, tmp_path):
    f, n, m = tmp_path / "a.fasta", tmp_path / "a.nwk", tmp_path / "b.fasta"
    f.write_text(">p\nACCGTT\n>q\nACTT\n>r\nCT\n>s\nGACT\n")
    n.write_text("((p:1,q:1):1,(r:1,s:1):1);(p,q);")
    m.write_text(">p\n-ACGT\n>q\n-AC--\n>r\n-A-G-\n>s\n-GACT\n")
    rows, nodes = load_family(spark, str(f), str(n))
    got = {r.seq_id: r.residues for r in rows.collect()}
    assert len({len(x) for x in got.values()}) == 1 and got["p"].replace("-", "") == "ACCGTT" and nodes.count() == 7
    rows, nodes = load_family(spark, str(m))
    assert {r.seq_id: r.residues for r in rows.collect()}["s"] == "GACT" and nodes.count() == 7
    n.write_text("(p:1,q:1);")
    with pytest.raises(ValueError, match="sequences without leaves: \\['r', 's'\\]"):
        load_family(spark, str(f), str(n))
    n.write_text("((p:1,q:1);")
    with pytest.raises(ValueError, match="Newick"):
        load_family(spark, str(f), str(n))


def test_node_maps():
    t = treelib.parse_newick("((k,l),m);")[0]
    maps = treelib.node_maps(t, {"k": "C-T-", "l": "--TA", "m": "G---"})
    assert maps[t.parent[t.label.index("k")]] == ([0, 1, None], [None, 0, 1])
    assert maps[t.root] == ([0, 1, 2], [0, None, None])


def test_wrong_alphabet():
    t = treelib.parse_newick("(k,l);")[0]
    with pytest.raises(ValueError, match="dna"):
        costs.FitchCost(t, {"k": "EF", "l": "AC"}, DNA)


def test_protocols():
    assert isinstance(ParsimonyAligner(costs.SimpleScoring()), protocols.Aligner)
    assert isinstance(costs.SimpleScoring(), protocols.Scoring) and isinstance(costs.ModelScoring(models.make("JC69"), [0.1]), protocols.Scoring)
    assert isinstance(models.make("GTR"), protocols.SubstitutionModel) and isinstance(models.make("PIP-WAG"), protocols.SubstitutionModel)
    t = treelib.parse_newick("(k:1,l:1);")[0]
    cost = costs.SubstitutionCost(t, {"k": "A", "l": "C"}, models.make("K80"))
    assert isinstance(cost, protocols.TreeSearchCost) and isinstance(cost, protocols.ModelSearchCost)
    assert isinstance(costs.FitchCost(t, {"k": "A", "l": "C"}, DNA), protocols.TreeSearchCost)


def family(spark, t, rows, aligned=True):
    links = [(i, t.parent[i] if t.parent[i] >= 0 else None, t.children[t.parent[i]].index(i) if t.parent[i] >= 0 else None, t.label[i], t.blen[i]) for i in range(len(t))]
    schema = (
        "tree_id string, alphabet string, aligned boolean, rows array<struct<seq_id:string,residues:string>>, "
        "nodes array<struct<node_id:int,parent_id:int,child_ord:int,label:string,blen:double>>"
    )
    return spark.createDataFrame([("t", "dna", aligned, list(rows.items()), links)], schema)


def test_own_aligner(spark):
    class Padded:
        """An aligner of one's own: rows filled up with gaps."""

        def align(self, tree, rows, alphabet):
            width = max(map(len, rows.values()))
            return {k: v.ljust(width, "-") for k, v in rows.items()}

    t = treelib.parse_newick("((k:1,l:1):1,m:1);")[0]
    rows = {"k": "ACGT", "l": "AC", "m": "A"}
    got = {r.seq_id: r.residues for r in fc.aligned_rows(family(spark, t, rows, False), aligner=Padded()).collect()}
    assert got == {"k": "ACGT", "l": "AC--", "m": "A---"}


def test_rows_below_any_node(spark):
    """Columns that are gaps in all rows below a node go, wherever the node lies."""
    nodes = spark.createDataFrame(
        [("f_t0", i, p, 0, leaf, x, 1.0, "2024") for i, p, leaf, x in ((0, None, False, ""), (1, 0, False, ""), (2, 1, True, "k"), (3, 1, True, "l"), (4, 0, True, "m"))],
        "tree_id string, node_id int, parent_id int, child_ord int, is_leaf boolean, label string, blen double, loaded_at string",
    )
    seqs = spark.createDataFrame([(i, "f", i, x, "", r) for i, (x, r) in enumerate((("k", "A--C"), ("l", "G--T"), ("m", "ACG-")))], "record_id long, family_id string, ord int, seq_id string, descr string, residues string")
    wanted = spark.createDataFrame([("f_t0", 1), ("f_t0", 4), ("f_t0", 0)], "tree_id string, node_id int")
    got = {(r.node_id, r.seq_id): r.residues for r in fc.subtree_alignments(seqs, nodes, nodes_in_force(nodes), wanted).collect()}
    assert got == {(1, "k"): "AC", (1, "l"): "GT", (4, "m"): "ACG", (0, "k"): "A--C", (0, "l"): "G--T", (0, "m"): "ACG-"}
    assert so.record_by_id(seqs, "l").collect()[0].residues == "G--T" and so.record_by_id(seqs, "zz").count() == 0
    assert so.as_fasta(seqs.where("seq_id = 'k'")).first().text == ">k \nA--C\n"


def test_best_moves(spark):
    """Every prune place is a task of its own; its best move is that of trying all places."""
    text, rows = "(((k:.1,l:.2):.1,(m:.3,n:.1):.2):.1,(o:.2,p:.1):.1);", dict(k="ACGTA", l="ACGTT", m="AGGTC", n="AGGTA", o="CCGTA", p="CCATA")
    t = treelib.parse_newick(text)[0]
    own = family(spark, t, rows)
    got = fc.best_moves(own).collect()
    fitch = {r.prune: (r.base, r.best) for r in fc.best_moves(own, "parsimony").collect()}
    plain = costs.FitchCost(t, rows, DNA)
    for prune, (base, best) in fitch.items():
        assert base == plain.cost() and best == max(costs.FitchCost(treelib.spr(t, prune, x), rows, DNA).cost() for x in treelib.regraft_places(t, prune))
    cost = costs.SubstitutionCost(t, rows, models.make("JC69"))
    base = cost.cost()
    for r in got:
        moves = [optimise.regraft_cost(cost, base, r.prune, place)[0] for place in treelib.regraft_places(cost.tree, r.prune)]
        assert r.base == pytest.approx(base) and r.best == pytest.approx(max(moves))
    assert {r.prune for r in got} == {i for i in range(len(t)) if i != t.root and t.parent[i] != t.root}
