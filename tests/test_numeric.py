"""The numeric library against brute force: sums over all ancestral states, all alignments, all topologies."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from cladeworks.functions import costs, models, optimise, treelib
from cladeworks.functions.alphabet import DNA, PROTEIN
from cladeworks.functions.indel_align import NONE, ParsimonyAligner, Prices, align, align_families, align_pair, align_pairs


def parse(text):
    return treelib.parse_newick(text)[0]


def random_tree(rng, n):
    parts = [f"{chr(97 + i)}:{rng.uniform(0.02, 0.9):.3f}" for i in range(n)]
    while len(parts) > 1:
        a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
        parts.append(f"({a},{b}):{rng.uniform(0.02, 0.9):.3f}")
    return parse(parts[0] + ";")


def series(q, t):
    """exp(qt) by its power series over halved steps, apart from the library's way."""
    a, out = q * t / 1024, np.eye(len(q))
    term = np.eye(len(q))
    for k in range(1, 25):
        term = term @ a / k
        out = out + term
    return np.linalg.matrix_power(out, 1024)


def brute_likelihood(tree, rows, alphabet, q, pi):
    """Sum over the states of all nodes, the root's own branch included; gaps fit every symbol."""
    p = [series(q, b) for b in tree.blen]
    inner = [i for i in range(len(tree)) if tree.children[i]]
    total = 0.0
    for column in zip(*(rows[tree.label[i]] for i in tree.leaves()), strict=True):
        if set(column) == {"-"}:
            continue
        seen = {i: alphabet.indicator(c) for i, c in zip(tree.leaves(), column, strict=True)}
        likely = 0.0
        for states in itertools.product(range(alphabet.n), repeat=len(inner)):
            at = dict(zip(inner, states, strict=True))
            x = 1.0
            for i in range(len(tree)):
                if i == tree.root:
                    x *= pi @ p[i][:, at[i]] if i in at else pi @ p[i] @ seen[i]
                else:
                    above = p[i][at[tree.parent[i]]]
                    x *= above[at[i]] if i in at else above @ seen[i]
            likely += x
        total += math.log(likely)
    return total


def rates(exchange, pi):
    q = np.array(exchange, float) * pi
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi @ np.diag(q))


@pytest.mark.parametrize("seed", range(4))
def test_substitution_likelihood(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, 4)
    rows = {x: "".join(rng.choice("TCAGRN-") for _ in range(6)) for x in "abcd"}
    pi, r = np.array([0.1, 0.3, 0.4, 0.2]), [1.3, 0.7, 2.0, 1.1, 0.4, 1.9]
    tc, ta, tg, ca, cg, ag = r
    q = rates([[0, tc, ta, tg], [tc, 0, ca, cg], [ta, ca, 0, ag], [tg, cg, ag, 0]], pi)
    assert costs.SubstitutionCost(tree, rows, models.make("GTR", pi, r)).cost() == pytest.approx(brute_likelihood(tree, rows, DNA, q, pi), abs=1e-8)
    k = rates([[0, 5, 1, 1], [5, 0, 1, 1], [1, 1, 0, 5], [1, 1, 5, 0]], pi)
    assert costs.SubstitutionCost(tree, rows, models.make("HKY", pi, [5])).cost() == pytest.approx(brute_likelihood(tree, rows, DNA, k, pi), abs=1e-8)


@pytest.mark.parametrize("name", ["WAG", "HIVB", "BLOSUM"])
def test_protein_likelihood(name):
    tree = parse("((a:0.2,b:0.7):0.1,c:0.4):0;")
    rows = {"a": "ARNW-X", "b": "ARDWBL", "c": "GKN-ZJ"}
    m = models.make(name)
    assert m.freqs.sum() == pytest.approx(1, abs=1e-3) and np.allclose(m.freqs[:, None] * m.q, (m.freqs[:, None] * m.q).T)
    assert costs.SubstitutionCost(tree, rows, m).cost() == pytest.approx(brute_likelihood(tree, rows, PROTEIN, m.q, m.freqs), abs=1e-8)


def brute_indels(tree, rows, q, pi, lam, mu):
    """The published Poisson indel process, summed over the node at which each column was inserted."""
    n = len(pi)
    big = np.zeros((n + 1, n + 1))
    big[:n, :n], big[:n, n] = q - mu * np.eye(n), mu
    p = [series(big, b) for b in tree.blen]
    tau = sum(b for i, b in enumerate(tree.blen) if i != tree.root)
    whole = tau + 1 / mu

    def below(i, seen):
        if not tree.children[i]:
            return seen[i]
        return np.prod([p[k] @ below(k, seen) for k in tree.children[i]], axis=0)

    def column(letters):
        seen = {}
        for i, c in zip(tree.leaves(), letters, strict=True):
            seen[i] = np.append(np.zeros(n), 1.0) if c == "-" else np.append(DNA.indicator(c) / DNA.indicator(c).sum(), 0.0)
        there = {i for i, c in zip(tree.leaves(), letters, strict=True) if c != "-"}
        out = 0.0
        for v in range(len(tree)):
            b = tree.blen[v]
            prior = (1 / mu if v == tree.root else b) / whole
            lives = 1.0 if v == tree.root or b == 0 else (1 - math.exp(-mu * b)) / (mu * b)
            own = np.append(pi, 0.0) @ below(v, seen)
            if not there:
                out += prior * (1 - lives + lives * own)
            elif there <= set(tree.preorder(v)):
                out += prior * lives * own
        return out

    columns = [c for c in zip(*(rows[tree.label[i]] for i in tree.leaves()), strict=True) if set(c) != {"-"}]
    nu, m = lam * whole, len(columns)
    return sum(math.log(column(c)) for c in columns) + m * math.log(nu) + nu * (column("-" * len(tree.leaves())) - 1) - costs.stirling(m)


@pytest.mark.parametrize("seed", range(4))
def test_indel_likelihood(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, 5)
    tree.blen[tree.root] = 0.0
    rows = {x: "".join(rng.choice("TCAGR---") for _ in range(8)) for x in "abcde"}
    pi, lam, mu = np.array([0.1, 0.3, 0.4, 0.2]), 0.8, 0.35
    q = rates([[0, 2, 1, 1], [2, 0, 1, 1], [1, 1, 0, 2], [1, 1, 2, 0]], pi)
    got = costs.IndelCost(tree, rows, models.make("PIP-HKY", pi, [lam, mu, 2.0])).cost()
    assert got == pytest.approx(brute_indels(tree, rows, q, pi, lam, mu), abs=1e-7)


def test_stirling():
    for n in (1, 2, 10, 300):
        assert costs.stirling(n) == pytest.approx(math.lgamma(n + 1), abs=3e-3 / n**3)


@pytest.mark.parametrize("seed", range(5))
def test_fitch(seed):
    """Least number of changes over all assignments of symbols to inner nodes and to ambiguous leaves, gaps being a symbol."""
    rng = random.Random(seed)
    tree = random_tree(rng, 5)
    rows = {x: "".join(rng.choice("TCAGY-") for _ in range(7)) for x in "abcde"}
    want = 0
    for letters in zip(*(rows[tree.label[i]] for i in tree.leaves()), strict=True):
        if set(letters) == {"-"}:
            continue
        options = {i: [c] if c == "-" else list(DNA.members(c)) for i, c in zip(tree.leaves(), letters, strict=True)}
        free = [options.get(i, "TCAG-") for i in range(len(tree))]
        want += min(sum(s[i] != s[tree.parent[i]] for i in range(len(tree)) if i != tree.root) for s in itertools.product(*free))
    assert costs.FitchCost(tree, rows, DNA).cost() == -want


@pytest.mark.parametrize("seed", range(5))
def test_dollo(seed):
    """With one letter only, the cost is a loss for every largest subtree without it below the letter's first ancestor."""
    rng = random.Random(seed)
    tree = random_tree(rng, 6)
    rows = {x: "".join(rng.choice("A-") for _ in range(9)) for x in "abcdef"}
    want = 0.0
    for k in range(9):
        there = {i for i in tree.leaves() if rows[tree.label[i]][k] == "A"}
        if there:
            top = [i for i in tree.preorder() if there <= set(tree.preorder(i))][-1]
            bare = [i for i in tree.preorder(top) if not there & set(tree.preorder(i))]
            want += 2.5 * sum(tree.parent[i] not in bare for i in bare)
    assert costs.DolloCost(tree, rows, DNA, costs.SimpleScoring(1, 2.5, 1)).cost() == -want
    scored = costs.DolloCost(tree, rows, DNA, costs.ModelScoring(models.make("JC69"), [0.1, 0.4], zero_diagonal=True)).cost()
    assert scored <= 0 and (scored == 0) == (want == 0)


def brute_alignment(x, y, mismatch, opened, more):
    """Least cost of aligning two rows of plain letters: a run of gaps opens once on each side it lies on."""
    best = {}

    def go(i, j, last):
        if (i, j, last) not in best:
            if i == len(x) and j == len(y):
                return 0.0
            found = []
            if i < len(x) and j < len(y):
                found.append((x[i] != y[j]) * mismatch + go(i + 1, j + 1, "m"))
            if i < len(x):
                found.append((more if last == "x" else opened) + go(i + 1, j, "x"))
            if j < len(y):
                found.append((more if last == "y" else opened) + go(i, j + 1, "y"))
            best[i, j, last] = min(found)
        return best[i, j, last]

    return go(0, 0, "m")


def plain(s):
    return [(DNA.mask(c), NONE) for c in s]


@pytest.mark.parametrize("seed", range(30))
def test_pair_alignment(seed):
    rng = random.Random(seed)
    x, y = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(9))) for _ in range(2))
    opened, more = rng.choice([(2, 0.5), (1, 1), (2.5, 0.5), (0.5, 0.25)])
    for rule in ("first", "last"):
        sites, mx, my, score = align_pair(plain(x), plain(y), Prices(costs.SimpleScoring(1, opened, more), 1, 1, 4), rule)
        assert score == pytest.approx(brute_alignment(x, y, 1, opened, more))
        assert [i for i in mx if i is not None] == list(range(len(x))) and [j for j in my if j is not None] == list(range(len(y)))
        assert len(sites) == len(mx) == len(my) and not any(a is None and b is None for a, b in zip(mx, my, strict=True))


def test_tie_breaks():
    got = {r: align_pair(plain("AACT"), plain("AC"), Prices(costs.SimpleScoring(1, 2, 0.5), 1, 1, 4), r) for r in ("first", "last")}
    assert got["first"][1:] == ([0, 1, 2, 3], [0, None, None, 1], 3.5) and got["last"][1:] == ([0, 1, 2, 3], [0, 1, None, None], 3.5)


def test_progressive_alignment():
    """A gap that both children of a node have was one event: the third row does not pay for it again."""
    sc = costs.SimpleScoring(1, 2, 0.5)
    t = parse("((a:1,b:1):1,(c:1,d:1):1);")
    rows, scores = align(t, {"a": "ACGTT", "b": "ACT", "c": "ACT", "d": "ACT"}, DNA, sc)
    at = {x: i for i, x in enumerate(t.label) if x}
    assert scores[t.parent[at["a"]]] == 2.5 and scores[t.parent[at["c"]]] == 0 and scores[t.root] == 0
    assert rows["a"] == "ACGTT" and rows["b"] == rows["c"] == rows["d"] and rows["b"].count("-") == 2
    rng = random.Random(2)
    for _ in range(20):
        tree = random_tree(rng, 6)
        texts = {x: "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 12))) for x in "abcdef"}
        aligner = ParsimonyAligner(costs.ModelScoring(models.make("K80"), [0.1, 0.5], zero_diagonal=True) if rng.random() < 0.5 else sc)
        out, each = aligner.align_with_scores(tree, texts, DNA)
        assert {k: v.replace("-", "") for k, v in out.items()} == texts and len({len(v) for v in out.values()}) == 1
        assert all(s >= 0 for s in each.values()) and not any(set(c) == {"-"} for c in zip(*out.values(), strict=True))
        assert aligner.align(tree, texts, DNA) == out


def test_newick():
    t = parse("((x:1.0,y:2.50):0.5,(z:3,w_1:1e-3)in:4.25):0.0;")
    assert t.newick() == "(((x:1,y:2.5):0.5,(z:3,w_1:0.001)in:4.25):0);"
    assert parse(t.newick()).newick() == t.newick()
    assert len(treelib.parse_newick("(p:.25,q:2.5E-7);(r:-1.5,s:+07.5);")) == 2
    assert parse("(r:-1.5,s:+07.5);").blen[:2] == [-1.5, 7.5]
    three = parse("(k:4,l:1,m:2);")
    assert len(three) == 5 and three.height == 7 and three.children[three.root] == [3, 2]
    for bad in (";", "((k,l);", "(k,l));", "(,k);", "(k,l)[note];", "(k,l,m,n);", "(k,l)", "(k:,l);", "k l;"):
        with pytest.raises(treelib.NewickError):
            treelib.parse_newick(bad)


@pytest.mark.parametrize("seed", range(6))
def test_partitions_and_robinson_foulds(seed):
    rng = random.Random(seed)
    one, two = random_tree(rng, 7), random_tree(rng, rng.choice([5, 7]))

    def splits(t, common):
        every = t.leaf_set(t.root)
        found = {s for i in range(len(t)) if i != t.root for s in (t.leaf_set(i), every - t.leaf_set(i))}
        return [s & common for s in found if s & common]

    common = one.leaf_set(one.root) & two.leaf_set(two.root)
    lacking = [s for s in splits(one, common) if s not in set(splits(two, common))]
    assert treelib.robinson_foulds(one, two) == len(lacking) and treelib.robinson_foulds(one, one) == 0
    assert len(treelib.partitions(one)) == 2 * (2 * 7 - 3)


@pytest.mark.parametrize("seed", range(6))
def test_neighbour_joining_recovers_trees(seed):
    """From the distances of a tree, joining gives back its splits and the lengths of its branches."""
    rng = random.Random(seed)
    tree = random_tree(rng, 9)
    leaves = tree.leaves()

    def way(i):
        out = {}
        while i != tree.root:
            out[i] = tree.blen[i]
            i = tree.parent[i]
        return out

    d = np.array([[sum(b for k, b in {**way(a), **way(b_)}.items() if (k in way(a)) != (k in way(b_))) for b_ in leaves] for a in leaves])
    got = treelib.neighbour_joining(d, [tree.label[i] for i in leaves])
    assert treelib.robinson_foulds(got, tree) == 0 and treelib.robinson_foulds(tree, got) == 0
    lengths = {got.label[i]: got.blen[i] for i in got.leaves()}
    roots = {tree.label[i] for i in tree.children[tree.root]} | {got.label[i] for i in got.children[got.root]}
    assert all(lengths[tree.label[i]] == pytest.approx(tree.blen[i]) for i in leaves if tree.label[i] not in roots)
    assert treelib.corrected_distance(1, 2) == pytest.approx(0.8239592165010822, abs=1e-12)
    assert treelib.corrected_distance(1, 1) == pytest.approx(26.728641210756745, abs=1e-9)
    assert treelib.levenshtein("sunday", "saturday") == 3 and treelib.levenshtein("", "ab") == 2


def test_spr():
    t = parse("((p:1,q:2.5):4,(r:1.5,s:1):0.5);")
    at = {x: i for i, x in enumerate(t.label) if x}
    moved = treelib.spr(t, at["p"], at["r"])
    assert moved.blen[at["q"]] == 6.5 and moved.blen[at["r"]] == 0.75 and moved.height == t.height
    assert moved.leaf_set(moved.parent[at["p"]]) == {"p", "r"}
    for a, b in ((at["p"], at["p"]), (t.root, at["p"]), (t.parent[at["p"]], at["r"]), (at["p"], t.root), (at["p"], at["q"]), (t.parent[at["p"]], at["p"])):
        with pytest.raises(ValueError):
            treelib.spr(t, a, b)


def test_models():
    for m in (models.make("HKY", [0.1, 0.3, 0.4, 0.2], [5]), models.make("GTR", [0.1, 0.3, 0.4, 0.2], [1, 2, 3, 4, 5]), models.make("WAG"), models.make("hivb"), models.make("BLOSUM")):
        assert m.freqs @ np.diag(m.q) == pytest.approx(-1)
        assert np.allclose(m.p(0.7), series(m.q, 0.7)) and np.allclose(m.p(0.3) @ m.p(0.4), m.p(0.7))
    zero = models.make("HKY", [0.0, 0.3, 0.5, 0.2], [2.0])
    assert np.allclose(zero.p(0.7), series(zero.q, 0.7))
    assert models.make("K80", [0.1, 0.3, 0.4, 0.2]).freqs.tolist() == [0.25] * 4 and models.make("GTR", None, [1, 2]).params == [1, 2, 1, 1, 1]
    assert models.make("TN93", None, [3]).params == [3, 1, 1] and models.make("WAG", [0.5, 0.5]).n == 20
    with pytest.raises(ValueError):
        models.make("none")


def test_scoring_table():
    sc = costs.ModelScoring(models.make("WAG"), [0.7, 0.1, 0.5, 0.3], digits=0)
    assert sc.at(0.0) == 0 and sc.at(9) == 3
    assert costs.ModelScoring(models.make("JC69"), [0.5, 0.25]).at(0.375) == 0  # of two equally near the smaller
    assert [sc.avg(t) for t in (0.1, 0.3, 0.5, 0.7)] == pytest.approx([5.7675, 4.7475, 4.2825, 4.0075])  # published for this model


def simulated(rng, tree, n, model):
    """Rows grown along a tree under a model."""
    rows = {}
    for _ in range(n):
        at = {tree.root: rng.choices(range(4), model.freqs)[0]}
        for i in tree.preorder():
            for k in tree.children[i]:
                at[k] = rng.choices(range(4), model.p(tree.blen[k])[at[i]])[0]
        for i in tree.leaves():
            rows[tree.label[i]] = rows.get(tree.label[i], "") + DNA.symbols[at[i]]
    return rows


def test_two_leaves_have_a_closed_optimum():
    rows = {"a": "ACGTACGTACGTACGTACGT", "b": "ACGTACGAACGTCCGTACGT"}
    cost = costs.SubstitutionCost(parse("(a:0.3,b:0.1);"), rows, models.make("JC69"))
    got = optimise.optimise_branches(cost)
    assert sum(cost.tree.blen) == pytest.approx(treelib.corrected_distance(2, 20), abs=2e-3)
    d = treelib.corrected_distance(2, 20)
    same, other = 0.25 + 0.75 * math.exp(-4 * d / 3), 0.25 - 0.25 * math.exp(-4 * d / 3)
    assert got.final == pytest.approx(18 * math.log(same / 4) + 2 * math.log(other / 4), abs=1e-4) and got.final >= got.initial


def test_long_pairs_are_aligned_by_antidiagonals():
    """Cells one by one would take some 8 s."""
    rng = random.Random(7)
    text = "".join(rng.choice("TCAG") for _ in range(1500))
    shorter = text[:700] + text[710:]
    began = time.process_time()
    out, scores = align(parse("(a:1,b:1);"), {"a": text, "b": shorter}, DNA, costs.SimpleScoring(1, 2.5, 0.5))
    assert time.process_time() - began < 4
    assert out["a"] == text and out["b"].replace("-", "") == shorter and sum(scores.values()) == 2.5 + 9 * 0.5


@pytest.mark.parametrize("model", ["JC69", "HKY"])
def test_a_branch_is_searched_without_walking_to_the_root(model, monkeypatch):
    """The length that a search over the whole tree's cost finds, while partials move along branches a few times a branch."""
    rng = random.Random(2)
    text = "a0:.1"
    for k in range(1, 40):
        text = f"({text},a{k}:.2):.1"
    tree = parse(text + ";")
    rows = simulated(rng, tree, 40, models.make("JC69"))
    cost = costs.SubstitutionCost(tree, rows, models.make(model))
    for i in rng.sample([i for i in range(len(tree)) if i != tree.root], 5):
        def at(b, i=i):
            cost.set_blen(i, b)
            return -cost.cost()

        own = tree.blen[i]
        want = optimise.brent(at, *optimise.branch_range(own))
        cost.set_blen(i, own)
        assert optimise.best_branch(cost, i) == pytest.approx((want[0], -want[1]), rel=1e-4, abs=1e-6)
    moved = []
    along = costs.SubstitutionCost._along
    monkeypatch.setattr(costs.SubstitutionCost, "_along", lambda *a, **k: moved.append(1) or along(*a, **k))
    got = optimise.optimise_branches(cost)
    assert len(moved) <= got.rounds * len(tree) * 2 * 40 and got.final == pytest.approx(costs.SubstitutionCost(cost.tree, rows, cost.model).cost(), abs=1e-8)


@pytest.mark.parametrize("name, params", [("K80", [2.0]), ("HKY", [1.0]), ("PIP-K80", [0.5, 0.5, 2.0])])
def test_optima_are_stationary(name, params):
    rng = random.Random(1)
    tree = random_tree(rng, 5)
    rows = simulated(rng, tree, 300, models.make("K80", None, [6.0]))
    make = costs.IndelCost if name.startswith("PIP") else costs.SubstitutionCost
    cost = make(tree, rows, models.make(name, None, params))
    got = optimise.optimise_model(cost, "fixed" if name == "K80" else "empirical", list(rows.values()))
    for k, own in enumerate(cost.params):
        for x in (own * 0.97, own * 1.03):
            cost.set_param(k, x)
            assert cost.cost() <= got.final + 2e-3
        cost.set_param(k, own)
    assert cost.params[-1] == pytest.approx(6.0, rel=0.5)


def test_topology_searches_find_the_best_tree():
    rng = random.Random(4)
    true = parse("(((a:.1,b:.1):.15,(c:.1,d:.1):.15):.1,(e:.1,f:.1):.2);")
    rows = simulated(rng, true, 400, models.make("JC69"))
    finals = []
    for start in ("(((a:.1,e:.1):.1,(c:.1,f:.1):.1):.1,(b:.1,d:.1):.1);", "(((((a:.1,d:.1):.1,c:.1):.1,f:.1):.1,b:.1):.1,e:.1);"):
        cost = costs.SubstitutionCost(parse(start), rows, models.make("JC69"))
        got = optimise.optimise_topology(cost)
        assert treelib.robinson_foulds(cost.tree, true) == 0 and got.final > got.initial
        finals.append(got.final)
    assert finals[0] == pytest.approx(finals[1], abs=1e-2)
    best = costs.SubstitutionCost(true.copy(), rows, models.make("JC69"))
    assert optimise.optimise_branches(best).final == pytest.approx(finals[0], abs=1e-2)
    fitch = costs.FitchCost(parse("(((a,e),(c,f)),(b,d));"), rows, DNA)
    assert optimise.optimise_topology(fitch).final == costs.FitchCost(true, rows, DNA).cost()
    both = optimise.infer(costs.SubstitutionCost(parse("(((a:.1,e:.1):.1,(c:.1,f:.1):.1):.1,(b:.1,d:.1):.1);"), rows, models.make("K80")), "empirical", list(rows.values()))
    assert both.final >= finals[0] - 1e-2 and treelib.robinson_foulds(both.cost.tree, true) == 0


@pytest.mark.parametrize("seed", range(6))
def test_all_regrafts_at_once(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, 9)
    rows = {tree.label[i]: "".join(rng.choice("TCAGY-") for _ in range(30)) for i in tree.leaves()}
    cost = costs.FitchCost(tree, rows, DNA)
    for prune in tree.preorder():
        if prune != tree.root and tree.parent[prune] != tree.root:
            places = treelib.regraft_places(tree, prune)
            assert [v for v, _ in cost.regraft_costs(prune, places)] == [costs.FitchCost(treelib.spr(tree, prune, p), rows, DNA).cost() for p in places]


@pytest.mark.parametrize("seed", range(4))
def test_all_likelihood_regrafts_at_once(seed):
    """The same costs and branch lengths as trees that are made and evaluated one by one."""
    rng = random.Random(seed)
    tree = random_tree(rng, 8)
    rows = {tree.label[i]: "".join(rng.choice("TCAGY-") for _ in range(30)) for i in tree.leaves()}
    cost = costs.SubstitutionCost(tree, rows, models.make("HKY", [0.1, 0.3, 0.4, 0.2], [3.0]))
    own = cost.cost()
    for prune in tree.preorder():
        if prune != tree.root and tree.parent[prune] != tree.root:
            places = treelib.regraft_places(tree, prune)
            plain = [costs.SubstitutionCost(treelib.spr(tree, prune, p), rows, cost.model).cost() for p in places]
            assert [v for v, _ in cost.regraft_costs(prune, places)] == pytest.approx(plain, abs=1e-8)
            for p, (value, b) in zip(places, cost.regraft_costs(prune, places, own), strict=True):
                want, moved = optimise.regraft_cost(cost, own, prune, p)
                assert value == pytest.approx(want, abs=1e-6)
                assert b is None or moved.blen[p] == pytest.approx(b, rel=1e-3)


def test_minima_side_by_side():
    """Many functions searched at once take the steps that each takes alone, and regraft places are searched so."""
    rng = np.random.default_rng(3)
    low, at, power = rng.uniform(0, 1, 40), rng.uniform(0, 3, 40), rng.uniform(1, 4, 40)
    high = low + rng.uniform(0.5, 3, 40)
    fs = [lambda x, k=k: math.inf if k == 7 else abs(x - at[k]) ** power[k] + 0.1 * math.sin(20 * x) * (k % 3 == 0) for k in range(40)]
    x, fx = optimise.brent_many(lambda x, which: np.array([fs[k](float(v)) for v, k in zip(x, which, strict=True)]), low, high)
    alone = [optimise.brent(f, a, b) for f, a, b in zip(fs, low.tolist(), high.tolist(), strict=True)]
    assert x.tolist() == pytest.approx([a for a, _ in alone]) and fx.tolist() == pytest.approx([b for _, b in alone])


def test_regraft_places_are_searched_together(monkeypatch):
    rng = random.Random(5)
    tree = random_tree(rng, 12)
    rows = {tree.label[i]: "".join(rng.choice("TCAG") for _ in range(20)) for i in tree.leaves()}
    monkeypatch.setattr(optimise, "brent", None)
    cost = costs.SubstitutionCost(tree, rows, models.make("JC69"))
    prune = next(i for i in tree.preorder() if i != tree.root and tree.parent[i] != tree.root)
    places = treelib.regraft_places(tree, prune)
    got = cost.regraft_costs(prune, places, 0.0)  # no place beats 0: every half branch is searched
    for p, (value, b) in zip(places, got, strict=True):
        moved = treelib.spr(tree, prune, p)
        moved.blen[p] = moved.blen[p] if b is None else b
        assert value == pytest.approx(costs.SubstitutionCost(moved, rows, cost.model).cost(), abs=1e-8)


@pytest.mark.parametrize("name, letters", [("K80", "TCAGY-"), ("HKY", "TCAG"), ("WAG", "ARNDCQEGHILKMFPSTWYV")])
def test_places_that_cannot_win_are_not_searched(name, letters, monkeypatch):
    """The best place is that of the search over all of them, and most are left out by their bounds."""
    rng = random.Random(8)
    tree = random_tree(rng, 14)
    tree.blen = [rng.choice([0.0, 1e-6, 0.02, 0.3, 2.0, 40.0]) for _ in tree.blen]
    rows = {tree.label[i]: "".join(rng.choice(letters) for _ in range(40)) for i in tree.leaves()}
    cost = costs.SubstitutionCost(tree, rows, models.make(name, [0.1, 0.3, 0.4, 0.2] if name == "HKY" else None))
    searched = []
    plain = costs.SubstitutionCost._best_halves
    monkeypatch.setattr(costs.SubstitutionCost, "_best_halves", lambda self, open_, out: (searched.append(len(open_)), plain(self, open_, out)))
    own, counts, seen = cost.cost(), [0, 0], 0
    for prune in tree.preorder():
        if prune != tree.root and tree.parent[prune] != tree.root:
            places = treelib.regraft_places(tree, prune)
            for base in (own, -1e9, 0.0):
                found = []
                for k, least in enumerate((None, -math.inf)):
                    searched.clear()
                    found.append(max(v for v, _ in cost.regraft_costs(prune, places, base, least)))
                    counts[k] += sum(searched)
                best = found[0]
                assert found[1] == pytest.approx(best, abs=1e-9)
                for least in (best - 0.5, best + 0.5):
                    got = max(v for v, _ in cost.regraft_costs(prune, places, base, least))
                    assert got == pytest.approx(best, abs=1e-9) if least < best else got < least
                seen += 1
    assert seen and 0 < counts[1] < counts[0] / 2


@pytest.mark.parametrize("seed", range(3))
def test_results_of_untouched_nodes_outlast_a_move(seed, monkeypatch):
    rng = random.Random(seed)
    tree = random_tree(rng, 16)
    rows = {tree.label[i]: "".join(rng.choice("TCAG-") for _ in range(25)) for i in tree.leaves()}
    cost = costs.SubstitutionCost(tree, rows, models.make("HKY", [0.1, 0.3, 0.4, 0.2], [3.0]))
    new, plain = [], costs.SubstitutionCost.node
    monkeypatch.setattr(costs.SubstitutionCost, "node", lambda self, i: (new.append(i), plain(self, i))[1])
    for _ in range(6):
        prune = rng.choice([i for i in cost.tree.preorder() if i != cost.tree.root and cost.tree.parent[i] != cost.tree.root])
        places = treelib.regraft_places(cost.tree, prune)
        cost.regraft_costs(prune, places, 0.0)
        optimise.go_on_with(cost, treelib.spr(cost.tree, prune, rng.choice(places)))
        new.clear()
        cost.cost()
        assert len(new) < len(tree)
        fresh = costs.SubstitutionCost(cost.tree.copy(), rows, cost.model)
        for prune in cost.tree.preorder():
            if prune != cost.tree.root and cost.tree.parent[prune] != cost.tree.root:
                places = treelib.regraft_places(cost.tree, prune)
                got, want = ([v for v, _ in c.regraft_costs(prune, places)] for c in (cost, fresh))
                assert got == pytest.approx(want, abs=1e-9)


def test_empirical_freqs():
    got = costs.empirical_freqs(["AAG-", "R"], DNA)
    assert got == pytest.approx([1 / 6, 1 / 6, 2.5 / 6, 1.5 / 6])


def test_single_leaf():
    t = parse("(a:0.3);")
    assert costs.SubstitutionCost(t, {"a": "ACGT"}, models.make("JC69")).cost() == pytest.approx(4 * np.log(0.25))
    assert costs.FitchCost(t, {"a": "ACGT"}, DNA).cost() == 0


def test_alignments_side_by_side_are_those_of_one_at_a_time():
    rng = random.Random(8)
    families = []
    for n in (2, 9, 5, 14):
        base, rows = "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 70))), {}
        for k in range(n):
            at, more = rng.randrange(len(base)), rng.randrange(8)
            rows[f"s{k}"] = base[:at] + "".join(rng.choice("ACGT") for _ in range(more)) + base[at + rng.randrange(9) :]
        rows["s1"] = rows["s1"] if n % 2 else ""
        forest = [f"{k}:{rng.random():.3f}" for k in rows]
        while len(forest) > 1:
            rng.shuffle(forest)
            forest.append(f"({forest.pop()},{forest.pop()}):{rng.random():.3f}")
        families.append((treelib.parse_newick(forest[0] + ";")[0], rows, DNA))
    for rule in ("first", "last"):
        scoring = costs.SimpleScoring(1, 2.5, 0.5)
        assert align_families(families, scoring, rule) == [align(*x, scoring, rule) for x in families]
        plain = [[(DNA.mask(c), NONE) for c in text] for _, rows, _ in families for text in rows.values()]
        jobs = [(x, y, Prices(scoring, b, 1, 4)) for x, y, b in zip(plain, plain[1:], [0.1, 1, 3] * 9)]
        assert align_pairs(jobs, rule) == [align_pair(*x, rule) for x in jobs]
