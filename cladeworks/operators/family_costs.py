"""Costs of families on their trees, column-parallel, and whole-family optimisations.

A cost is a sum over columns, so an aligned family is cut into blocks of columns; each block with the family's tree is a
row of its own and tasks share even one large family. Blocks are folded to distinct site patterns inside the cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import costs, indel_align, models, optimise, treelib
from cladeworks.functions.alphabet import BY_NAME
from cladeworks.functions.protocols import Aligner
from cladeworks.operators.hierarchy import hierarchy
from cladeworks.operators.sequence_ops import drop_gap_columns
from cladeworks.operators.tree_ops import links_of, tree_rows
from cladeworks.tables import family_facts, one_per_name

BLOCK = 128
LETTERS = 1 << 18  # letters of the families that are aligned side by side


def matched(seqs: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, family_id, alphabet, aligned, nodes) of the trees all of whose leaves name a record of their family.

    A family's alphabet and alignment are judged over the records on the tree.
    """
    rows = leaves_with_records(seqs, current)
    facts = family_facts(rows.select(F.col("tree_id").alias("family_id"), F.coalesce("residues", F.lit("")).alias("residues")))
    whole = rows.groupBy("tree_id").agg(F.bool_and(F.col("residues").isNotNull()).alias("whole")).where("whole").select("tree_id")
    facts = facts.where("alphabet <> 'none'").select(F.col("family_id").alias("tree_id"), "alphabet", "aligned", "longest").join(whole, "tree_id")
    return tree_rows(current).join(facts, "tree_id")


def leaves_with_records(seqs: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, family_id, seq_id, residues): each leaf with its family's record of that name, residues null if there is none."""
    parents = current.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = current.join(parents, ["tree_id", "node_id"], "left_anti").select("tree_id", "family_id", F.col("label").alias("seq_id"))
    names = one_per_name(seqs).select("family_id", "seq_id", "residues")
    return leaves.join(names, ["family_id", "seq_id"], "left").select("tree_id", "family_id", "seq_id", "residues")


def blocks(seqs: DataFrame, current: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tree_id, alphabet, b, rows, nodes): the aligned, matched families cut into blocks of columns."""
    fit = matched(seqs, current).where("aligned and longest > 0")
    cut_ = (
        leaves_with_records(seqs, current)
        .select("tree_id", "seq_id", "residues", F.explode(F.sequence(F.lit(0), F.floor((F.length("residues") - 1) / block).cast("int"))).alias("b"))
        .select("tree_id", "b", F.struct("seq_id", F.col("residues").substr(F.col("b") * block + 1, F.lit(block)).alias("part")).alias("row"))
    )
    return cut_.groupBy("tree_id", "b").agg(F.collect_list("row").alias("rows")).join(fit.select("tree_id", "alphabet", "nodes"), "tree_id")


def block_costs(cut_: DataFrame, build: Callable, kind: str) -> DataFrame:
    """(tree_id, cost, columns) for families in blocks; build(tree, rows, alphabet) gives the cost of a block. Trees that are not binary have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree_id, alphabet, rows, nodes in zip(b["tree_id"], b["alphabet"], b["rows"], b["nodes"], strict=True):
                try:
                    tree = treelib.from_links(links_of(nodes))
                except ValueError:
                    continue
                found = build(tree, {r["seq_id"]: r["part"] for r in rows}, BY_NAME[alphabet])
                if kind == "indel":
                    total, empty = found.pieces()
                    out.append((tree_id, total, empty, found.columns))
                else:
                    out.append((tree_id, found.cost(), 0.0, found.columns))
            yield pd.DataFrame(out, columns=["tree_id", "c", "e", "n"])

    parts = cut_.select("tree_id", "alphabet", "rows", "nodes").mapInPandas(run, "tree_id string, c double, e double, n long")
    sums = parts.groupBy("tree_id").agg(F.sum("c").alias("c"), F.max("e").alias("e"), F.sum("n").alias("columns"))
    n = F.col("columns")
    stirling = n * F.log(n) - n + F.log(n) / 2 + 1 / (12 * n) + costs.SHIFT
    return sums.select("tree_id", (F.col("c") + F.col("e") - stirling if kind == "indel" else F.col("c")).alias("cost"), "columns")


def fitch(cut_: DataFrame) -> DataFrame:
    return block_costs(cut_, costs.FitchCost, "parsimony")


def dollo(cut_: DataFrame, mismatch: float = 1.0, gap_open: float = 1.0, gap_ext: float = 1.0) -> DataFrame:
    return block_costs(cut_, lambda t, r, a: costs.DolloCost(t, r, a, costs.SimpleScoring(mismatch, gap_open, gap_ext)), "parsimony")


def dollo_by_model(cut_: DataFrame, dna: str = "JC69", protein: str = "WAG", times=(0.05, 0.1, 0.3, 0.5, 0.7), gap_open: float = 2.5, gap_ext: float = 1.0) -> DataFrame:
    """Dollo cost with mismatches and gaps priced by a model's tables at the time nearest to each branch."""

    def build(tree, rows, alphabet):
        model = models.make(dna if alphabet.name == "dna" else protein)
        return costs.DolloCost(tree, rows, alphabet, costs.ModelScoring(model, list(times), gap_open, gap_ext))

    return block_costs(cut_, build, "parsimony")


def log_likelihood(cut_: DataFrame, dna: str = "JC69", protein: str = "WAG", freqs=None, params=()) -> DataFrame:
    """Substitution log-likelihood with one model for each alphabet; freqs and params are those of the dna model."""

    def build(tree, rows, alphabet):
        model = models.make(dna, freqs, params) if alphabet.name == "dna" else models.make(protein)
        return costs.SubstitutionCost(tree, rows, model)

    return block_costs(cut_, build, "substitution")


def indel_likelihood(cut_: DataFrame, lam: float = 1.5, mu: float = 1.5, dna: str = "JC69", protein: str = "WAG", params=()) -> DataFrame:
    def build(tree, rows, alphabet):
        inner = dna if alphabet.name == "dna" else protein
        return costs.IndelCost(tree, rows, models.make(f"PIP-{inner}", None, [lam, mu, *params]))

    return block_costs(cut_, build, "indel")


def site_pattern_counts(seqs: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, columns, patterns): columns of the aligned families, without all-gap ones, and how many are different."""
    rows = leaves_with_records(seqs, current).join(matched(seqs, current).where("aligned and longest > 0").select("tree_id"), "tree_id")
    cells = rows.select("tree_id", "seq_id", F.posexplode(F.split("residues", "")).alias("col", "ch")).where("ch <> ''")
    column = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq_id", "ch"))), lambda r: r["ch"]), "")
    columns = cells.groupBy("tree_id", "col").agg(column.alias("p")).where(F.col("p").rlike("[^-]"))
    return columns.groupBy("tree_id").agg(F.count(F.lit(1)).alias("columns"), F.count_distinct("p").alias("patterns"))


def whole_families(seqs: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, alphabet, aligned, rows, nodes): the matched families as one row each, for optimisers and the aligner."""
    rows = leaves_with_records(seqs, current).groupBy("tree_id").agg(F.collect_list(F.struct("seq_id", "residues")).alias("rows"))
    return matched(seqs, current).select("tree_id", "alphabet", "aligned", "nodes").join(rows, "tree_id")


def per_family(families: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Rows of fn(tree, rows, alphabet) for every family with a binary tree, families spread evenly over tasks."""
    return per_families(families, lambda some: [fn(*x) for x in some], schema, 1)


def per_families(families: DataFrame, fn: Callable, schema: str, letters: int) -> DataFrame:
    """Rows of fn for every family with a binary tree; fn gets lists of (tree, rows, alphabet), of at least that many
    letters as far as a batch goes, and gives each one's rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, some, many = [], {}, 0
            for tree_id, alphabet, rows, nodes in zip(b["tree_id"], b["alphabet"], b["rows"], b["nodes"], strict=True):
                try:
                    tree = treelib.from_links(links_of(nodes))
                except ValueError:
                    continue
                some[tree_id] = (tree, {r["seq_id"]: r["residues"] for r in rows}, BY_NAME[alphabet])
                many += sum(len(r["residues"]) for r in rows)
                if many >= letters or letters == 1:
                    out += [(k, *r) for k, found in zip(some, fn([*some.values()]), strict=True) for r in found]
                    some, many = {}, 0
            if some:
                out += [(k, *r) for k, found in zip(some, fn([*some.values()]), strict=True) for r in found]
            yield pd.DataFrame(out, columns=names)

    width = max(1, families.sparkSession.sparkContext.defaultParallelism * 4)
    return families.select("tree_id", "alphabet", "rows", "nodes").repartition(width, "tree_id").mapInPandas(run, schema)


def subtree_alignments(seqs: DataFrame, nodes: DataFrame, current: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, seq_id, residues): for the wanted nodes (tree_id, node_id) of aligned families the rows of the
    leaves below them, without the columns that are gaps in all of those; by default both children of each root."""
    fit = matched(seqs, current).where("aligned and longest > 0").select("tree_id")
    paths = hierarchy(nodes).where("cycle_node is null").join(fit, "tree_id")
    if wanted is None:
        above = paths.where("levels >= 2").select("tree_id", "node_id", F.col("path")[1].alias("below"))
    else:
        above = paths.select("tree_id", "node_id", F.explode("path").alias("below"))
        above = above.join(wanted.select("tree_id", F.col("node_id").alias("below")).distinct(), ["tree_id", "below"], "left_semi")
    leaves = current.join(current.select("tree_id", F.col("parent_id").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    named = leaves.join(above, ["tree_id", "node_id"]).select("tree_id", F.col("below").alias("node_id"), F.col("label").alias("seq_id"))
    rows = named.join(leaves_with_records(seqs, current).select("tree_id", "seq_id", "residues").distinct(), ["tree_id", "seq_id"])
    keyed = rows.withColumn("family_id", F.concat_ws("/", "tree_id", F.col("node_id").cast("string")))
    return drop_gap_columns(keyed).select("tree_id", "node_id", "seq_id", "residues")


def node_maps(families: DataFrame) -> DataFrame:
    """(tree_id, place, map_x, map_y) of each inner node of the aligned families, nodes by their place in order of node_id."""

    def fn(tree, rows, alphabet):
        return [(i, x, y) for i, (x, y) in sorted(treelib.node_maps(tree, rows).items())]

    return per_family(families.where("aligned"), fn, "tree_id string, place int, map_x array<int>, map_y array<int>")


def aligned_rows(families: DataFrame, gap_open: float = 2.5, gap_ext: float = 0.5, aligner: Aligner | None = None) -> DataFrame:
    """(tree_id, seq_id, residues, columns, score): the indel-aware progressive alignment of each family on its tree, or
    that of another aligner (with score 0)."""

    def fn(families):
        if aligner is None:
            found = indel_align.align_families(families, costs.SimpleScoring(1.0, gap_open, gap_ext))
        else:
            found = [(aligner.align(*x), {0: 0.0}) for x in families]
        return [[(k, v, len(v), sum(scores.values())) for k, v in sorted(out.items())] for out, scores in found]

    return per_families(families, fn, "tree_id string, seq_id string, residues string, columns int, score double", LETTERS)


def optimised(families: DataFrame, what: str, dna: str = "K80", protein: str = "WAG", rounds: int | None = None) -> DataFrame:
    """(tree_id, initial, final, rounds, newick): branches, model, topology, parsimony or all of each aligned family's cost, optimised."""

    def fn(tree, rows, alphabet):
        name = dna if alphabet.name == "dna" else protein
        model = models.make(name)
        likelihood = costs.IndelCost if name.upper().startswith("PIP-") else costs.SubstitutionCost
        cost = costs.FitchCost(tree, rows, alphabet) if what == "parsimony" else likelihood(tree, rows, model)
        if not cost.columns:
            return []
        go_on = optimise.fixed_rounds(rounds) if rounds else None
        got = {
            "branches": lambda: optimise.optimise_branches(cost),
            "model": lambda: optimise.optimise_model(cost, "empirical", list(rows.values())),
            "topology": lambda: optimise.optimise_topology(cost, go_on),
            "parsimony": lambda: optimise.optimise_topology(cost, go_on),
            "all": lambda: optimise.infer(cost, "empirical", list(rows.values())),
        }[what]()
        return [(got.initial, got.final, got.rounds, cost.tree.newick())]

    return per_family(families.where("aligned"), fn, "tree_id string, initial double, final double, rounds int, newick string")


def best_moves(families: DataFrame, what: str = "likelihood", dna: str = "JC69", protein: str = "WAG") -> DataFrame:
    """(tree_id, base, prune, best): for each prune place of each aligned family the cost of its best regraft, by
    ``likelihood`` or ``parsimony``; every place is a row, and thus a task's work, of its own. Trees that are not binary
    have no row."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree_id, nodes in zip(b["tree_id"], b["nodes"], strict=True):
                try:
                    t = treelib.from_links(links_of(nodes))
                except ValueError:
                    continue
                rows += [(tree_id, i) for i in t.preorder() if i != t.root and t.parent[i] != t.root]
            yield pd.DataFrame(rows, columns=["tree_id", "prune"])

    prunes = families.where("aligned").select("tree_id", "nodes").mapInPandas(places, "tree_id string, prune int")
    work = prunes.join(families.where("aligned"), "tree_id").repartition(families.sparkSession.sparkContext.defaultParallelism * 4, "tree_id", "prune")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree_id, prune, alphabet, rows, nodes in zip(b["tree_id"], b["prune"], b["alphabet"], b["rows"], b["nodes"], strict=True):
                tree = treelib.from_links(links_of(nodes))
                texts = {r["seq_id"]: r["residues"] for r in rows}
                if what == "parsimony":
                    cost = costs.FitchCost(tree, texts, BY_NAME[alphabet])
                else:
                    cost = costs.SubstitutionCost(tree, texts, models.make(dna if alphabet == "dna" else protein))
                base = cost.cost()
                move = optimise.best_regraft(cost, base, int(prune))
                if move:
                    out.append((tree_id, base, int(prune), move[0]))
            yield pd.DataFrame(out, columns=["tree_id", "base", "prune", "best"])

    return work.select("tree_id", "prune", "alphabet", "rows", "nodes").mapInPandas(run, "tree_id string, base double, prune int, best double")
