"""Operators on tables of tree nodes: facts, leaves below nodes, partitions, distances between trees, traversal orders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import treelib
from cladeworks.operators.hierarchy import hierarchy


def tree_rows(current: DataFrame) -> DataFrame:
    """(tree_id, family_id, nodes): one row a tree, its links as an array - the unit that tree algorithms work on."""
    link = F.struct("node_id", "parent_id", "child_ord", "label", "blen")
    return current.groupBy("tree_id", "family_id").agg(F.collect_list(link).alias("nodes"))


def links_of(nodes) -> list[tuple]:
    """Plain tuples of a tree's links as they arrive in a worker."""
    none = lambda x: None if x is None or x != x else x
    return [
        (int(r["node_id"]), None if none(r["parent_id"]) is None else int(r["parent_id"]), none(r["child_ord"]), r["label"], none(r["blen"]))
        for r in nodes
    ]


def per_tree(trees: DataFrame, fn, schema: str) -> DataFrame:
    """Rows of fn(tree_id, Tree) for every tree that is one; fn gives a list of tuples after tree_id."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree_id, nodes in zip(b["tree_id"], b["nodes"], strict=True):
                try:
                    tree = treelib.from_links(links_of(nodes))
                except ValueError:
                    continue
                rows += [(tree_id, *r) for r in fn(tree)]
            yield pd.DataFrame(rows, columns=names)

    return trees.select("tree_id", "nodes").mapInPandas(run, schema)


def checks(trees: DataFrame) -> DataFrame:
    """(tree_id, problem): why a tree is no rooted binary tree, null where it is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for nodes in b["nodes"]:
                try:
                    treelib.from_links(links_of(nodes))
                    said.append(None)
                except ValueError as e:
                    said.append(str(e))
            yield pd.DataFrame({"tree_id": b["tree_id"], "problem": pd.array(said, dtype="string")})

    return trees.select("tree_id", "nodes").mapInPandas(run, "tree_id string, problem string")


def newick(trees: DataFrame) -> DataFrame:
    """(tree_id, newick) of every binary tree."""
    return per_tree(trees, lambda t: [(t.newick(),)], "tree_id string, newick string")


def traversals(trees: DataFrame) -> DataFrame:
    """(tree_id, place, pre, post): places of nodes, in order of node_id, in both traversals."""

    def orders(t: treelib.Tree) -> list[tuple]:
        pre = {n: i for i, n in enumerate(t.preorder())}
        post = {n: i for i, n in enumerate(t.postorder())}
        return [(n, pre[n], post[n]) for n in range(len(t))]

    return per_tree(trees, orders, "tree_id string, place int, pre int, post int")


def tree_facts(current: DataFrame) -> DataFrame:
    """(tree_id, nodes, leaves, height): the height is the sum of all usable branch lengths."""
    usable = F.when(F.col("blen").isNotNull() & ~F.isnan("blen") & (F.col("blen") > 0), F.col("blen")).otherwise(0.0)
    return current.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.sum(usable).alias("height")
    )


def blen_percentiles(current: DataFrame, k: int = 4) -> DataFrame:
    """(tree_id, percentiles): k cut points of the usable branch lengths at i / (k + 1), interpolated."""
    usable = current.where(F.col("blen").isNotNull() & ~F.isnan("blen"))
    points = F.array(*[F.lit(i / (k + 1)) for i in range(1, k + 1)])
    return usable.groupBy("tree_id").agg(F.percentile("blen", points).alias("percentiles"))


def leaf_descendants(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, node_id, label) of every node and each leaf at or below it, from the leaves' paths.

    Paths are unfolded after the join only, and a merge join is asked for: Catalyst guesses paths to be as small as the
    links that they are made from, and would collect them in the driver to broadcast them.
    """
    paths = hierarchy(nodes).select("tree_id", "node_id", "path")
    leaves = current.where("is_leaf").select("tree_id", "node_id", "label")
    return paths.hint("merge").join(leaves, ["tree_id", "node_id"]).select("tree_id", F.explode("path").alias("node_id"), "label")


def relations(current: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent, sibling, children): neighbours of every node; a parent that is not there is null, as is
    the sibling of a node without exactly one."""
    there = current.select("tree_id", F.col("node_id").alias("parent_id"))
    own = current.select("tree_id", "node_id", "parent_id").join(there.withColumn("ok", F.lit(True)), ["tree_id", "parent_id"], "left")
    up = own.select("tree_id", "node_id", F.when(F.col("ok"), F.col("parent_id")).alias("parent"))
    kids = up.where("parent is not null").groupBy("tree_id", "parent").agg(
        F.count(F.lit(1)).alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")
    )
    mine = kids.select("tree_id", F.col("parent").alias("node_id"), F.col("n").alias("children"))
    beside = up.join(kids, ["tree_id", "parent"], "left").select(
        "tree_id", "node_id", "parent", F.when(F.col("n") == 2, F.when(F.col("lo") == F.col("node_id"), F.col("hi")).otherwise(F.col("lo"))).alias("sibling")
    )
    return beside.join(mine, ["tree_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))


def partitions(trees: DataFrame) -> DataFrame:
    """(tree_id, side, leaves): both sides of each branch's split, sorted labels joined by commas, in the order found."""
    fn = lambda t: [(i, ",".join(sorted(s))) for i, s in enumerate(treelib.partitions(t))]
    return per_tree(trees, fn, "tree_id string, side int, leaves string")


def robinson_foulds(one: DataFrame, two: DataFrame) -> DataFrame:
    """(tree_id, rf_directed, rf_symmetric): splits of tree one's over the common leaves that two lacks; trees meet by tree_id."""
    pairs = one.select("tree_id", F.col("nodes").alias("n1")).join(two.select("tree_id", F.col("nodes").alias("n2")), "tree_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree_id, n1, n2 in zip(b["tree_id"], b["n1"], b["n2"], strict=True):
                try:
                    t1, t2 = treelib.from_links(links_of(n1)), treelib.from_links(links_of(n2))
                except ValueError:
                    continue
                there = treelib.robinson_foulds(t1, t2)
                rows.append((tree_id, there, there + treelib.robinson_foulds(t2, t1)))
            yield pd.DataFrame(rows, columns=["tree_id", "rf_directed", "rf_symmetric"])

    return pairs.mapInPandas(run, "tree_id string, rf_directed int, rf_symmetric int")


def spr_places(trees: DataFrame) -> DataFrame:
    """(tree_id, moves): how many regraft places all prune places of a tree have together."""

    def count(t: treelib.Tree) -> list[tuple]:
        prunes = [i for i in t.preorder() if i != t.root and t.parent[i] != t.root]
        return [(sum(len(treelib.regraft_places(t, p)) for p in prunes),)]

    return per_tree(trees, count, "tree_id string, moves long")


def nj_trees(distances: DataFrame) -> DataFrame:
    """(tree_id, newick, height): the neighbour-joining tree of the leaves of each tree, from their pair distances; leaves
    stand in order of their names. One tree is one task's work, as joining is a chain of whole-matrix steps."""
    pairs = distances.groupBy("tree_id").agg(F.collect_list(F.struct("a", "b", "distance")).alias("pairs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            rows = []
            for tree_id, found in zip(b["tree_id"], b["pairs"], strict=True):
                ids = sorted({r["a"] for r in found} | {r["b"] for r in found})
                at = {x: i for i, x in enumerate(ids)}
                d = np.zeros((len(ids), len(ids)))
                for r in found:
                    d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
                t = treelib.neighbour_joining(d, ids)
                rows.append((tree_id, t.newick(), t.height))
            yield pd.DataFrame(rows, columns=["tree_id", "newick", "height"])

    return pairs.mapInPandas(run, "tree_id string, newick string, height double")


def against_newick(trees: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree_id, rf_directed, rf_symmetric): distances between each tree and the Newick text of the same tree_id."""
    pairs = trees.select("tree_id", "nodes").join(texts.select("tree_id", "newick"), "tree_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree_id, nodes, text in zip(b["tree_id"], b["nodes"], b["newick"], strict=True):
                try:
                    one, two = treelib.from_links(links_of(nodes)), treelib.parse_newick(text)[0]
                except ValueError:
                    continue
                there = treelib.robinson_foulds(one, two)
                rows.append((tree_id, there, there + treelib.robinson_foulds(two, one)))
            yield pd.DataFrame(rows, columns=["tree_id", "rf_directed", "rf_symmetric"])

    return pairs.mapInPandas(run, "tree_id string, rf_directed int, rf_symmetric int")
