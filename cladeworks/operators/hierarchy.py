"""Parent-child rows to full hierarchies: path, root, levels, descendants, circles and the edges that close them.

A node names at most one parent, so a connected component is either one rooted tree or one circle with trees hanging from
it. Components are found first: a union-find over chunks of rows, whose labels are then joined across chunks. Each
component is co-located, and an iterative depth-first traversal with node colours resolves it. No chunk holds more than
``chunk`` nodes: a larger component is dealt out by ranges of node_id, each range is traversed in its own task, and the
few nodes at which ways leave a range are resolved among themselves by pointer doubling. The result is the same whatever
the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.components import components
from cladeworks.session import cut, shuffle_width

CHUNK = 8192  # nodes in one traversal
PATH_BATCH = 2_000_000  # node_ids of paths held at once in a worker

_LABELLED = "tree_id string, node_id int, parent_id int, blen double, component int"
_LOCAL = (
    "tree_id string, node_id int, component int, slot long, exit int, least int, root int, levels long, blen_sum double, "
    "path array<int>, cycle_node int"
)


def rows_in_force(
    nodes: DataFrame,
    tree: str = "tree_id",
    node: str = "node_id",
    parent: str = "parent_id",
    blen: str = "blen",
    loaded: str = "loaded_at",
) -> DataFrame:
    """One row per (tree, node): that with the greatest loaded_at.

    Equal loaded_at: the greatest parent, then the greatest blen, nulls being smallest. Rows without tree or node name
    no node and are left out. Other columns, whatever their names, are ignored.
    """
    return (
        nodes.where(F.col(tree).isNotNull() & F.col(node).isNotNull())
        .select(
            F.col(tree).cast("string").alias("tree_id"),
            F.col(node).cast("int").alias("node_id"),
            F.struct(
                F.col(loaded).alias("l"), F.col(parent).cast("int").alias("p"), F.col(blen).cast("double").alias("b")
            ).alias("v"),
        )
        .groupBy("tree_id", "node_id")
        .agg(F.max("v").alias("v"))
        .select("tree_id", "node_id", F.col("v.p").alias("parent_id"), F.col("v.b").alias("blen"))
    )


def _in_blocks(df: DataFrame, keys: list[str], order: str, fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call fn on blocks of whole groups of keys, with the number of each row's group; a group is at most a chunk."""
    spread = df.repartition(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys, order)

    def fresh(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        if len(t) > 1:
            new[1:] = False
            for k in keys:
                c = t[k].combine_chunks()
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            new = fresh(t)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from fn(t.slice(0, last), np.cumsum(new[:last]) - 1)
            held = t.slice(last).combine_chunks()
        if held is not None:
            yield from fn(held, np.cumsum(fresh(held)) - 1)

    return spread.mapInArrow(run, schema)


def _places(t: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node_ids, place of each row's parent in the block or -1, whether it names a parent)."""
    ids = t["node_id"].to_numpy().astype(np.int64)
    named = t["parent_id"].is_valid().to_numpy()
    parents = pc.fill_null(t["parent_id"], 0).to_numpy().astype(np.int64)
    key = (group.astype(np.int64) << 33) + ids + (1 << 31)
    want = (group.astype(np.int64) << 33) + parents + (1 << 31)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return ids, np.where(named & (key[at] == want), at, -1), named


def union_find(ids: list[int], up: list[int]) -> list[int]:
    """The smallest member's place of each place's component."""
    boss = list(range(len(ids)))

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    for i, p in enumerate(up):
        if p >= 0:
            a, b = find(i), find(p)
            if a != b:
                if ids[a] < ids[b]:
                    boss[b] = a
                else:
                    boss[a] = b
    return [find(i) for i in range(len(ids))]


def _label(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, up, _ = _places(t, group)
    label = ids[union_find(ids.tolist(), up.tolist())]
    for b in pa.table({n: t[n] for n in ("tree_id", "node_id", "parent_id", "blen")} | {"component": pa.array(label, pa.int32())}).to_batches():
        yield b


def depth_first(ids: list[int], up: list[int], lengths: list[float]) -> dict[str, list]:
    """Iterative depth-first traversal with colours over places; up is -1 where the way ends or leaves the block.

    circle: the place of the circle's least node for nodes on or below one, else -1; on_ring; order: places in preorder
    from the tops (ends of ways, and nodes that hang directly from a circle) down; top, levels, total and least (smallest
    node_id) of each place's way from its top.
    """
    n = len(ids)
    # along the parent links: white 0, grey 1 (on the current way), black 2; a grey node met again closes a circle
    colour, circle, on_ring = [0] * n, [-1] * n, [False] * n
    for i in range(n):
        way, j = [], i
        while j >= 0 and colour[j] == 0:
            colour[j] = 1
            way.append(j)
            j = up[j]
        if j >= 0 and colour[j] == 1:
            ring = way[way.index(j) :]
            least = min(ring, key=ids.__getitem__)
            for x in ring:
                circle[x], on_ring[x] = least, True
        below = circle[j] if j >= 0 else -1
        for x in way:
            colour[x] = 2
            if not on_ring[x]:
                circle[x] = below
    kids: list[list[int]] = [[] for _ in range(n)]
    tops = []
    for i, p in enumerate(up):
        if on_ring[i]:
            continue
        if p < 0 or on_ring[p]:
            tops.append(i)
        else:
            kids[p].append(i)
    order, top, levels, total, least_id = [], [-1] * n, [0] * n, [0.0] * n, ids[:]
    for start in tops:
        levels[start], total[start], top[start] = 1, lengths[start], start
        stack = [start]
        while stack:
            i = stack.pop()
            order.append(i)
            for k in kids[i]:
                levels[k], total[k], top[k] = levels[i] + 1, total[i] + lengths[k], start
                least_id[k] = min(ids[k], least_id[i])
                stack.append(k)
    return {"circle": circle, "on_ring": on_ring, "order": order, "top": top, "levels": levels, "total": total, "least": least_id}


def _traverse(want_paths: bool) -> Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]:
    """Each chunk's rows as far as the chunk knows them: exit is the parent outside the chunk at which the way goes on."""

    def fn(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, up, named = _places(t, group)
        plain = ids.tolist()
        found = depth_first(plain, up.tolist(), t["blen"].to_pylist())
        parents = pc.fill_null(t["parent_id"], 0).to_numpy()
        order = found["order"] + [i for i, x in enumerate(found["on_ring"]) if x]
        size = np.array([found["levels"][i] for i in order], np.int64) if want_paths else np.zeros(len(order), np.int64)
        step = np.cumsum(size) // PATH_BATCH
        way = np.zeros(max(found["levels"], default=0) + 1, np.int32)
        for k in range(int(step[-1]) + 1 if len(step) else 0):
            rows = np.array(order, np.int64)[step == k]
            values: list[np.ndarray] = []
            if want_paths:
                for i in rows.tolist():
                    level = found["levels"][i]
                    if level:
                        way[level - 1] = plain[i]
                        values.append(way[:level].copy())
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(size[step == k])]).astype(np.int32)
            path = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())) if want_paths else pa.nulls(len(rows), pa.list_(pa.int32()))
            pick = lambda name, rows=rows: np.array(found[name])[rows]
            circle, top = pick("circle"), pick("top")
            ringed = circle >= 0
            above = np.where(top >= 0, top, 0)
            leaves = ~ringed & named[above] & (top >= 0)  # the top names a parent that is not in the chunk
            own = t.select(["tree_id", "component", "slot"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    own["tree_id"].combine_chunks(), pa.array(ids[rows], pa.int32()), own["component"].combine_chunks(), own["slot"].combine_chunks(),
                    pa.array(parents[above], pa.int32(), mask=~leaves), pa.array(pick("least"), pa.int32()),
                    pa.array(ids[above], pa.int32(), mask=ringed), pa.array(pick("levels"), pa.int64(), mask=ringed),
                    pa.array(pick("total"), pa.float64(), mask=ringed), path, pa.array(ids[np.where(ringed, circle, 0)], pa.int32(), mask=~ringed),
                ],
                names=[c.split()[0] for c in _LOCAL.split(", ")],
            )

    return fn


def _slot(chunk: int, big) -> F.Column:
    """Ranges of node_id within what is larger than a chunk: ids are distinct, so a range holds at most a chunk of them."""
    return F.when(big, F.floor(F.col("node_id") / F.lit(chunk))).otherwise(F.lit(0)).cast("long")


def _sized(rows: DataFrame, keys: list[str], chunk: int) -> tuple[DataFrame, bool]:
    """rows with ``big``, whether their keys have more rows than a chunk; and whether any has."""
    big = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select(*keys, F.lit(True).alias("big")))
    if not big.limit(1).count():
        return rows.withColumn("big", F.lit(False)), False
    return rows.join(big, keys, "left").withColumn("big", F.coalesce("big", F.lit(False))), True


def with_components(current: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows in force with component, the smallest node_id of their connected component; parents that are not there are null
    in trees larger than a chunk and not yet told apart in others."""
    sized, any_big = _sized(current, ["tree_id"], chunk)
    if any_big:  # whether a parent is there cannot be seen from one chunk
        there = current.select("tree_id", F.col("node_id").alias("p"))
        known = sized.where("big").join(there.withColumnRenamed("tree_id", "t"), (F.col("tree_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left")
        sized = sized.where("not big").unionByName(known.select("tree_id", "node_id", F.col("p").alias("parent_id"), "blen", "big"))
    sized = sized.withColumn("slot", _slot(chunk, F.col("big")))
    labelled = _in_blocks(sized.select("tree_id", "slot", "node_id", "parent_id", "blen"), ["tree_id", "slot"], "node_id", _label, _LABELLED)
    if not any_big:
        return labelled
    labelled = cut(labelled)
    slot = lambda c: F.floor(F.col(c) / F.lit(chunk))
    over = labelled.where(slot("node_id") != slot("parent_id")).select("tree_id", F.col("component").alias("one"), "parent_id")
    named = labelled.select("tree_id", F.col("node_id").alias("parent_id"), F.col("component").alias("two"))
    merged = components(over.join(named, ["tree_id", "parent_id"]).where("one <> two").select("tree_id", "one", "two").distinct(), "one", "two", ("tree_id",))
    final = merged.select("tree_id", F.col("node").alias("component"), "label")
    return labelled.join(final, ["tree_id", "component"], "left").select(
        "tree_id", "node_id", "parent_id", "blen", F.coalesce("label", "component").alias("component")
    )


def _local(rows: DataFrame, want_paths: bool) -> DataFrame:
    return _in_blocks(
        rows.select("tree_id", "component", "slot", "node_id", "parent_id", "blen"), ["tree_id", "component", "slot"], "node_id", _traverse(want_paths), _LOCAL
    )


def _doubled(state: DataFrame, rounds: int, combine: dict[str, F.Column], keys: tuple[str, str] = ("tree_id", "node_id")) -> DataFrame:
    """Rows (tree_id, node_id, up, ...) moved 2**rounds steps along up; combine says how own and farther (``_``) values join."""
    tree, node = keys
    names, width = state.columns, shuffle_width(state.sparkSession)
    for _ in range(rounds):
        if not state.where("up is not null").limit(1).count():
            break
        far = state.select(*[F.col(c).alias(f"_{c}") for c in names])
        moving = state.where("up is not null").join(far, (F.col(tree) == F.col(f"_{tree}")) & (F.col("up") == F.col(f"_{node}")))
        moved = moving.select(*[(F.col("_up") if c == "up" else combine[c]).alias(c) if c == "up" or c in combine else F.col(c) for c in names])
        state = cut(state.where("up is null").unionByName(moved).coalesce(width))  # a union has the partitions of both sides
    return state


def _across(rows: DataFrame, want_paths: bool) -> DataFrame:
    """The columns of _local for components dealt out over several chunks, ways followed from chunk to chunk."""
    seen = cut(_local(rows, False).drop("path"))
    doors = seen.where("exit is not null").select("tree_id", F.col("exit").alias("node_id")).distinct()
    at = cut(seen.join(doors, ["tree_id", "node_id"]))  # the nodes at which ways enter a chunk
    rounds = max(1, math.ceil(math.log2(at.count() + 1)))
    state = at.select("tree_id", "node_id", F.col("exit").alias("up"), "least", "levels", "blen_sum", "root", "cycle_node")
    walked = _doubled(
        state, rounds,
        {"least": F.least("least", "_least"), "levels": F.col("levels") + F.col("_levels"), "blen_sum": F.col("_blen_sum") + F.col("blen_sum"),
         "root": F.col("_root"), "cycle_node": F.col("_cycle_node")},
    )
    lost = walked.where("up is not null")  # still walking after more steps than there are doors: a circle through several chunks
    ring = walked.join(lost.select("tree_id", F.col("up").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_semi").select(
        "tree_id", F.col("node_id").alias("r"), F.col("least").alias("circle")
    )
    ring = cut(ring)
    ends = walked.join(ring.withColumnRenamed("r", "up").withColumnRenamed("circle", "far"), ["tree_id", "up"], "left").join(
        ring.withColumnRenamed("r", "node_id").select("tree_id", "node_id", F.lit(True).alias("on")), ["tree_id", "node_id"], "left"
    )
    facts = ends.select(
        "tree_id", F.col("node_id").alias("exit"), F.col("root").alias("f_root"), F.col("levels").alias("f_levels"),
        F.col("blen_sum").alias("f_blen"), F.coalesce("far", "cycle_node").alias("f_cycle"), F.coalesce("on", F.lit(False)).alias("f_ring"),
    )
    none = F.array().cast("array<int>")
    if want_paths:
        own = cut(_local(rows, True).join(doors, ["tree_id", "node_id"], "left_semi"))
        arcs = own.join(ring.withColumnRenamed("r", "node_id"), ["tree_id", "node_id"], "left_semi").select(
            "tree_id", "slot", "exit", F.col("path").alias("arc")  # the circle's nodes in the chunk that is left at exit
        )
        marked = (
            own.join(ring.select("tree_id", F.col("r").alias("node_id"), F.lit(True).alias("on")), ["tree_id", "node_id"], "left")
            .join(ring.select("tree_id", F.col("r").alias("exit"), F.lit(True).alias("to")), ["tree_id", "exit"], "left")
            .join(arcs, ["tree_id", "slot", "exit"], "left")
        )
        start = marked.select(
            "tree_id", "node_id", F.when(F.col("on").isNull() & F.col("to").isNull(), F.col("exit")).alias("up"),
            F.when(F.col("on"), none).when(F.col("to"), F.array_except("path", F.coalesce("arc", none))).otherwise(F.col("path")).alias("path"),
        )
        ways = _doubled(cut(start), rounds, {"path": F.concat("_path", "path")}).select("tree_id", F.col("node_id").alias("exit"), F.col("path").alias("f_path"))
        facts = facts.join(ways, ["tree_id", "exit"])
    users = seen.where("exit is not null").select("tree_id", "slot", "exit").distinct().join(facts, ["tree_id", "exit"])
    if want_paths:
        users = users.join(arcs, ["tree_id", "slot", "exit"], "left")
    out = _local(rows, want_paths).join(cut(users), ["tree_id", "slot", "exit"], "left")  # at most a chunk of rows a key
    gone = F.col("f_cycle").isNotNull()
    path = F.lit(None).cast("array<int>")
    if want_paths:
        path = F.concat(F.coalesce("f_path", none), F.when(F.col("f_ring"), F.array_except("path", F.coalesce("arc", none))).otherwise(F.col("path")))
    return out.select(
        "tree_id", "node_id", "component", F.when(~gone, F.when(F.col("exit").isNull(), F.col("root")).otherwise(F.col("f_root"))).alias("root"),
        F.when(~gone, F.col("levels") + F.coalesce("f_levels", F.lit(0))).alias("levels"),
        F.when(~gone, F.coalesce("f_blen", F.lit(0.0)) + F.col("blen_sum")).alias("blen_sum"), path.alias("path"), F.coalesce("cycle_node", "f_cycle").alias("cycle_node"),
    )


def hierarchy(nodes: DataFrame, want_paths: bool = True, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """Every node with component, root, levels, summed blen, path from the root and, if its way up never ends, its circle.

    * The row with the greatest loaded_at is in force (see rows_in_force); a parent that is not there, or null, ends the
      way: that node is a root, with levels 1. A node may be its own parent, which is a circle of one.
    * blen_sum adds the blen of all nodes on the path, the root's own included; null and NaN blen count as 0, negative
      and huge ones as they are.
    * Nodes on a circle have root, levels and blen_sum null and an empty path. Nodes below a circle have them null too;
      their path starts at the first node below the circle.
    * component is the smallest node_id of the connected component, of whatever size.
    * path is null unless want_paths; paths are emitted as they are walked, so a worker holds at most PATH_BATCH ids of
      them. An empty table gives an empty result.
    """
    current = rows_in_force(nodes, **columns).withColumn(
        "blen", F.when(F.col("blen").isNull() | F.isnan("blen"), 0.0).otherwise(F.col("blen"))
    )
    labelled = cut(with_components(cut(current), chunk))
    sized, any_big = _sized(labelled, ["tree_id", "component"], chunk)
    rows = sized.withColumn("slot", _slot(chunk, F.col("big")))
    names = ["tree_id", "node_id", "component", "root", F.col("levels").cast("int").alias("levels"), "blen_sum", "path", "cycle_node"]
    small = _local(rows.where("not big"), want_paths)  # a parent that is not in its component's only chunk is not there
    if not any_big:
        return small.select(*names)
    return small.select(*names).unionByName(_across(rows.where("big"), want_paths).select(*names))


def descendants(found: DataFrame) -> DataFrame:
    """(tree_id, node_id, below_id) for every node and each node below it, from hierarchy(want_paths=True).

    A node's path names the nodes it lies below, so these pairs come from the paths without a shuffle, whatever the size
    of a subtree. All nodes of a circle lie below each other and have the same nodes below them: the circle's smallest
    node stands for them and has every other node on or below the circle.
    """
    below = found.select("tree_id", F.explode("path").alias("node_id"), F.col("node_id").alias("below_id"))
    circled = found.where("cycle_node is not null").select("tree_id", F.col("cycle_node").alias("node_id"), F.col("node_id").alias("below_id"))
    return below.unionByName(circled).where("node_id <> below_id")


def on_or_below_circles(nodes: DataFrame, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """(tree_id, node_id, cycle_node) of the nodes whose way up runs into a circle."""
    found = hierarchy(nodes, want_paths=False, chunk=chunk, **columns)
    return found.where("cycle_node is not null").select("tree_id", "node_id", "cycle_node")


def back_edges(nodes: DataFrame, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """(tree_id, from_id, to_id): the edge that closes each circle when it is walked down from its smallest node, to_id."""
    circles = on_or_below_circles(nodes, chunk, **columns).where("node_id = cycle_node").select("tree_id", "node_id")
    return rows_in_force(nodes, **columns).join(circles, ["tree_id", "node_id"]).select(
        "tree_id", F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id")
    )


def child_list_problems(
    nodes: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", children: str = "children", loaded: str = "loaded_at"
) -> DataFrame:
    """(tree_id, node_id, child_id, problem): children of the rows in force that are ``listed`` without naming the node as
    their parent, or name it and are ``not listed``. parent_id decides what hierarchies are; this tells where lists differ.

    Nulls and repeats in a list count for nothing; a null list is an empty one.
    """
    kept = (
        nodes.where(F.col(tree).isNotNull() & F.col(node).isNotNull())
        .select(
            F.col(tree).cast("string").alias("tree_id"), F.col(node).cast("int").alias("node_id"),
            F.struct(F.col(loaded).alias("l"), F.col(parent).cast("int").alias("p"), F.sort_array(F.col(children).cast("array<int>")).alias("c")).alias("v"),
        )
        .groupBy("tree_id", "node_id").agg(F.max("v").alias("v"))
    )
    listed = kept.select("tree_id", "node_id", F.explode(F.array_distinct("v.c")).alias("child_id")).where("child_id is not null").withColumn("in_list", F.lit(True))
    linked = kept.select("tree_id", F.col("v.p").alias("node_id"), F.col("node_id").alias("child_id")).where("node_id is not null").withColumn("in_links", F.lit(True))
    linked = linked.join(kept.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")
    both = listed.join(linked, ["tree_id", "node_id", "child_id"], "full_outer").where("in_list is null or in_links is null")
    return both.select("tree_id", "node_id", "child_id", F.when(F.col("in_list"), "listed").otherwise("not listed").alias("problem"))
