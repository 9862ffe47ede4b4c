"""Filling containers of fixed capacity with texts, by the linear grouping scheme.

Sizes are whole numbers up to the capacity, so everything that has to be optimised is decided on counts by size, which
never grow with the data. Large sizes are rounded up within groups of equal cardinality; over the few rounded sizes a
linear program over container patterns is solved by column generation; its rounded-down solution, completed by best fit,
gives a number of containers for each pattern. Actual texts take the places of their group by rank. What is really left
in each container is counted, and the small texts fill it best-fit, again by counts. The texts themselves are only ever
ranked within their size and looked up in these plans.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm import tokenizers
from cladeworks.session import cut, salted_rank

SMALL, GROUPS, MAX_KINDS = 1 / 8, 24, 1000


def patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(items of each size, number of containers) that cover demand; sizes are few, none above capacity."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)  # a column is a pattern
    apart = need * (1 + 1e-9 * np.arange(1, k + 1))  # no two ratios tie, so each step lowers the cost and none comes again
    while True:
        worth = np.linalg.solve(basis.T, np.ones(k))
        new, value = _best_pattern(size, worth, capacity)
        if value <= 1 + 1e-9:
            break
        x, direction = np.linalg.solve(basis, apart), np.linalg.solve(basis, new)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    amount = np.floor(np.linalg.solve(basis, need) + 1e-9).clip(0)
    out = [(basis[:, j].astype(int).tolist(), int(amount[j])) for j in range(k) if amount[j] > 0]
    left = need - basis @ amount
    rooms: list[tuple[int, list[int]]] = []
    for g in sorted(range(k), key=lambda g: -sizes[g]):
        for _ in range(max(0, round(left[g]))):  # at most k patterns' worth of items
            fit = min((i for i, (room, _) in enumerate(rooms) if room >= sizes[g]), key=lambda i: rooms[i][0], default=None)
            if fit is None:
                rooms.append((capacity, [0] * k))
                fit = len(rooms) - 1
            room, held = rooms[fit]
            held[g] += 1
            rooms[fit] = (room - sizes[g], held)
    same: dict[tuple[int, ...], int] = defaultdict(int)
    for _, held in rooms:
        same[tuple(held)] += 1
    return out + [(list(p), n) for p, n in same.items()]


def _best_pattern(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of greatest worth: a knapsack by number of items, each step over all rooms at once."""
    best, steps = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):
        more, took = best.copy(), np.full(capacity + 1, -1)
        for j, s in enumerate(size.tolist()):
            value = best[: capacity + 1 - s] + worth[j]
            better = value > more[s:] + 1e-12
            more[s:][better], took[s:][better] = value[better], j
        if (took < 0).all():
            break
        steps.append(took)
        best = more
    new, room = np.zeros(len(size)), capacity
    for took in reversed(steps):
        j = int(took[room])
        if j >= 0:
            new[j] += 1
            room -= int(size[j])
    return new, float(best[capacity])


def plan_large(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[dict[int, int], list[tuple[int, int, int, int]], int]:
    """Where each large text goes: the first place of each size, runs (from place, to place, first container, texts of one
    group in a container) over the places, and the number of containers."""
    total = sum(counts.values())
    if not total:
        return {}, [], 0
    order = sorted(counts, reverse=True)
    first, at = {}, 0
    for s in order:
        first[s] = at
        at += counts[s]
    per = -(-total // groups)
    bounds = [(i, min(i + per, total)) for i in range(0, total, per)]
    starts = [first[s] for s in order]
    rounded = [order[int(np.searchsorted(starts, b, "right")) - 1] for b, _ in bounds]  # the greatest size in the group
    merged: dict[int, list[int]] = {}
    for (b, e), s in zip(bounds, rounded, strict=True):
        merged.setdefault(s, [b, e])[1] = e
    sizes = list(merged)
    cover = patterns(sizes, [merged[s][1] - merged[s][0] for s in sizes], capacity)
    runs, base, used = [], 0, {s: merged[s][0] for s in sizes}
    for held, n in cover:
        for g, c in enumerate(held):
            begin, end = used[sizes[g]], min(used[sizes[g]] + c * n, merged[sizes[g]][1])
            if c and end > begin:
                runs.append((begin, end, base, c))
                used[sizes[g]] = end
        base += n
    return first, sorted(runs), base


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by counts: runs (size, from rank, to rank, room class or -1 for new containers, first container's rank, texts each)."""
    open_: dict[int, deque] = defaultdict(deque)
    for r, n in rooms.items():
        if r > 0 and n > 0:
            open_[r].append((r, 0, n))
    levels = sorted(open_)
    runs, fresh = [], 0

    def put(room: int, segment: tuple[int, int, int]) -> None:
        if room > 0:
            if not open_[room]:
                levels.insert(int(np.searchsorted(levels, room)), room)
            open_[room].append(segment)

    for s in sorted((s for s in counts if s > 0), reverse=True):
        done, total = 0, counts[s]
        while done < total:
            i = int(np.searchsorted(levels, s))
            if i == len(levels):
                each = capacity // s
                n = max(1, (total - done) // each)
                take = min(total - done, n * each)
                each = each if take == n * each else take
                runs.append((s, done, done + take, -1, fresh, each))
                put(capacity - each * s, (-1, fresh, n))
                fresh += n
                done += take
                continue
            room = levels[i]
            origin, begin, n = open_[room].popleft()
            take = min(n, total - done)
            if take < n:
                open_[room].appendleft((origin, begin + take, n - take))
            elif not open_[room]:
                levels.pop(i)
            runs.append((s, done, done + take, origin, begin, 1))
            put(room - s, (origin, begin, take))
            done += take
    return runs


def sized_parts(docs: DataFrame, path: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tokens) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["i"].astype("Int64"), "tokens": tokenizers.count(path, [t if isinstance(t, str) else None for t in b["t"]])})

    cols = [F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")]
    return docs.select(*cols).mapInPandas(run, "doc_id long, tokens long")


def _placed(items: DataFrame, plan: dict[str, tuple[dict[int, int] | None, list]], schema: str) -> DataFrame:
    """Look each ranked item up in its kind's runs; plan holds no more than sizes and patterns do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, part in b.groupby("container_kind"):
                first, runs = plan[kind]
                part = part.copy()
                if first is not None:  # large: places over all sizes
                    place = part["size"].map(first).to_numpy() + part["rank"].to_numpy()
                    table = np.array(runs, np.int64)
                    row = table[np.searchsorted(table[:, 0], place, "right") - 1]
                    part["container_id"] = row[:, 2] + (place - row[:, 0]) // row[:, 3]
                    yield part[["container_kind", "doc_id", "part", "size", "container_id"]]
                else:
                    for s, rows in part.groupby("size"):
                        table = np.array([r[1:] for r in runs if r[0] == s], np.int64)
                        place = rows["rank"].to_numpy()
                        row = table[np.searchsorted(table[:, 0], place, "right") - 1]
                        rows = rows.assign(room=row[:, 2], nth=row[:, 3] + (place - row[:, 0]) // row[:, 4])
                        yield rows[["container_kind", "doc_id", "part", "size", "room", "nth"]]

    return items.select("container_kind", "doc_id", "part", "size", "rank").mapInPandas(run, schema)


def pack(
    docs: DataFrame, containers: DataFrame, tokenizer: str | None = None, groups: int = GROUPS, small: float = SMALL,
    doc_id: str = "doc_id", text: str = "text", kind: str = "container_kind", capacity: str = "capacity",
) -> DataFrame:
    """(container_kind, capacity, container_id, doc_id, part, tokens): every text in a container of each kind.

    A text larger than the capacity is cut into parts: as many full ones as it fills, each a container of its own, and
    the rest, packed like a text. Smaller texts are never cut. Texts without tokens (null and empty ones) take no room
    and lie in container 0. Containers are numbered from 0 within a kind. Kinds without a name or with a capacity below 1
    are ignored; of a kind listed twice the largest capacity holds; at most MAX_KINDS kinds are accepted. Every row of
    docs is a text of its own, also where doc_ids repeat or are null. An empty table gives an empty result.
    """
    rows = containers.where(F.col(kind).isNotNull() & (F.col(capacity) >= 1)).groupBy(kind).agg(F.max(capacity)).limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    caps = {str(r[0]): int(r[1]) for r in sorted(rows, key=lambda r: str(r[0]))}
    spark = docs.sparkSession
    schema = "container_kind string, capacity int, container_id long, doc_id long, part int, tokens int"
    if not caps:
        return spark.createDataFrame([], schema)
    sized = cut(sized_parts(docs, tokenizer or tokenizers.default_path(), doc_id, text))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in caps.items()])
    each = sized.select("doc_id", "tokens", F.explode(kinds).alias("kind")).select(
        F.col("kind.k").alias("container_kind"), F.col("kind.c").cast("long").alias("c"), "doc_id", "tokens"
    )
    full = F.floor(F.col("tokens") / F.col("c")).cast("int")
    parts = each.select(
        "container_kind", "c", "doc_id", full.alias("full"), (F.col("tokens") - full * F.col("c")).cast("int").alias("rest")
    )
    rest = parts.select("container_kind", "doc_id", F.col("full").alias("part"), F.col("rest").alias("size"), "full").where("size > 0 or full = 0").drop("full")
    whole = parts.where("full > 0").select("container_kind", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))

    counts: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in rest.groupBy("container_kind", "size").count().collect():  # at most the sum of the capacities
        counts[r[0]][r[1]] = r[2]
    bound = {k: max(1, int(c * small)) for k, c in caps.items()}
    large = {k: {s: n for s, n in counts[k].items() if s > bound[k]} for k in caps}
    little = {k: {s: n for s, n in counts[k].items() if 0 < s <= bound[k]} for k in caps}
    limit = F.create_map(*[x for k in caps for x in (F.lit(k), F.lit(bound[k]))])[F.col("container_kind")]
    plan = {k: plan_large(large[k], caps[k], groups) for k in caps}

    order = ["doc_id", "part"]
    place = "container_kind string, doc_id long, part int, size int, container_id long"
    ranked = salted_rank(rest.where("size > 0"), ["container_kind", "size"], order, "rank")
    ranked = cut(ranked)
    big = cut(_placed(ranked.where(F.col("size") > limit), {k: p[:2] for k, p in plan.items()}, place))
    used = big.groupBy("container_kind", "container_id").agg(F.sum("size").alias("used"))
    caps_of = F.create_map(*[x for k, c in caps.items() for x in (F.lit(k), F.lit(c))])[F.col("container_kind")]
    rooms = cut(used.select("container_kind", "container_id", (caps_of - F.col("used")).cast("int").alias("room")))
    free: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in rooms.groupBy("container_kind", "room").count().collect():  # at most the sum of the capacities
        free[r[0]][r[1]] = r[2]
    fill = {k: (None, plan_small(little[k], free[k], caps[k])) for k in caps}
    looked = _placed(ranked.where(F.col("size") <= limit), fill, "container_kind string, doc_id long, part int, size int, room int, nth long")
    nth = salted_rank(rooms, ["container_kind", "room"], ["container_id"], "nth")
    old = looked.where("room >= 0").join(nth, ["container_kind", "room", "nth"]).select("container_kind", "doc_id", "part", "size", "container_id")
    after_large = F.create_map(*[x for k in caps for x in (F.lit(k), F.lit(plan[k][2]).cast("long"))])[F.col("container_kind")]
    new = looked.where("room < 0").select("container_kind", "doc_id", "part", "size", (after_large + F.col("nth")).alias("container_id"))
    opened = {k: plan[k][2] + max((r[4] + -(-(r[2] - r[1]) // r[5]) for r in fill[k][1] if r[3] < 0), default=0) for k in caps}
    so_far = F.create_map(*[x for k in caps for x in (F.lit(k), F.lit(opened[k]).cast("long"))])[F.col("container_kind")]
    own = salted_rank(whole, ["container_kind"], order, "rank").select(
        "container_kind", "doc_id", "part", caps_of.cast("int").alias("size"), (so_far + F.col("rank")).alias("container_id")
    )
    empty = rest.where("size = 0").select("container_kind", "doc_id", "part", "size", F.lit(0).cast("long").alias("container_id"))
    out = big.unionByName(old).unionByName(new).unionByName(own).unionByName(empty)
    return out.select("container_kind", caps_of.cast("int").alias("capacity"), "container_id", "doc_id", "part", F.col("size").alias("tokens"))


def fill_rates(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, tokens, fill) of a packing."""
    each = packed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("tokens").alias("t"))
    return each.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * F.col("capacity"))).alias("fill")
    )
