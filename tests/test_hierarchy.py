import math
import random

import pytest

from cladeworks.operators import hierarchy as h

SCHEMA = "tree_id string, node_id int, parent_id int, blen double, loaded_at timestamp_ntz, root string, path string"


def table(spark, rows):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(*r[:4], t0 + dt.timedelta(days=r[4]) if r[4] is not None else None, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    force = {}
    for t, n, p, b, l in rows:
        if t is None or n is None:
            continue
        key = (l is not None, l or 0, p is not None, p or 0, b is not None, b or 0)
        if (t, n) not in force or key > force[t, n][0]:
            force[t, n] = (key, p, b)
    out = {}
    for (t, n), _ in force.items():
        way, x = [], n
        while x is not None and (t, x) in force and x not in way:
            way.append(x)
            x = force[t, x][1]
        if x is not None and x in way:
            ring = way[way.index(x) :]
            out[t, n] = (None, None, None, tuple(reversed(way[: way.index(x)])), min(ring))
        else:
            good = lambda b: 0.0 if b is None or math.isnan(b) else b
            out[t, n] = (way[-1], len(way), round(sum(good(force[t, y][2]) for y in way), 6), tuple(reversed(way)), None)
    return out


def rows_of(found):
    return {(r.tree_id, r.node_id): (r.root, r.levels, None if r.blen_sum is None else round(r.blen_sum, 6), tuple(r.path), r.cycle_node) for r in found.collect()}


CASES = [
    ("a", 1, None, 0.5, 0), ("a", 2, 1, None, 0), ("a", 3, 2, -1.0, 0), ("a", 3, 1, 2.0, 1), ("a", 4, 99, 1.0, 0), ("a", 5, 4, float("nan"), 0),
    ("b", 1, 2, 1.0, 0), ("b", 2, 3, 1.0, 0), ("b", 3, 2, 1.0, 0), ("b", 4, 1, 1e5, 0), ("b", 7, 7, 1.0, 0), ("b", 8, 7, 1.0, None),
    ("a", 2, 1, None, 0), ("c", -1, -1, 1.0, 0), ("c", 0, -1, 1.0, 0), (None, 1, 1, 1.0, 0), ("d", None, 1, 1.0, 0), ("d", 1, 2, 1.0, 0),
]


@pytest.mark.parametrize("chunk", [10_000, 2])
def test_small_cases(spark, chunk):
    assert rows_of(h.hierarchy(table(spark, CASES), chunk=chunk)) == brute(CASES)


def forest(seed):
    rng = random.Random(seed)
    rows = [("t", i, rng.choice([rng.randrange(60), None, i - 1, i - 1]), rng.random(), 0) for i in range(60)]
    rows += [("u", i, i - 1, 1.0, 0) for i in range(40)]
    ids = rng.sample(range(-500, 500), 50)  # a circle of 20 with trees, ids in no order
    rows += [("v", ids[i], ids[(i + 1) % 20] if i < 20 else ids[rng.randrange(i)], 0.5, 0) for i in range(50)]
    return rows


@pytest.mark.parametrize("seed, chunk", [(5, 8192), (5, 7), (6, 3)])
def test_random_forest_in_chunks(spark, seed, chunk):
    rows = forest(seed)
    found = h.hierarchy(table(spark, rows), chunk=chunk).collect()
    assert {(r.tree_id, r.node_id): (r.root, r.levels, None if r.blen_sum is None else round(r.blen_sum, 6), tuple(r.path), r.cycle_node) for r in found} == brute(rows)
    boss = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for t, n, p, *_ in rows:
        if (t, p) in boss:
            a, b = sorted((find((t, n)), find((t, p))))
            boss[b] = a
    assert {(r.tree_id, r.node_id): r.component for r in found} == {x: find(x)[1] for x in boss}


def test_long_chain(spark):
    """A chain of many chunks: paths are emitted as they are walked."""
    rows = spark.range(5000).selectExpr("'t' tree_id", "cast(id as int) node_id", "cast(id - 1 as int) parent_id", "1.0D blen", "timestamp_ntz'2024-01-01' loaded_at")
    got = h.hierarchy(rows, chunk=512).selectExpr("max(levels) l", "sum(size(path)) s", "min(component) c", "max(root) r").first()
    assert tuple(got) == (5000, 5000 * 5001 // 2, 0, 0)


def test_circles_and_descendants(spark):
    got = {tuple(r) for r in h.on_or_below_circles(table(spark, CASES)).collect()}
    assert got == {(t, n, v[4]) for (t, n), v in brute(CASES).items() if v[4] is not None}
    below = {tuple(r) for r in h.descendants(h.hierarchy(table(spark, CASES))).collect()}
    want = {(t, a, n) for (t, n), v in brute(CASES).items() for a in v[3] if a != n}
    assert below == want | {(t, v[4], n) for (t, n), v in brute(CASES).items() if v[4] not in (None, n)}
    closing = {tuple(r) for r in h.back_edges(table(spark, CASES)).collect()}
    assert closing == {("b", 3, 2), ("b", 7, 7), ("c", -1, -1)}


def test_child_lists(spark):
    schema = "tree_id string, node_id int, parent_id int, children array<int>, loaded_at string, problem string"
    rows = [("t", 1, None, [2, 3, None, 3], "a", "x"), ("t", 2, 1, None, "a", ""), ("t", 3, 2, [], "a", ""), ("t", 3, 1, [9], "0", ""), (None, 1, 1, [1], "a", "")]
    got = {tuple(r) for r in h.child_list_problems(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("t", 1, 3, "listed"), ("t", 2, 3, "not listed")}


def test_empty(spark):
    assert h.hierarchy(table(spark, [])).count() == 0
    assert h.descendants(h.hierarchy(table(spark, []))).count() == 0
