"""Sequence operators against brute force on small tables, hot paths included."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict

import pytest

from cladeworks.llm import near_duplicates as nd
from cladeworks.llm import shared_spans as ss
from cladeworks.llm import term_frequencies as tf
from cladeworks.operators.components import components
from cladeworks.session import shared_folder

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "record_id long, residues string, loaded_at timestamp_ntz, letters string, rep long, key long, term string"


def table(spark, rows):
    return spark.createDataFrame([(i, r, T0 + dt.timedelta(days=d), "clash", 1, 2, "t") for i, r, d in rows], SCHEMA)


def family(rng, n, length, edits, letters="ACGT"):
    base = "".join(rng.choice(letters) for _ in range(length))
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k, what = rng.randrange(len(s)), rng.randrange(4)
            if what == 0:
                s[k] = rng.choice(letters)
            elif what == 1:
                del s[k]
            elif what == 2:
                s.insert(k, rng.choice(letters))
            else:
                j = rng.randrange(len(s))
                s = s[min(j, k) :] + s[: min(j, k)] if abs(j - k) < 3 else s
        out.append("".join(s))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [x for _ in range(8) for x in family(rng, 6, rng.randrange(60, 220), 9)]
    texts += [x for _ in range(4) for x in family(rng, 5, 150, 8, "ARNDCQEGHILKMFPSTWYV")]
    texts += [texts[0]] * 12 + ["acg-t_g*" * 9, "ACG", "", None, "A" * 45, "A" * 60, "AÄ" * 30, "x" + texts[3], texts[4][:39], texts[5][:40], texts[5] + texts[9]]
    out = [(i * 7 + 3, t, 0) for i, t in enumerate(texts)]
    out += [(out[5][0], out[5][1], 3), (out[6][0], "ACGTTTGA" * 20, -1), (None, texts[1], 0)]
    return out


def letters(rows):
    best = {}
    for i, r, d in rows:
        if i is not None and (i not in best or (d, r or "") > best[i][:2]):
            best[i] = (d, r or "")
    return {i: v[1].upper().translate(str.maketrans("", "", "-_*")) for i, v in best.items()}


def near(recs):
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in recs.items() if len(t) >= 30}
    return {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


@pytest.mark.parametrize("run_cap", [128, 3])
def test_near_duplicates(spark, rows, run_cap):
    found, members = nd.near_duplicates(table(spark, rows), run_cap=run_cap)
    got = [tuple(r) for r in nd.pairs_of_records(found, members).collect()]
    assert len(got) == len(set(got)) and set(got) == near(letters(rows))


def test_blocks_pair_everything(spark):
    hot = spark.range(50).selectExpr("id % 2 as key", "id as rep")
    got = {tuple(sorted(r)) for r in nd._blocks(hot, 6).collect()}
    assert got == {(a, b) for a in range(50) for b in range(a + 1, 50) if (a - b) % 2 == 0}


def test_groups(spark, rows):
    out = {r.record_id: (r.group_id, r.links) for r in nd.groups(*nd.near_duplicates(table(spark, rows))).collect()}
    recs = letters(rows)
    assert set(out) == {i for i, t in recs.items() if len(t) >= 30}
    pairs = near(recs)
    assert all(out[a][0] == out[b][0] for a, b in pairs)
    assert len({g for g, _ in out.values()}) == len(out) - len(_forest(out, pairs))


def _forest(nodes, pairs):
    boss = {i: i for i in nodes}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    used = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            boss[x] = y
            used.append((a, b))
    return used


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 100: 100, 101: 100}


def test_terms(spark, rows):
    recs = letters(rows)
    occ, docs = Counter(), defaultdict(set)
    for i, t in recs.items():
        for k in range(len(t) - 3):
            occ[t[k : k + 4]] += 1
            docs[t[k : k + 4]].add(i)
    mark = lambda n: "rare" if n <= 2 else "common" if n >= 0.25 * len(recs) else None
    got = {r.term: (r.occurrences, r.records, r.mark) for r in tf.term_frequencies(table(spark, rows)).collect()}
    assert got == {t: (occ[t], len(docs[t]), mark(len(docs[t]))) for t in occ}


def test_long_record_is_one_record(spark):
    """A record of more than one piece counts once for each of its terms."""
    rng = random.Random(6)
    long = "".join(rng.choice("ACGT") for _ in range(tf.PIECE * 2 + 5000)) + "WWWWW"
    got = {r.term: (r.occurrences, r.records) for r in tf.term_counts(spark.createDataFrame([(5, long), (4, "ACGTWWWW"), (6, "acÄß")], "record_id long, letters string")).collect()}
    want = Counter(long[k : k + 4] for k in range(len(long) - 3))
    assert got["WWWW"] == (3, 2) and got["acÄß"] == (1, 1) and got["ACGT"] == (want["ACGT"] + 1, 2)
    assert all(got[t] == (n, 1) for t, n in want.items() if t not in ("ACGT", "WWWW"))


def test_last_seen():
    c = tf.LastSeen()
    for x in ((1, 9, 12, 4), (5, 5, 3, 1), (5, 5, 1, 1), (6, 6, 1, 1)):
        c.add(*x)
    assert (c.occurrences, c.records) == (17, 6)


@pytest.mark.parametrize("block", [1024, 2])
def test_copies_are_paired_in_cells(spark, block):
    members = spark.createDataFrame([(i, i // 7 * 7) for i in range(30)], "record_id long, rep long")
    links = spark.createDataFrame([(0, 7), (21, 28)], "a long, b long")
    got = [tuple(r) for r in nd.pairs_of_records(links, members, block).collect()]
    own = lambda i: i // 7
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if own(a) == own(b) or (own(a), own(b)) in ((0, 1), (3, 4))}
    assert len(got) == len(set(got)) and set(got) == want


def shared(recs, span):
    owners = defaultdict(set)
    for i, t in recs.items():
        for k in range(len(t) - span + 1):
            owners[t[k : k + span]].add(i)
    out = set()
    for i, t in recs.items():
        hit = [False] * len(t)
        for k in range(len(t) - span + 1):
            if len(owners[t[k : k + span]]) > 1:
                hit[k : k + span] = [True] * span
        k = 0
        while k < len(t):
            if hit[k]:
                j = k
                while j < len(t) and hit[j]:
                    j += 1
                out.add((i, k, j))
                k = j
            k += 1
    return out


@pytest.mark.parametrize("span, shard", [(40, 4096), (40, 1), (12, 4096), (12, 2)])
def test_shared_spans(spark, rows, span, shard):
    spans, recs = ss.shared_spans(table(spark, rows), span, shard)
    got = [tuple(r) for r in spans.collect()]
    want = shared(letters(rows), span)
    assert len(got) == len(set(got)) and set(got) == want
    left = {r.record_id: r.letters for r in ss.without_shared(spans, recs).collect()}
    gone = defaultdict(set)
    for i, a, b in want:
        gone[i] |= set(range(a, b))
    assert left == {i: "".join(c for k, c in enumerate(t) if k not in gone[i]) for i, t in letters(rows).items()}
    share = {r.record_id: (r.letters, r.shared) for r in ss.shared_share(spans, recs).collect()}
    sums = Counter()
    for i, a, b in want:
        sums[i] += b - a
    assert share == {i: (len(t), sums[i]) for i, t in letters(rows).items()}


def test_automaton():
    a = ss.Automaton()
    for text, owner in (("abcabx", 1), ("xabcab", 2), ("zzzz", 3)):
        a.add(text, owner, owner)
    a.close()
    assert a.shared("abcabx", 5) == [(0, 5)] and a.shared("xabcab", 5) == [(1, 6)] and a.shared("zzzz", 2) == []


def test_empty_tables(spark):
    none = table(spark, [])
    assert nd.pairs_of_records(*nd.near_duplicates(none)).count() == 0
    assert nd.groups(*nd.near_duplicates(none)).count() == 0
    assert tf.term_frequencies(none).count() == 0
    spans, recs = ss.shared_spans(none)
    assert spans.count() == 0 and ss.shared_share(spans, recs).count() == 0


def test_hot_anchor_is_refined(spark):
    """Records that share one low-complexity stretch only are not paired through it."""
    rng = random.Random(9)
    texts = ["A" * 40 + "".join(rng.choice("CGT") for _ in range(90)) for _ in range(60)]
    texts += [texts[0][:-3] + "C", texts[1] + "G"]
    recs = dict(enumerate(texts))
    reps = spark.createDataFrame(list(recs.items()), "rep long, letters string")
    assert {tuple(r) for r in nd.candidates(reps, 8).collect()} >= near(recs)
    assert nd.candidates(reps, 8).count() < 60 * 59 / 4
    assert {(r.a, r.b) for r in nd.links(reps, run_cap=8).collect()} == near(recs)


def test_hot_variant_loses_no_link(spark):
    """More than run_cap records whose only common anchor is the hot one are paired all the same."""
    rng = random.Random(4)
    texts = ["A" * n for n in range(30, 44)] + ["A" * 30 + "".join(rng.choice("CGT") for _ in range(5)) for _ in range(12)]
    recs = dict(enumerate(texts))
    reps = spark.createDataFrame(list(recs.items()), "rep long, letters string")
    want = near(recs)
    assert len(want) > 14 * 13 / 2 and {(r.a, r.b) for r in nd.links(reps, run_cap=8).collect()} == want


def test_candidates_are_sifted_without_loss(spark):
    """Bit maps keep every pair of the threshold's similarity, texts of any length and letters included, and drop others."""
    rng = random.Random(11)
    texts = []
    for size in (30, 60, 200, 700, 3000):
        text = "".join(rng.choice("ACGTé") for _ in range(size))
        texts += [text, text[: size * 3 // 4], "".join(c if rng.random() > 0.03 else "N" for c in text), "".join(rng.choice("ACGT") for _ in range(size))]
    texts += ["A" * 40, "A" * 400]
    reps = spark.createDataFrame(list(enumerate(texts)), "rep long, letters string")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    kept = {(r.a, r.b) for r in nd._may_link(spark.createDataFrame(pairs, "a long, b long"), reps, 0.5, 8).collect()}
    terms = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    linked = {(a, b) for a, b in pairs if 2 * len(terms[a] & terms[b]) >= len(terms[a] | terms[b])}
    assert len(linked) >= 10 and linked <= kept and len(kept) < len(pairs) / 2


def test_variants_are_made_and_shuffled_in_parts(spark):
    """Parts of the fingerprints have the variants of the whole, and leave no table but that of the candidates."""
    rng = random.Random(5)
    texts = family(rng, 12, 120, 6) + ["A" * n for n in range(30, 42)]
    reps = spark.createDataFrame(list(enumerate(texts)), "rep long, letters string")
    far = reps.selectExpr("rep * 5000000000 as rep", "letters")
    keys = lambda x, some, n: sorted(
        (r.part, k, w + r.base) for r in nd.emit(x, 3, some).collect() for k, w in zip(memoryview(r.keys).cast("I"), memoryview(r.reps).cast(n), strict=True)
    )
    whole = keys(reps, range(nd.FINGERPRINTS), "I")
    assert len(whole) == len(texts) * 72 and whole == sorted(x for i in range(0, nd.FINGERPRINTS, 3) for x in keys(reps, range(i, i + 3), "I"))
    assert [(p, k, w * 5000000000) for p, k, w in whole] == keys(far, range(nd.FINGERPRINTS), "Q")
    pairs = [{tuple(r) for r in nd._meet_packed(nd.emit(reps, 3), cap, most).collect()} for cap in (8, 99) for most in (1 << 22, 40)]
    assert pairs[2] == pairs[3] and {x[:2] for x in pairs[0]} == {x[:2] for x in pairs[1]} and pairs[0] != pairs[2]
    tables = lambda: {f for f in os.listdir(shared_folder(spark)) if f.startswith("cladeworks-")}
    before = tables()
    met = nd.candidates(reps, 8)
    assert len(tables() - before) == 1 and {tuple(r) for r in met.collect()} >= near(dict(enumerate(texts)))
