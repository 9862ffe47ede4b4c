"""Text operators: packing invariants, leakage against brute force, labelled stuffed texts, edge cases."""

import random
import unicodedata
from collections import defaultdict

import pytest
import regex

from cladeworks.llm import leakage, packing, stuffing, tokenizers

WORDS = "the lid of my old kettle is fine and it was easy to clean after ten weeks in a small flat by the lake".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, container_kind string, tokens int, word string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 8, 20, 40, 90])))) for i in range(150)]
    rows += [(200 + i, "same text " * 6) for i in range(60)] + [(300, None), (301, ""), (302, "x " * 3000), (None, "no id here"), (200, "same text " * 6)]
    return rows


@pytest.mark.parametrize("caps", [[("a", 16), ("b", 64), ("c", 2048), ("a", 8), (None, 5), ("z", 0)], [("tiny", 1)]])
def test_packing(spark, texts, caps):
    kinds = spark.createDataFrame(caps, "container_kind string, capacity int")
    got = packing.pack(docs_of(spark, texts), kinds).toPandas()
    sizes = [n for n in tokenizers.count(tokenizers.default_path(), [t for _, t in texts])]
    for kind, cap in {k: max(c for x, c in caps if x == k) for k, c in caps if k and c > 0}.items():
        mine = got[got.container_kind == kind]
        fill = mine.groupby("container_id").tokens.sum()
        assert fill.max() <= cap and mine.tokens.sum() == sum(sizes)
        assert sorted(fill.index) == list(range(len(fill)))
        assert len(mine) == sum(1 if n <= cap else -(-n // cap) for n in sizes)
        assert len(fill) <= 1.25 * sum(sizes) / cap + 2


def test_packing_plans():
    first, runs, n = packing.plan_large({70: 100, 60: 40, 45: 80, 30: 60}, 100, 3)
    places = [range(b, e) for b, e, _, _ in runs]
    assert sorted(p for r in places for p in r) == list(range(280)) and first[70] == 0 and n < 280
    small = packing.plan_small({5: 30, 3: 7, 2: 100}, {7: 4, 1: 9}, 10)
    for s, c in ((5, 30), (3, 7), (2, 100)):
        assert sum(e - b for z, b, e, *_ in small if z == s) == c


def test_patterns_are_optimal():
    """As many containers as the linear bound over all patterns, rounded up per size, allows; large capacities too."""
    for sizes, demand, capacity in (([70, 50, 30], [97, 101, 203], 100), ([501, 334, 251, 126], [90, 90, 90, 90], 1000), ([400_001, 300_000, 199_999], [7, 11, 13], 1_000_000)):
        got = packing.patterns(sizes, demand, capacity)
        assert all(sum(c * s for c, s in zip(p, sizes)) <= capacity for p, _ in got)
        assert [sum(p[j] * n for p, n in got) >= demand[j] for j in range(len(sizes))] == [True] * len(sizes)
        assert sum(n for _, n in got) <= -(-sum(s * d for s, d in zip(sizes, demand)) // capacity) * 1.35 + len(sizes)
    new, value = packing._best_pattern(packing.np.array([7, 5, 3]), packing.np.array([0.71, 0.49, 0.3]), 13)
    assert round(value, 9) == round(max(0.71 * a + 0.49 * b + 0.3 * c for a in range(2) for b in range(3) for c in range(5) if 7 * a + 5 * b + 3 * c <= 13), 9)
    assert new @ [7, 5, 3] <= 13


def test_packing_empty(spark):
    kinds = spark.createDataFrame([("a", 10)], "container_kind string, capacity int")
    assert packing.pack(docs_of(spark, []), kinds).count() == 0
    assert packing.pack(docs_of(spark, [(1, "a b")]), kinds.limit(0)).count() == 0


def brute_leaks(docs, items, n=10):
    word = regex.compile(r"[\p{L}\p{N}]+")
    words = lambda t: word.findall(unicodedata.normalize("NFKC", t or "").lower())
    held = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    return {(d, e) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - n + 1) for e in held.get(tuple(w[k : k + n]), ()) if e is not None}


@pytest.mark.parametrize("words, block", [(300_000, 1_000_000), (3, 40)])
def test_leaks(spark, monkeypatch, words, block):
    monkeypatch.setattr(leakage, "BROADCAST_WORDS", words)
    monkeypatch.setattr(leakage, "BLOCK", block)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS + ["Ünïcode", "x²", "ﬁsh", "don't"]) for _ in range(n))
    items = [(i, text(rng.choice([4, 10, 14, 40]))) for i in range(12)] + [(50, None), (51, ""), (None, text(20)), (52, "a b " * 8)]
    docs = [(i, text(30)) for i in range(30)]
    for i in range(12):
        w = items[i][1].split()
        docs.append((100 + i, text(5) + ",\n<b>" + "; ".join(w[: rng.choice([9, 10, 11, 40])]).upper() + "</b> " + text(5)))
    docs += [(200, None), (201, ""), (None, items[2][1]), (202, "a b " * 300), (100, text(12)), (203, items[1][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, shingle int")
    found = leakage.leaks(frame, spark.createDataFrame([(i, t, 1) for i, t in items], "eval_id long, item_text string, word int"))
    got = [(r.doc_id, r.eval_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)
    rows = found.collect()
    assert all(0 < r.containment <= 1 for r in rows)
    windows = brute_windows(docs, items)
    assert {(r.doc_id, r.eval_id): (r.shared_shingles, r.item_shingles) for r in rows} == windows
    half = leakage.leaks(frame, spark.createDataFrame([(i, t) for i, t in items], "eval_id long, item_text string"), share=0.5)
    assert {(r.doc_id, r.eval_id) for r in half.collect()} == {k for k, (a, b) in windows.items() if 2 * a >= b}


def brute_windows(docs, items, n=10):
    """Shingles in the best item-sized window, and of the item."""
    best = {}
    for d, t in docs:
        w = leakage.words_of(t)
        for e, x in items:
            v = leakage.words_of(x)
            for start in range(-len(v), len(w)) if d is not None and e is not None else ():
                same = [0 <= start + j < len(w) and w[start + j] == v[j] for j in range(len(v))]
                k = sum(all(same[j : j + n]) for j in range(len(v) - n + 1))
                if k and k / (len(v) - n + 1) > best.get((d, e), (0, 1))[0] / best.get((d, e), (0, 1))[1]:
                    best[d, e] = (k, len(v) - n + 1)
    return best


def test_prefix():
    assert leakage.prefix_places([5, 1, 9, 9, 2, 9], 3, 2) == [(0, 1), (1, 1)]
    assert leakage.prefix_places([5, None, 9, 9, 2], 3, 3) == [(2, 4)]
    assert leakage.prefix_places([5, 5], 3, 3) == []


def test_long_items(spark):
    """Items of more than a segment are found whole and in part."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(3000)}" for _ in range(leakage.SEGMENT * 2 + 500)]
    docs = docs_of(spark, [(1, " ".join(["x", *long, "y"])), (2, " ".join(long[4000:4300])), (3, " ".join(long[::2]))])
    items = spark.createDataFrame([(7, " ".join(long))], "eval_id long, item_text string")
    got = {r.doc_id: (r.shared_shingles, r.item_shingles) for r in leakage.leaks(docs, items).collect()}
    assert got == {1: (len(long) - 9, len(long) - 9), 2: (291, len(long) - 9)}


def test_leaks_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "eval_id long, item_text string")
    assert leakage.leaks(docs, items).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0


STUFFED = [
    "kettle buy best kettle hinvo best buy kettle sale best kettle buy hinvo sale best kettle buy sale kettle buy kettle buy best",
    "Best Kettle, Original Kettle Deal, Top Bike Pump, Outlet Bike Pump, Discount Kettle, Sale Kettle",
    "#kettle #toaster #officechair #headset #gardenhose #cheap #keyboard #sale #bikepump",
    "#sale #deal #cheap",
    "http://a.test/b",
    "It is fine.\n1. price wall clock: http://a.test/go/1\n2. cheap tent: www.b.invalid/p/2\n3. top lamp: [set](https://c.test/3)",
    "hxxp://a[.]test/p/1 | korvo dot example / go / 12 | <a href='https://x.test/cat/1'>tent offer</a>",
    " funda XL |  juego de destornilladores 77cm | Drequin esterilla 12V |  silla de oficina LEM121 |  filtro de agua mejor",
]
FINE = [
    "Five stars from me", "Love it", "gut", "", None, "...", "Great buy - garden hose", "Very, very happy with it!",
    "The lid is fine. The lid is fine. The lid is fine. The lid is fine. The lid is fine and the lid is fine.",
    "My father tried it in the kitchen and wants one too. http://base.example/pic/94 The handle is solid, and the cable is quiet as well.",
    "* Ich nutze es meistens im Garten.\n+ Der Akku ist schief, und der Händler meldet sich nicht.\n- Im Karton liegen zwölf kleine Teile.",
    "LA BOÎTE CONTIENT DOUZE PETITES PIÈCES. POUR CE PRIX, LE CÂBLE EST SOLIDE.",
    "L'ho usata per tre settimane in montagna. La maniglia si è rotta subito e il venditore non risponde",
    "kupiłem go dla mojej siostry i jest bardzo zadowolona. Działa cicho, a kabel jest dość długi",
    "De levering duurde twee weken. Het handvat voelt stevig aan en mijn buurman wil er ook een",
    '<span style="' + "color: red; " * 60 + '">It arrived early and works well.</span>',
]


def test_stuffed(spark):
    """Shapes alone decide these, in languages the collection has never seen."""
    rows = [(i, t) for i, t in enumerate(STUFFED + FINE)]
    got = {r.doc_id: r.stuffed for r in stuffing.judge(docs_of(spark, rows)).collect()}
    assert [i for i, _ in rows if got[i] != (i < len(STUFFED))] == []
    assert stuffing.judge(docs_of(spark, [])).count() == 0
    shapes = stuffing.corpus_shapes(docs_of(spark, rows)).collect()
    assert sum(r.words for r in shapes) == sum(r.words for r in stuffing.judge(docs_of(spark, rows)).collect())


def test_words_learned_from_shapes(spark):
    """In an invented language, what stands in tag lists is told apart from what stands in sentences."""
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(k))
    nouns, offers, glue, verbs = ([word(k) for _ in range(n)] for k, n in ((3, 30), (2, 12), (1, 14), (3, 40)))

    def sentence():
        own = [rng.choice(glue), rng.choice(nouns), rng.choice(verbs), rng.choice(glue), rng.choice(verbs), rng.choice(glue), rng.choice(verbs)]
        return (" ".join(own)).capitalize() + "."

    pair = lambda: f"{rng.choice(offers)} {rng.choice(nouns)}"
    rows = [(i, " ".join(sentence() for _ in range(5))) for i in range(300)]
    rows += [(1000 + i, " | ".join(pair() for _ in range(12))) for i in range(40)]
    rows += [(2000 + i, " ".join(pair() for _ in range(6))) for i in range(40)]  # no separators, no repeats, no links
    rows += [(3000 + i, " ".join(sentence() for _ in range(3)).lower().replace(".", "")) for i in range(40)]  # no full stops
    got = {r.doc_id: r.stuffed for r in stuffing.judge(docs_of(spark, rows)).collect()}
    assert {i for i, s in got.items() if s} == {i for i, _ in rows if 1000 <= i < 3000}


def test_long_text():
    assert sum(len(w) for _, _, w in stuffing.pieces("kettle sale " * 200_000)) == 400_000
