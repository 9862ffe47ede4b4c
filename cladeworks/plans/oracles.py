"""SQL of the likelihood, joining and tree-order queries: constants worked out here from the models' definitions."""

from __future__ import annotations

import numpy as np

from cladeworks.functions import protein_tables

PROTEIN_ORDER = "ARNDCQEGHILKMFPSTWYV"
GTR_FREQS, GTR_RATES = [0.22, 0.26, 0.33, 0.19], [1.2, 1.1, 1.0, 1.1, 1.5, 1.4]  # T C A G; TC TA TG CA CG AG
INDEL_RATE = 1.5


def _decomposed(exchange: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(t) = u diag(exp(lam t)) v of the rate matrix that makes one change per unit of time."""
    q = exchange * freqs
    q -= np.diag(q.sum(1))
    q /= -np.diag(q) @ freqs
    lam, u = np.linalg.eig(q)
    return u.real, lam.real, np.linalg.inv(u).real


def _symmetric(n: int, values: dict[tuple[int, int], float]) -> np.ndarray:
    m = np.zeros((n, n))
    for (i, j), x in values.items():
        m[i, j] = m[j, i] = x
    return m


def gtr() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    return _symmetric(4, dict(zip(pairs, GTR_RATES, strict=True))), np.array(GTR_FREQS)


def equal() -> tuple[np.ndarray, np.ndarray]:
    return np.ones((4, 4)) - np.eye(4), np.full(4, 0.25)


def wag() -> tuple[np.ndarray, np.ndarray]:
    rows = protein_tables.WAG.split("\n")[1:]
    values = {(i, j): float(x) for i, r in enumerate(rows, 1) for j, x in enumerate(r.split())}
    return _symmetric(20, values), np.array(protein_tables.WAG_FREQS.split(), float)


def _sql(x) -> str:
    return "[" + ", ".join(_sql(v) for v in x) + "]" if isinstance(x, (list, np.ndarray)) else f"{float(x)!r}::DOUBLE"


def _eigen(dna: tuple, protein: tuple) -> str:
    def row(flag: str, n: int, model: tuple) -> str:
        u, lam, v = _decomposed(model[0].copy(), model[1])
        return f"({flag}, {n}, {_sql(u)}, {_sql(lam)}, {_sql(v.T)}, {_sql(model[1])})"

    return f"eig(dna, n, u, lam, vt, pi) AS (VALUES {row('true', 4, dna)}, {row('false', 20, protein)})"


def _nodes(dna: tuple, protein: tuple) -> str:
    """deep: depth, parent, branch length and transition matrix m of every node of the aligned trees."""
    return f"""{_eigen(dna, protein)},
deep AS MATERIALIZED (
  SELECT w.tree_id, w.node_id, w.levels AS depth, l.up, n.b, e.n, e.pi,
    list_transform(e.u, lambda r: list_transform(e.vt, lambda c: list_sum(list_transform(range(1, e.n + 1), lambda k: r[k] * c[k] * exp(e.lam[k] * least(n.b, 100000.0::DOUBLE)))))) AS m
  FROM way w JOIN link l USING (tree_id, node_id) JOIN nod n USING (tree_id, node_id) JOIN fit USING (tree_id) JOIN eig e ON e.dna = fit.dna)"""


def _times(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda r: list_dot_product(r, {vector}))"


_BOTH = "list_transform(range(1, len(x.l) + 1), lambda k: x.l[k] * y.l[k])"


def loglik(aligned: str, masks: str, upward) -> str:
    """GTR for DNA, WAG for protein: sum of ln(pi . partials) over columns, gaps being missing data."""
    head, tail = aligned.split("deep AS MATERIALIZED", 1)
    site = tail[tail.index("site AS MATERIALIZED") :]
    leaf = "list_transform(range(0, deep.n), lambda j: CASE WHEN mask = gap OR (mask >> j::INT) & 1 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    fold = upward(f"{_times('deep.m', leaf)} AS l, deep.pi AS pi", "l, pi", f"{_times('p.m', _BOTH)}, p.pi")
    return f"""WITH RECURSIVE {head}{_nodes(gtr(), wag())}, {site}, {masks}, {fold}
      SELECT tree_id, round(sum(ln(list_dot_product(pi, l))), 4) AS logl FROM ends GROUP BY tree_id"""


def indel(aligned: str, masks: str, upward) -> str:
    """Insertions and deletions at INDEL_RATE beside JC69 or WAG; a node hands up P(b) F, its presence, its share of the
    column's probability and the two terms of the empty column."""
    head, tail = aligned.split("deep AS MATERIALIZED", 1)
    site = tail[tail.index("site AS MATERIALIZED") :]
    rate, alive = f"{INDEL_RATE}::DOUBLE", f"exp(-{INDEL_RATE}::DOUBLE * {{b}})"
    nodes = _nodes(equal(), wag())
    gap_row = "list_append(list_transform(range(0, e.n), lambda k: 0.0::DOUBLE), 1.0::DOUBLE)"
    grown = f"""big AS MATERIALIZED (SELECT d.tree_id, d.node_id, d.depth, d.up, d.b, d.n, d.pi,
      CASE WHEN d.up IS NULL THEN 1.0::DOUBLE ELSE 1 - {alive.format(b='d.b')} END AS w, {alive.format(b='d.b')} AS s,
      list_append(list_transform(d.m, lambda r: list_append(list_transform(r, lambda v: v * {alive.format(b='d.b')}), 1 - {alive.format(b='d.b')})), {gap_row.replace('e.n', 'd.n')}) AS m FROM deep d)"""
    # a leaf's letters share one probability; a gap is a state of its own
    size = "bit_count(mask)"
    leaf = f"""CASE WHEN mask = gap THEN list_append(list_transform(range(0, deep.n), lambda j: 0.0::DOUBLE), 1.0::DOUBLE)
      ELSE list_append(list_transform(range(0, deep.n), lambda j: CASE WHEN (mask >> j::INT) & 1 = 1 THEN 1.0::DOUBLE / {size} ELSE 0.0::DOUBLE END), 0.0::DOUBLE) END"""
    own = lambda pi, f: f"list_dot_product(list_append({pi}, 0.0::DOUBLE), {f})"
    both = f"(x.a + y.a)"
    gain = f"""CASE WHEN {both} = 2 THEN {own('p.pi', _BOTH)} * p.w ELSE {own('p.pi', _BOTH)} * {both} * p.w + x.a * x.g + y.a * y.g END"""
    c = "((1 + x.s * x.c) * (1 + y.s * y.c) - 1)"
    fold = upward(
        f"{_times('deep.m', leaf)} AS l, CASE WHEN mask = gap THEN 0 ELSE 1 END AS a, CASE WHEN mask = gap THEN 0.0::DOUBLE ELSE {own('deep.pi', leaf)} * deep.w END AS g, "
        "-1.0::DOUBLE AS c, -deep.w AS e, deep.s AS s",
        "l, a, g, c, e, s",
        f"{_times('p.m', _BOTH)}, CASE WHEN {both} > 0 THEN 1 ELSE 0 END, {gain}, {c}, p.w * {c} + x.e + y.e, p.s",
    ).replace("JOIN deep ON", "JOIN big AS deep ON").replace("JOIN deep p ON", "JOIN big p ON")
    return f"""WITH RECURSIVE {head}{nodes}, {grown}, {site}, {masks}, {fold},
      parts AS (SELECT tree_id, sum(ln(CASE WHEN g < 2.2250738585072014e-308 THEN 2.2250738585072014e-308 ELSE g END)) AS t, max(e) AS e, count(*)::DOUBLE AS n FROM ends GROUP BY tree_id)
      SELECT tree_id, round(t + e - (n * ln(n) - n + ln(n) / 2 + 1 / (12 * n) + ln(2 * pi()) / 2), 4) AS logl, n::BIGINT AS columns FROM parts"""


# Neighbour joining: a row holds a tree's sides (lists of leaves), their distances, and the branches made so far. Of equal
# criteria, to nine places, the first pair in row order of the lower triangle is joined; the joined side goes to the end.
_JOIN = """
place AS (SELECT tree_id, list(name ORDER BY name) AS names FROM (SELECT tree_id, a AS name FROM dist UNION SELECT tree_id, b FROM dist) GROUP BY tree_id),
cell AS (SELECT tree_id, a, b, distance FROM dist UNION ALL SELECT tree_id, b, a, distance FROM dist UNION ALL SELECT tree_id, unnest(names) AS a, a AS b, 0.0 FROM place),
line AS (SELECT tree_id, a, list(distance ORDER BY b) AS d FROM cell GROUP BY tree_id, a),
join0 AS (SELECT l.tree_id, list_transform(p.names, lambda v: [v]) AS side, list(l.d ORDER BY l.a) AS d FROM line l JOIN place p USING (tree_id) GROUP BY l.tree_id, p.names),
steps AS (
  SELECT tree_id, side, d, []::STRUCT(side VARCHAR[], blen DOUBLE)[] AS made FROM join0
  UNION ALL
  SELECT tree_id, list_append(list_transform(rest, lambda k: side[k]), list_sort(list_concat(side[i], side[j]))),
    list_append(list_transform(rest, lambda r: list_append(list_transform(rest, lambda c: d[r][c]), (d[r][i] + d[r][j] - d[i][j]) / 2)),
      list_append(list_transform(rest, lambda r: (d[r][i] + d[r][j] - d[i][j]) / 2), 0.0::DOUBLE)),
    [{'side': side[i], 'blen': CASE WHEN bi > 0 THEN bi ELSE 2.220446049250313e-16::DOUBLE END}, {'side': side[j], 'blen': CASE WHEN bj > 0 THEN bj ELSE 2.220446049250313e-16::DOUBLE END}]
  FROM (
    SELECT *, CASE WHEN m > 2 THEN d[i][j] / 2 + (s[i] - s[j]) / (2 * (m - 2)) ELSE d[i][j] / 2 END AS bi,
      CASE WHEN m > 2 THEN d[i][j] - (d[i][j] / 2 + (s[i] - s[j]) / (2 * (m - 2))) ELSE d[i][j] / 2 END AS bj,
      list_filter(range(1, m + 1), lambda k: k <> i AND k <> j) AS rest
    FROM (
      SELECT *, CASE WHEN m > 2 THEN best.i ELSE 2 END AS i, CASE WHEN m > 2 THEN best.j ELSE 1 END AS j
      FROM (
        SELECT *, list_sort(flatten(list_transform(range(2, m + 1), lambda r: list_transform(range(1, r), lambda c:
            {'q': round((m - 2) * d[r][c] - s[r] - s[c], 9), 'i': r, 'j': c}))))[1] AS best
        FROM (SELECT tree_id, side, d, len(side) AS m, list_transform(d, lambda r: list_sum(r)) AS s FROM steps WHERE len(side) > 1)))))
"""


def nj_branches(pairs: str) -> str:
    return f"""WITH RECURSIVE {pairs}, {_JOIN}
      SELECT tree_id, array_to_string(b.side, ',') AS leaves, round(b.blen, 5) AS blen FROM (SELECT tree_id, unnest(made) AS b FROM steps)"""


def rf_to_nj(pairs: str, binary: str) -> str:
    """Splits of each tree that its joined tree lacks, over the leaves that both have."""
    return f"""WITH RECURSIVE {pairs}, {binary}, {_JOIN},
      lab AS (SELECT tree_id, node_id, label FROM nod ANTI JOIN kid ON kid.tree_id = nod.tree_id AND kid.up = nod.node_id),
      e AS (SELECT way.tree_id, label, unnest(path) AS node_id FROM way JOIN lab USING (tree_id, node_id) SEMI JOIN bin USING (tree_id)),
      sd AS (SELECT tree_id, node_id, list_sort(list(DISTINCT label)) AS side FROM e GROUP BY tree_id, node_id),
      both_ AS (SELECT place.tree_id, names, sd.side AS every FROM place JOIN (SELECT sd.tree_id, sd.side FROM sd JOIN link USING (tree_id, node_id) WHERE up IS NULL) sd USING (tree_id)),
      one AS (SELECT DISTINCT tree_id, side FROM (
        SELECT sd.tree_id, sd.side FROM sd JOIN link USING (tree_id, node_id) WHERE up IS NOT NULL
        UNION ALL SELECT sd.tree_id, list_filter(every, lambda v: NOT list_contains(side, v)) FROM sd JOIN link USING (tree_id, node_id) JOIN both_ USING (tree_id) WHERE up IS NOT NULL)),
      nj AS (SELECT tree_id, b.side AS side FROM (SELECT tree_id, unnest(made) AS b FROM steps)),
      two AS (SELECT DISTINCT tree_id, side FROM (SELECT tree_id, side FROM nj
        UNION ALL SELECT nj.tree_id, list_filter(names, lambda v: NOT list_contains(side, v)) FROM nj JOIN place USING (tree_id))),
      c1 AS (SELECT tree_id, list_filter(side, lambda v: list_contains(names, v)) AS side FROM one JOIN both_ USING (tree_id)),
      c2 AS (SELECT tree_id, list_filter(side, lambda v: list_contains(every, v)) AS side FROM two JOIN both_ USING (tree_id)),
      u1 AS (SELECT tree_id, count(*) AS n FROM c1 WHERE len(side) > 0 AND (tree_id, side) NOT IN (SELECT (tree_id, side) FROM c2) GROUP BY tree_id),
      u2 AS (SELECT tree_id, count(*) AS n FROM c2 WHERE len(side) > 0 AND (tree_id, side) NOT IN (SELECT (tree_id, side) FROM c1) GROUP BY tree_id)
      SELECT tree_id, coalesce(u1.n, 0)::INT AS rf_directed, (coalesce(u1.n, 0) + coalesce(u2.n, 0))::INT AS rf_symmetric
      FROM both_ LEFT JOIN u1 USING (tree_id) LEFT JOIN u2 USING (tree_id)"""


_RANKED = """
kin AS (SELECT l.tree_id, l.node_id, l.up, row_number() OVER (PARTITION BY l.tree_id, l.up ORDER BY n.child_ord IS NULL, coalesce(n.child_ord, 0), l.node_id) AS nth,
    row_number() OVER (PARTITION BY l.tree_id ORDER BY l.node_id) - 1 AS place
  FROM link l JOIN nod n USING (tree_id, node_id) SEMI JOIN bin USING (tree_id)),
walk AS (
  SELECT tree_id, node_id, place, []::BIGINT[] AS turns FROM kin WHERE up IS NULL
  UNION ALL SELECT k.tree_id, k.node_id, k.place, list_append(w.turns, k.nth) FROM walk w JOIN kin k ON k.tree_id = w.tree_id AND k.up = w.node_id)"""


def traversals(trees: str, binary: str) -> str:
    return f"""WITH RECURSIVE {trees}, {binary}, {_RANKED}
      SELECT tree_id, place::INT AS place, (row_number() OVER (PARTITION BY tree_id ORDER BY turns) - 1)::INT AS pre,
        (row_number() OVER (PARTITION BY tree_id ORDER BY list_append(turns, 1000000000)) - 1)::INT AS post FROM walk"""


def tree_checks(trees: str, binary: str) -> str:
    return f"""WITH RECURSIVE {trees}, {binary}, r AS (SELECT tree_id, count(*) FILTER (WHERE up IS NULL) AS n FROM link GROUP BY tree_id)
      SELECT tree_id, CASE WHEN n = 0 THEN 'no root' WHEN n > 1 THEN 'several roots'
        WHEN EXISTS (SELECT 1 FROM kid WHERE kid.tree_id = r.tree_id AND kid.n <> 2) THEN 'not binary'
        WHEN EXISTS (SELECT 1 FROM lost WHERE lost.tree_id = r.tree_id) THEN 'circle' END AS problem FROM r"""


def node_maps(trees: str, binary: str, dna: str, protein: str) -> str:
    """Both children's maps of each inner node: running numbers of their columns with a residue, within the node's own."""
    return f"""WITH RECURSIVE {trees}, {binary}, {_RANKED},
      ok AS (SELECT tree_id FROM tip SEMI JOIN bin USING (tree_id) GROUP BY tree_id
        HAVING bool_and(residues IS NOT NULL) AND min(length(residues)) = max(length(residues))
          AND (bool_and(regexp_matches(residues, '{dna}')) OR bool_and(regexp_matches(residues, '{protein}')))),
      ch AS (SELECT tree_id, node_id AS leaf, i::INT AS col, substr(residues, i::INT, 1) <> '-' AS there
        FROM (SELECT tree_id, node_id, residues, unnest(range(1, length(residues) + 1)) AS i FROM tip SEMI JOIN ok USING (tree_id))),
      held AS MATERIALIZED (SELECT c.tree_id, a.node_id, c.col, bool_or(c.there) AS there
        FROM ch c JOIN (SELECT tree_id, node_id AS leaf, unnest(path) AS node_id FROM way) a USING (tree_id, leaf) GROUP BY ALL),
      num AS (SELECT k.tree_id, k.up, k.nth, h.col, h.there, sum(h.there::INT) OVER (PARTITION BY k.tree_id, k.node_id ORDER BY h.col) - 1 AS pos
        FROM kin k JOIN held h USING (tree_id, node_id) WHERE k.up IS NOT NULL),
      map AS (SELECT n.tree_id, n.up, n.nth, string_agg(CASE WHEN n.there THEN n.pos::VARCHAR ELSE '-' END, ',' ORDER BY n.col) AS m
        FROM num n JOIN held h ON h.tree_id = n.tree_id AND h.node_id = n.up AND h.col = n.col WHERE h.there GROUP BY ALL)
      SELECT k.tree_id, k.place::INT AS place, coalesce(x.m, '') AS map_x, coalesce(y.m, '') AS map_y
      FROM kin k SEMI JOIN ok USING (tree_id)
      SEMI JOIN kid ON kid.tree_id = k.tree_id AND kid.up = k.node_id
      LEFT JOIN map x ON x.tree_id = k.tree_id AND x.up = k.node_id AND x.nth = 1 LEFT JOIN map y ON y.tree_id = k.tree_id AND y.up = k.node_id AND y.nth = 2"""


def model_rates() -> str:
    """All rates and P(0.5) of the table's models, from exchangeabilities and frequencies, the exponential as a series."""
    proteins = {name: (getattr(protein_tables, name + suffix), getattr(protein_tables, name + suffix + "_FREQS")) for name, suffix in (("WAG", ""), ("HIVB", ""), ("BLOSUM", "62"))}
    rows = []
    for name, (triangle, freqs) in proteins.items():
        values = {(i, j): float(x) for i, r in enumerate(triangle.split("\n")[1:], 1) for j, x in enumerate(r.split())}
        rows.append(f"('{name}', {_sql(_symmetric(20, values))}, {_sql(np.array(freqs.split(), float))})")
    p = "coalesce(params, []::DOUBLE[])"
    rate = lambda k, default: f"coalesce({p}[{k}], {default}::DOUBLE)"
    six = {
        "JC69": ["1.0"] * 6,
        "K80": [rate(1, 2.0), "1.0", "1.0", "1.0", "1.0", rate(1, 2.0)],
        "HKY": [rate(1, 2.0), "1.0", "1.0", "1.0", "1.0", rate(1, 2.0)],
        "TN93": [rate(1, 1.0), *[rate(3, 1.0)] * 4, rate(2, 1.0)],
        "GTR": [*[rate(k, 1.0) for k in range(1, 6)], f"CASE WHEN len({p}) = 6 THEN {p}[6] ELSE 1.0 END"],
    }
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(f'({x})::DOUBLE' for x in v)}]" for k, v in six.items())
    one = "abs(list_sum(f) - 1) <= 2.220446049250313e-16"
    return f"""WITH aa(name, ex, pi) AS (VALUES {', '.join(rows)}),
      m AS (SELECT model_id, upper(family) AS model, params, coalesce(freqs, []::DOUBLE[]) AS f FROM models),
      r AS (SELECT model_id, model, f, CASE model {cases} END AS r FROM m),
      ex AS (SELECT r.model_id, r.model, coalesce(aa.ex, [[0.0, r[1], r[2], r[3]], [r[1], 0.0, r[4], r[5]], [r[2], r[4], 0.0, r[6]], [r[3], r[5], r[6], 0.0]]) AS ex,
          CASE WHEN aa.name IS NOT NULL THEN CASE WHEN len(f) = 20 AND {one} THEN f ELSE aa.pi END
            WHEN r.model IN ('JC69', 'K80') OR len(f) < 4 OR NOT abs(list_sum(f[1:4]) - 1) <= 2.220446049250313e-16 THEN [0.25, 0.25, 0.25, 0.25] ELSE f[1:4] END AS pi
        FROM r LEFT JOIN aa ON aa.name = r.model WHERE aa.name IS NOT NULL OR r.r IS NOT NULL),
      off AS (SELECT *, list_transform(range(1, len(pi) + 1), lambda i: list_transform(range(1, len(pi) + 1), lambda j: CASE WHEN i = j THEN 0.0 ELSE ex[i][j] * pi[j] END)) AS o FROM ex),
      q AS (SELECT model_id, model, pi, list_transform(range(1, len(pi) + 1), lambda i: list_transform(range(1, len(pi) + 1), lambda j:
          (CASE WHEN i = j THEN -list_sum(o[i]) ELSE o[i][j] END) / list_sum(list_transform(range(1, len(pi) + 1), lambda k: pi[k] * list_sum(o[k]))))) AS q FROM off)
      SELECT model_id, model, len(pi)::INT AS states, i::INT AS i, j::INT AS j, round(q[i][j], 6) + 0.0 AS rate
      FROM (SELECT *, unnest(range(1, len(pi) + 1)) AS j FROM (SELECT *, unnest(range(1, len(pi) + 1)) AS i FROM q))"""
