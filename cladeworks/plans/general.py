"""Queries of the general data-preparation problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import hierarchy as h
from cladeworks.session import table
from cladeworks.sources import strict_records as r


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return h.on_or_below_circles(table(spark, d, "nodes"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    found = h.hierarchy(table(spark, d, "nodes"))
    return found.select(
        "tree_id", "node_id", "root", F.col("levels").cast("long").alias("levels"), F.round("blen_sum", 6).alias("blen_sum"),
        F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"), "cycle_node",
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return h.descendants(h.hierarchy(table(spark, d, "nodes")))


def p1_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return h.back_edges(table(spark, d, "nodes"))


def p1_child_lists(spark: SparkSession, d: str) -> DataFrame:
    return h.child_list_problems(table(spark, d, "nodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return r.split_valid(r.load_records(table(spark, d, "raw_records")))[1]


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return r.split_valid(r.load_records(table(spark, d, "raw_records")))[0]


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_back_edges, p1_child_lists, p2_found, p2_loaded)}

_FORCE = """
force AS MATERIALIZED (
  SELECT tree_id, node_id, parent_id, CASE WHEN blen IS NULL OR isnan(blen) THEN 0.0 ELSE blen END AS blen
  FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST,
        blen DESC NULLS LAST) AS rn FROM nodes WHERE tree_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1),
link AS MATERIALIZED (
  SELECT a.tree_id, a.node_id, b.node_id AS up, a.blen FROM force a
  LEFT JOIN force b ON a.tree_id = b.tree_id AND a.parent_id = b.node_id),
above AS (
  SELECT tree_id, node_id, up AS anc FROM link WHERE up IS NOT NULL
  UNION SELECT a.tree_id, a.node_id, l.up FROM above a JOIN link l ON a.tree_id = l.tree_id AND a.anc = l.node_id WHERE l.up IS NOT NULL),
ring AS MATERIALIZED (SELECT tree_id, node_id AS r FROM above WHERE node_id = anc),
lost AS MATERIALIZED (
  SELECT tree_id, node_id, min(r) AS cycle_node FROM (
    SELECT a.tree_id, a.node_id, g.r FROM above a JOIN ring g ON a.tree_id = g.tree_id AND a.anc = g.r) GROUP BY tree_id, node_id),
way AS (
  SELECT l.tree_id, l.node_id, l.node_id AS root, 1::BIGINT AS levels, 0.0::DOUBLE + l.blen AS blen_sum, [l.node_id] AS path
  FROM link l LEFT JOIN ring g ON l.tree_id = g.tree_id AND l.node_id = g.r LEFT JOIN ring u ON l.tree_id = u.tree_id AND l.up = u.r
  WHERE g.r IS NULL AND (l.up IS NULL OR u.r IS NOT NULL)
  UNION ALL
  SELECT l.tree_id, l.node_id, w.root, w.levels + 1, w.blen_sum + l.blen, list_append(w.path, l.node_id)
  FROM way w JOIN link l ON l.tree_id = w.tree_id AND l.up = w.node_id)
"""

# Fields of a raw record in SQL: a csv record with a comma added is a run of fields that each end in a comma.
_RAW = r"""
t AS (SELECT raw_id, layout, regexp_replace(coalesce(raw_text, ''), '(\r?\n)+$', '') AS x FROM raw_records),
f AS (
  SELECT raw_id, layout, x,
    CASE layout WHEN 'csv' THEN list_transform(regexp_extract_all(x || ',', '("(?:[^"]|"")*"|[^",]*),', 1),
           lambda v: CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END)
      WHEN 'tsv' THEN string_split(x, chr(9))
      ELSE ['', '', regexp_extract(x, '^>([^ \t\r\n]*)', 1), regexp_replace(regexp_extract(x, '^[^\r\n]*'), '^>[^ \t]*[ \t]?', ''),
            array_to_string(list_transform(regexp_split_to_array(x, '\r?\n')[2:], lambda v: regexp_replace(v, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '')] END AS c,
    layout = 'csv' AND NOT regexp_full_match(x, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS bad_quote
  FROM t),
v AS (SELECT *, regexp_replace(c[3], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS id, regexp_replace(c[2], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS o,
      regexp_replace(c[5], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS res FROM f),
judged AS (SELECT *, CASE WHEN bad_quote THEN 'quoting'
  WHEN (layout <> 'fasta' AND len(c) <> 5) OR (layout = 'fasta' AND (x NOT LIKE '>%' OR regexp_matches(x, '\n>'))) THEN 'columns'
  WHEN id = '' OR regexp_matches(id, '\s') THEN 'bad_id'
  WHEN layout <> 'fasta' AND NOT regexp_full_match(o, '[0-9]+') THEN 'bad_ord'
  WHEN NOT regexp_full_match(upper(res), '[-ARNDCQEGHILKMFPSTWYVBJZX_*]*') THEN 'bad_residues' END AS reason FROM v)
"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_FORCE} SELECT tree_id, node_id, cycle_node FROM lost",
    "p1_hierarchy": f"""WITH RECURSIVE {_FORCE}
      SELECT k.tree_id, k.node_id, CASE WHEN lost.cycle_node IS NULL THEN w.root END AS root,
        CASE WHEN lost.cycle_node IS NULL THEN w.levels END AS levels,
        CASE WHEN lost.cycle_node IS NULL THEN round(w.blen_sum, 6) END AS blen_sum,
        coalesce(array_to_string(w.path, '/'), '') AS path, lost.cycle_node
      FROM link k LEFT JOIN way w ON k.tree_id = w.tree_id AND k.node_id = w.node_id
      LEFT JOIN lost ON k.tree_id = lost.tree_id AND k.node_id = lost.node_id""",
    "p1_descendants": f"""WITH RECURSIVE {_FORCE}
      SELECT tree_id, node_id, below_id FROM (SELECT tree_id, unnest(path) AS node_id, node_id AS below_id FROM way)
      WHERE node_id <> below_id UNION ALL SELECT tree_id, cycle_node, node_id FROM lost WHERE node_id <> cycle_node""",
    "p1_back_edges": f"""WITH RECURSIVE {_FORCE} SELECT l.tree_id, l.up AS from_id, l.node_id AS to_id FROM link l
      JOIN lost ON lost.tree_id = l.tree_id AND lost.node_id = l.node_id AND lost.cycle_node = l.node_id""",
    "p1_child_lists": """WITH kept AS MATERIALIZED (
        SELECT tree_id, node_id, parent_id, children FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id
          ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST, list_sort(children) DESC NULLS LAST) AS rn
          FROM nodes WHERE tree_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1),
      listed AS (SELECT DISTINCT tree_id, node_id, child_id FROM (SELECT tree_id, node_id, unnest(children) AS child_id FROM kept) WHERE child_id IS NOT NULL),
      linked AS (SELECT k.tree_id, k.parent_id AS node_id, k.node_id AS child_id FROM kept k
        SEMI JOIN kept p ON p.tree_id = k.tree_id AND p.node_id = k.parent_id)
      SELECT tree_id, node_id, child_id, 'listed' AS problem FROM (FROM listed EXCEPT FROM linked)
      UNION ALL SELECT tree_id, node_id, child_id, 'not listed' FROM (FROM linked EXCEPT FROM listed)""",
    "p2_found": f"WITH {_RAW} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": f"""WITH {_RAW} SELECT raw_id, CASE WHEN layout <> 'fasta' THEN c[1] END AS family_id,
      CASE WHEN layout <> 'fasta' THEN try_cast(o AS BIGINT) END AS ord, CASE WHEN layout <> 'fasta' THEN o END AS ord_text, id AS seq_id, nullif(c[4], '') AS descr, res AS residues
      FROM judged WHERE reason IS NULL""",
}
