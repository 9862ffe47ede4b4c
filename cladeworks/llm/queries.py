"""Queries of the collection problems over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import leakage, near_duplicates, packing, shared_spans, stuffing, term_frequencies
from cladeworks.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs_of_records(*near_duplicates.near_duplicates(table(spark, d, "sequences")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.near_duplicates(table(spark, d, "sequences")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies.term_frequencies(table(spark, d, "sequences")).where("mark is not null").select("term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies.term_frequencies(table(spark, d, "sequences"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "sequences"))[0]


def p5_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_share(*shared_spans.shared_spans(table(spark, d, "sequences")))


def p5_removed(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.without_shared(*shared_spans.shared_spans(table(spark, d, "sequences")))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p6_pack(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "eval_id")


def p7_containment(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("containment", F.round("containment", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judge(table(spark, d, "documents")).where("stuffed").select("doc_id")


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.corpus_shapes(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_groups, p4_found, p4_terms, p5_found, p5_shared, p5_removed, p6_pack, p6_fill, p7_found, p7_containment, p8_found, p8_shapes)
}

_REC = """rec AS MATERIALIZED (
  SELECT record_id, replace(replace(replace(upper(coalesce(residues, '')), '-', ''), '_', ''), '*', '') AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST, residues DESC NULLS LAST) AS rn
        FROM sequences WHERE record_id IS NOT NULL) WHERE rn = 1)"""
_TERMS = f"""WITH {_REC},
t AS (SELECT record_id, substr(x, i::INT, 4) AS term FROM (SELECT record_id, x, unnest(range(1, length(x) - 2)) AS i FROM rec)),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM t GROUP BY term),
m AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare'
  WHEN records >= 0.25 * (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM c)"""
_SPANS = f"""WITH {_REC},
w AS MATERIALIZED (SELECT record_id, i, substr(x, i::INT + 1, 40) AS s FROM (SELECT record_id, x, unnest(range(0, length(x) - 39)) AS i FROM rec WHERE length(x) >= 40)),
two AS (SELECT s FROM w GROUP BY s HAVING min(record_id) <> max(record_id)),
hit AS (SELECT record_id, i FROM w SEMI JOIN two USING (s)),
isl AS (SELECT record_id, i, CASE WHEN i <= 40 + lag(i) OVER (PARTITION BY record_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM hit),
num AS (SELECT record_id, i, sum(new) OVER (PARTITION BY record_id ORDER BY i) AS k FROM isl),
span AS (SELECT record_id, min(i) AS span_from, max(i) + 40 AS span_to FROM num GROUP BY record_id, k)"""

ORACLES = {
    "p3_found": f"""WITH {_REC},
      k AS MATERIALIZED (SELECT DISTINCT record_id, substr(x, i::INT, 8) AS t FROM (SELECT record_id, x, unnest(range(1, length(x) - 6)) AS i FROM rec WHERE length(x) >= 30)),
      n AS (SELECT record_id, count(*) AS n FROM k GROUP BY record_id),
      b AS (SELECT a.record_id AS record_a, b.record_id AS record_b, count(*) AS s FROM k a JOIN k b ON a.t = b.t AND a.record_id < b.record_id GROUP BY ALL)
      SELECT record_a, record_b FROM b JOIN n x ON x.record_id = record_a JOIN n y ON y.record_id = record_b WHERE 3 * s >= x.n + y.n""",
    "p3_groups": f"""WITH RECURSIVE {_REC},
      tx AS MATERIALIZED (SELECT x, min(record_id) AS rep FROM rec WHERE length(x) >= 30 GROUP BY x),
      k AS MATERIALIZED (SELECT DISTINCT rep, substr(x, i::INT, 8) AS t FROM (SELECT rep, x, unnest(range(1, length(x) - 6)) AS i FROM tx)),
      n AS (SELECT rep, count(*) AS n FROM k GROUP BY rep),
      b AS (SELECT a.rep AS a, b.rep AS b, count(*) AS s FROM k a JOIN k b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL),
      l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 3 * s >= x.n + y.n),
      both_ AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      reach AS (SELECT a AS rep, b AS other FROM both_ UNION SELECT r.rep, e.b FROM reach r JOIN both_ e ON e.a = r.other),
      g AS (SELECT rep, least(rep, min(other)) AS label FROM reach GROUP BY rep), c AS (SELECT a AS rep, count(*) AS links FROM both_ GROUP BY a)
      SELECT record_id, tx.rep, coalesce(label, tx.rep) AS group_id, coalesce(links, 0) AS links
      FROM rec JOIN tx USING (x) LEFT JOIN g USING (rep) LEFT JOIN c USING (rep)""",
    "p4_found": f"{_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"{_TERMS} SELECT term, occurrences, records, mark FROM m",
    "p5_found": f"{_SPANS} SELECT record_id, span_from, span_to FROM span",
    "p5_shared": f"""{_SPANS} SELECT rec.record_id, length(rec.x) AS letters, coalesce(sum(span_to - span_from), 0)::BIGINT AS shared
      FROM rec LEFT JOIN span ON rec.record_id = span.record_id GROUP BY rec.record_id, rec.x""",
    "p5_removed": f"""{_SPANS}, edge AS (SELECT record_id, span_from AS b, coalesce(lag(span_to) OVER (PARTITION BY record_id ORDER BY span_from), 0) AS a FROM span
        UNION ALL SELECT rec.record_id, length(x), coalesce(max(span_to), 0) FROM rec LEFT JOIN span USING (record_id) GROUP BY ALL)
      SELECT record_id, string_agg(substr(x, a::INT + 1, (b - a)::INT), '' ORDER BY a) AS letters FROM edge JOIN rec USING (record_id) GROUP BY record_id""",
}
