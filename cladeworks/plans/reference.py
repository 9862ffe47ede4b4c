"""Queries of the sequence, tree and likelihood operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions import costs, models, treelib
from cladeworks.functions.alphabet import DNA, DNA_WORD, GAP, PROTEIN, PROTEIN_WORD, mask_of
from cladeworks.operators import family_costs as fc
from cladeworks.operators import sequence_ops as so
from cladeworks.operators import tree_ops as to
from cladeworks.plans import oracles as osql
from cladeworks.plans.general import _FORCE
from cladeworks.session import shared_folder, table
from cladeworks.sources import tree_files
from cladeworks.streaming import symbol_windows as sw
from cladeworks.tables import family_facts, nodes_in_force, one_per_name, sequences_in_force

TIMES = (0.05, 0.1, 0.3, 0.5, 0.7)


def _seqs(spark: SparkSession, d: str) -> DataFrame:
    return sequences_in_force(table(spark, d, "sequences"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes_in_force(table(spark, d, "nodes"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    found = fc.leaves_with_records(_seqs(spark, d), _nodes(spark, d))
    return found.where("residues is not null").select("tree_id", "seq_id", "residues").distinct()


def _usable(blen: str = "blen"):
    return F.when(F.col(blen).isNotNull() & ~F.isnan(blen) & (F.col(blen) > 0), F.col(blen)).otherwise(0.0)


def fasta_normalise(spark, d):
    return _seqs(spark, d).select("record_id", "seq_id", "residues")


def family_alphabets(spark, d):
    return family_facts(_seqs(spark, d)).select("family_id", "records", "aligned", "alphabet")


def gapless(spark, d):
    return so.gapless(_seqs(spark, d)).select("record_id", "residues")


def _thirds(spark, d) -> DataFrame:
    """Each aligned family's records in three parts by record_id, as families of their own: parts have columns of gaps."""
    part = F.concat_ws("/", "family_id", F.pmod("record_id", F.lit(3)).cast("string"))
    whole = family_facts(_seqs(spark, d)).where("aligned").select("family_id")
    return _seqs(spark, d).join(whole, "family_id").withColumn("family_id", part)


def gap_columns(spark, d):
    return so.columns_of_gaps(_seqs(spark, d)).unionByName(so.columns_of_gaps(_thirds(spark, d)))


def remove_gap_columns(spark, d):
    whole, parts = so.drop_gap_columns(_seqs(spark, d)), so.drop_gap_columns(_thirds(spark, d))
    return whole.unionByName(parts.select(*whole.columns)).select("record_id", "family_id", "residues")


def align_map(spark, d):
    text = F.concat_ws(",", F.transform("map", lambda i: F.coalesce(i.cast("string"), F.lit(GAP))))
    return so.align_map(_seqs(spark, d)).select("record_id", text.alias("map"))


def align_map_roundtrip(spark, d):
    mapped = so.align_map(_seqs(spark, d)).withColumn("letters", F.translate("residues", GAP, ""))
    return so.apply_map(mapped).select("record_id", F.col("gapped").alias("residues"))


def symbol_counts(spark, d):
    return so.symbol_counts(_seqs(spark, d))


def empirical_freqs(spark, d):
    return so.empirical_freqs(_seqs(spark, d)).withColumn("freq", F.round("freq", 6))


def symbol_sets(spark, d):
    """How many letters of each family stand for how many symbols, by the masks of its alphabet."""
    seqs = _seqs(spark, d)
    counts = so.symbol_counts(seqs).where(F.col("ch") != GAP).join(family_facts(seqs).select("family_id", "alphabet"), "family_id")
    mask = F.when(F.col("alphabet") == "dna", mask_of(DNA, F.col("ch"))).otherwise(mask_of(PROTEIN, F.col("ch")))
    sized = counts.where("alphabet <> 'none'").select("family_id", F.bit_count(mask).cast("int").alias("members"), "n")
    return sized.groupBy("family_id", "members").agg(F.sum("n").alias("letters"))


def tip_problems(spark, d):
    """Leaves without a record, and records of a tree's family that no leaf names."""
    seqs, nodes = one_per_name(_seqs(spark, d)), _nodes(spark, d)
    leaves = fc.leaves_with_records(_seqs(spark, d), nodes)
    tips = leaves.where("residues is null").select("tree_id", "seq_id", F.lit("no sequence").alias("problem")).distinct()
    trees = leaves.select("tree_id", "family_id").distinct()
    lost = seqs.select("family_id", "seq_id").join(trees, "family_id").join(leaves.select("tree_id", "seq_id"), ["tree_id", "seq_id"], "left_anti")
    return tips.unionByName(lost.select("tree_id", "seq_id", F.lit("no leaf").alias("problem")))


def pair_distances(spark, d):
    return so.pair_distances(_leaves(spark, d)).withColumn("distance", F.round("distance", 6))


def distance_row_sums(spark, d):
    return so.row_sums(so.pair_distances(_leaves(spark, d))).withColumn("total", F.round("total", 5))


def nj_q_matrix(spark, d):
    q = so.nj_criterion(so.pair_distances(_leaves(spark, d)))
    return q.select("tree_id", "a", "b", F.round("q", 4).alias("q"))


def nj_first_pair(spark, d):
    return so.nj_first_pair(so.pair_distances(_leaves(spark, d)), 4)


def nj_tree(spark, d):
    return to.nj_trees(so.pair_distances(_leaves(spark, d)))


def nj_branches(spark, d):
    """The joined trees' branches: the leaves below each, and its length."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for tree_id, text in zip(b["tree_id"], b["newick"], strict=True):
                t = treelib.parse_newick(text)[0]
                rows += [(tree_id, ",".join(sorted(t.leaf_set(i))), round(t.blen[i], 5) + 0.0) for i in range(len(t)) if i != t.root]
            yield pd.DataFrame(rows, columns=["tree_id", "leaves", "blen"])

    return nj_tree(spark, d).select("tree_id", "newick").mapInPandas(run, "tree_id string, leaves string, blen double")


def rf_to_nj(spark, d):
    return to.against_newick(to.tree_rows(_nodes(spark, d)), nj_tree(spark, d))


def tree_checks(spark, d):
    return to.checks(to.tree_rows(_nodes(spark, d)))


def tree_facts(spark, d):
    return to.tree_facts(_nodes(spark, d)).withColumn("height", F.round("height", 4))


def blen_percentiles(spark, d):
    p = F.transform("percentiles", lambda x: F.round(x, 6))
    return to.blen_percentiles(_nodes(spark, d)).select("tree_id", *[F.element_at(p, i).alias(f"p{i}") for i in range(1, 5)])


def leaf_descendants(spark, d):
    return to.leaf_descendants(table(spark, d, "nodes"), _nodes(spark, d))


def partitions(spark, d):
    return to.partitions(to.tree_rows(_nodes(spark, d))).select("tree_id", "leaves").distinct()


def spr_moves(spark, d):
    return to.spr_places(to.tree_rows(_nodes(spark, d)))


def traversals(spark, d):
    return to.traversals(to.tree_rows(_nodes(spark, d)))


def newick_roundtrip(spark, d):
    texts = to.newick(to.tree_rows(_nodes(spark, d)))
    nodes = tree_files.parse_newick(texts, "tree_id", "newick")
    return nodes.groupBy(F.col("key").alias("tree_id")).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.round(F.sum("blen"), 4).alias("height")
    )


def _by_branch(spark, d, fn, schema: str) -> DataFrame:
    """fn(branch lengths) of every node in force, a batch at a time; fn gives a dict of columns."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"tree_id": b["tree_id"], "node_id": b["node_id"], **fn(b["b"].tolist())})

    return _nodes(spark, d).select("tree_id", "node_id", _usable().alias("b")).mapInPandas(run, f"tree_id string, node_id int, {schema}")


def nearest_time(spark, d):
    """The nearest of the times at which costs are tabulated for each branch; of two equally near the smaller."""

    def fn(lengths):
        scoring = costs.ModelScoring(models.make("JC69"), list(TIMES))
        return {"time": [scoring.times[scoring.at(b)] for b in lengths]}

    return _by_branch(spark, d, fn, "time double")


def model_scoring(spark, d):
    """Gap and mismatch costs by a model's tables at the nearest time, and their mean."""

    def fn(lengths):
        scoring = costs.ModelScoring(models.make("JC69"), list(TIMES), 2.5, 1.0, zero_diagonal=True)
        a, c, r = DNA.mask("A"), DNA.mask("C"), DNA.mask("R")
        return {
            "open": [round(scoring.open(b), 6) for b in lengths], "ext": [round(scoring.ext(b), 6) for b in lengths], "mean": [round(scoring.avg(b), 6) for b in lengths],
            "mismatch": [round(scoring.min_match(b, a, c), 6) for b in lengths], "within": [round(scoring.min_match(b, a, r), 6) for b in lengths],
        }

    return _by_branch(spark, d, fn, "open double, ext double, mean double, mismatch double, within double")


def jc69_p(spark, d):
    def fn(lengths):
        m = models.make("JC69")
        p = [m.p(b) for b in lengths]
        return {"same": [round(x[0, 0], 8) + 0.0 for x in p], "other": [round(x[0, 1], 8) + 0.0 for x in p]}

    return _by_branch(spark, d, fn, "same double, other double")


def k80_p(spark, d):
    """Same, transition and transversion probabilities of each branch for a rate ratio of 2."""

    def fn(lengths):
        m = models.make("K80", None, [2.0])
        p = [m.p(b) for b in lengths]
        return {"same": [round(x[0, 0], 8) + 0.0 for x in p], "transition": [round(x[0, 1], 8) + 0.0 for x in p], "transversion": [round(x[0, 2], 8) + 0.0 for x in p]}

    return _by_branch(spark, d, fn, "same double, transition double, transversion double")


def model_rates(spark, d):
    """All rates of every model of the table, built in workers."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for i, family, freqs, params in zip(b["model_id"], b["family"], b["freqs"], b["params"], strict=True):
                try:
                    m = models.make(family or "", freqs, params)
                except ValueError:
                    continue
                rows += [(i, m.name, m.n, k + 1, j + 1, round(float(m.q[k, j]), 6) + 0.0) for k in range(m.n) for j in range(m.n)]
            yield pd.DataFrame(rows, columns=["model_id", "model", "states", "i", "j", "rate"])

    return table(spark, d, "models").select("model_id", "family", "freqs", "params").mapInPandas(run, "model_id string, model string, states int, i int, j int, rate double")


def _blocks(spark, d):
    return fc.blocks(_seqs(spark, d), _nodes(spark, d))


def site_patterns(spark, d):
    return fc.site_pattern_counts(_seqs(spark, d), _nodes(spark, d))


def fitch_score(spark, d):
    return fc.fitch(_blocks(spark, d)).select("tree_id", (-F.col("cost")).cast("long").alias("score"), "columns")


def dollo_score(spark, d):
    return fc.dollo(_blocks(spark, d)).select("tree_id", (-F.col("cost")).cast("long").alias("score"))


def dollo_model_score(spark, d):
    found = fc.dollo_by_model(_blocks(spark, d).where("alphabet = 'dna'"), "JC69", times=TIMES)
    return found.select("tree_id", F.round(-F.col("cost"), 4).alias("score"))


def jc69_loglik(spark, d):
    found = fc.log_likelihood(_blocks(spark, d).where("alphabet = 'dna'"))
    return found.select("tree_id", F.round("cost", 4).alias("logl"))


def model_loglik(spark, d):
    """GTR for DNA families, WAG for protein ones."""
    found = fc.log_likelihood(_blocks(spark, d), "GTR", "WAG", [0.22, 0.26, 0.33, 0.19], [1.2, 1.1, 1.0, 1.1, 1.5, 1.4])
    return found.select("tree_id", F.round("cost", 4).alias("logl"))


def indel_loglik(spark, d):
    return fc.indel_likelihood(_blocks(spark, d)).select("tree_id", F.round("cost", 4).alias("logl"), "columns")


def stirling(spark, d):
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"family_id": b["family_id"], "log_factorial": [round(costs.stirling(float(n)), 6) for n in b["longest"]]})

    facts = family_facts(_seqs(spark, d)).where("longest > 0").select("family_id", "longest")
    return facts.mapInPandas(run, "family_id string, log_factorial double")


def _families(spark, d):
    return fc.whole_families(_seqs(spark, d), _nodes(spark, d))


def indel_alignment(spark, d):
    return fc.aligned_rows(_families(spark, d).where("not aligned"))


def branch_optimise(spark, d):
    return fc.optimised(_families(spark, d), "branches", "JC69")


def model_optimise(spark, d):
    return fc.optimised(_families(spark, d), "model", "K80")


def parsimony_search(spark, d):
    return fc.optimised(_families(spark, d), "parsimony")


def topology_search(spark, d):
    """Rearrangements and branches under likelihood, JC69 or WAG, until a round gains nothing."""
    return fc.optimised(_families(spark, d), "topology", "JC69")


def tree_inference(spark, d):
    """Model and topology by turns from each family's tree, K80 or WAG with the data's frequencies."""
    return fc.optimised(_families(spark, d), "all", "K80")


def indel_optimise(spark, d):
    """Insertion and deletion rates of the indel process, fitted to each family."""
    return fc.optimised(_families(spark, d), "model", "PIP-K80", "PIP-WAG")


def best_moves(spark, d):
    """The best regraft of every prune place by parsimony."""
    return fc.best_moves(_families(spark, d), "parsimony")


def node_relations(spark, d):
    return to.relations(_nodes(spark, d))


def subtree_alignments(spark, d):
    return fc.subtree_alignments(_seqs(spark, d), table(spark, d, "nodes"), _nodes(spark, d))


def node_maps(spark, d):
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda i: F.coalesce(i.cast("string"), F.lit(GAP)))).alias(c)
    return fc.node_maps(_families(spark, d)).select("tree_id", "place", shown("map_x"), shown("map_y"))


def stream_symbol_windows(spark, d):
    found = sw.run_to_end(spark, sw.symbol_windows(sw.stream_table(spark, d, "sequences")))
    return found.withColumn("begins", F.unix_seconds("begins"))


def _fresh_path(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def fasta_roundtrip(spark, d):
    """All records written as FASTA files and read again."""
    path = _fresh_path(spark)
    tree_files.write_fasta(_seqs(spark, d).withColumn("descr", F.lit("a>b")), path)
    return tree_files.read_fasta(spark, path, strict=False).select("seq_id", "descr", "residues")


def newick_files(spark, d):
    """All binary trees written as Newick files and read again."""
    path = _fresh_path(spark)
    tree_files.write_newick(to.newick(to.tree_rows(_nodes(spark, d))), path)
    nodes = tree_files.read_newick(spark, path)
    sums = nodes.groupBy("key", "tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.round(F.sum("blen"), 4).alias("height"))
    return sums.select("nodes", "leaves", "height")


def fasta_display(spark, d):
    return so.as_fasta(so.gapless(_seqs(spark, d)))


def record_lookup(spark, d):
    """The records of one name, the first of each family."""
    seqs = _seqs(spark, d)
    name = seqs.agg(F.min("seq_id")).first()[0]
    return so.record_by_id(seqs, name or "").select("family_id", "record_id", "seq_id", "residues")


def rounded_scoring(spark, d):
    """Costs of a model's tables rounded to two places, half away from zero."""

    def fn(lengths):
        scoring = costs.ModelScoring(models.make("K80", None, [2.0]), list(TIMES), digits=2)
        a, g, t = DNA.mask("A"), DNA.mask("G"), DNA.mask("T")
        return {
            "same": [round(scoring.min_match(b, a, a), 6) for b in lengths], "transition": [round(scoring.min_match(b, a, g), 6) for b in lengths],
            "transversion": [round(scoring.min_match(b, a, t), 6) for b in lengths],
        }

    return _by_branch(spark, d, fn, "same double, transition double, transversion double")


_FUNCTIONS = (
    fasta_roundtrip, newick_files, fasta_display, record_lookup, rounded_scoring,
    stream_symbol_windows, node_relations, subtree_alignments, node_maps,
    fasta_normalise, family_alphabets, gapless, gap_columns, remove_gap_columns, align_map, align_map_roundtrip, symbol_counts,
    empirical_freqs, symbol_sets, tip_problems, pair_distances, distance_row_sums, nj_q_matrix, nj_first_pair, nj_tree, nj_branches, rf_to_nj,
    tree_checks, tree_facts, blen_percentiles, leaf_descendants, partitions, spr_moves, traversals, newick_roundtrip, nearest_time,
    model_scoring, jc69_p, k80_p, model_rates, site_patterns, fitch_score, dollo_score, dollo_model_score, best_moves, jc69_loglik, model_loglik, indel_loglik, stirling,
    indel_alignment, branch_optimise, model_optimise, indel_optimise, parsimony_search, topology_search, tree_inference,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# ---- SQL ----

_SEQ = """seq AS MATERIALIZED (
  SELECT record_id, family_id, ord, seq_id, descr, translate(upper(coalesce(residues, '')), '_*', '--') AS residues
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST, residues DESC NULLS LAST) AS rn
        FROM sequences WHERE record_id IS NOT NULL AND family_id IS NOT NULL AND seq_id IS NOT NULL) WHERE rn = 1)"""
_FACTS = f"""facts AS MATERIALIZED (
  SELECT family_id, count(*) AS records, min(length(residues)) AS shortest, max(length(residues)) AS longest,
    min(length(residues)) = max(length(residues)) AS aligned,
    CASE WHEN bool_and(regexp_matches(residues, '{DNA_WORD}')) THEN 'dna'
         WHEN bool_and(regexp_matches(residues, '{PROTEIN_WORD}')) THEN 'protein' ELSE 'none' END AS alphabet
  FROM seq GROUP BY family_id)"""
_CELLS = f"""{_SEQ}, {_FACTS},
cell AS (SELECT family_id, record_id, i::INT - 1 AS col, substr(residues, i::INT, 1) AS ch
  FROM (SELECT family_id, record_id, residues, unnest(range(1, length(residues) + 1)) AS i FROM seq))"""
_GONE = f"""{_CELLS},
each AS MATERIALIZED (SELECT family_id, record_id, col, ch, aligned FROM cell JOIN facts USING (family_id)
  UNION ALL SELECT family_id || '/' || (record_id % 3)::VARCHAR, record_id, col, ch, aligned FROM cell JOIN facts USING (family_id) WHERE aligned),
gone AS MATERIALIZED (SELECT family_id, col FROM each WHERE aligned GROUP BY family_id, col HAVING bool_and(ch = '-'))"""


def _members(alphabet) -> str:
    rows = [f"('{alphabet.name}', '{c}', '{s}', {len(alphabet.members(c))})" for c in alphabet.symbols + alphabet.codes for s in alphabet.members(c)]
    return ", ".join(rows)


_LUT = f"lut(alphabet, ch, symbol, size) AS (VALUES {_members(DNA)}, {_members(PROTEIN)})"

# all nodes in force with the existing parent (up), fam, and the leaves' records
_TREES = f"""{_FORCE}, {_SEQ},
nod AS MATERIALIZED (
  SELECT tree_id, regexp_replace(tree_id, '_t\\d+$', '') AS family_id, node_id, parent_id, child_ord, is_leaf, coalesce(label, '') AS label, blen AS raw_blen,
    CASE WHEN blen IS NULL OR isnan(blen) OR blen <= 0 THEN 0.0 ELSE blen END AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST,
        blen DESC NULLS LAST, child_ord DESC NULLS LAST) AS rn FROM nodes WHERE tree_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1),
nam AS MATERIALIZED (SELECT family_id, seq_id, arg_min(residues, record_id) AS residues FROM seq GROUP BY family_id, seq_id),
tip AS MATERIALIZED (
  SELECT n.tree_id, n.node_id, n.family_id, n.label AS seq_id, nam.residues
  FROM nod n ANTI JOIN (SELECT DISTINCT tree_id, parent_id AS node_id FROM nod WHERE parent_id IS NOT NULL) p USING (tree_id, node_id)
  LEFT JOIN nam ON nam.family_id = n.family_id AND nam.seq_id = n.label)"""
_PAIRS = f"""{_TREES},
lv AS (SELECT DISTINCT tree_id, seq_id, residues FROM tip WHERE residues IS NOT NULL),
pair AS MATERIALIZED (
  SELECT x.tree_id, x.seq_id AS a, y.seq_id AS b, levenshtein(x.residues, y.residues)::BIGINT AS edits,
    greatest(length(x.residues), length(y.residues)) AS longest
  FROM lv x JOIN lv y ON x.tree_id = y.tree_id AND x.seq_id < y.seq_id),
dist AS MATERIALIZED (
  SELECT tree_id, a, b, edits, -0.75::DOUBLE * ln(1 - (4.0::DOUBLE / 3) * least(CASE WHEN longest > 0 THEN edits::DOUBLE / longest ELSE 0 END,
    0.75::DOUBLE - 2.220446049250313e-16::DOUBLE)) + 0.0::DOUBLE AS distance FROM pair),
sums AS MATERIALIZED (SELECT tree_id, name, count(*) AS others, sum(distance) AS total FROM (
  SELECT tree_id, a AS name, distance FROM dist UNION ALL SELECT tree_id, b, distance FROM dist) GROUP BY tree_id, name),
crit AS (SELECT d.tree_id, d.a, d.b, (s.others - 1) * distance - s.total - t.total AS q FROM dist d
  JOIN sums s ON s.tree_id = d.tree_id AND s.name = d.a JOIN sums t ON t.tree_id = d.tree_id AND t.name = d.b)"""
# trees that are binary: one root, no circle, two children at each inner node
_BINARY = """kid AS (SELECT tree_id, up, count(*) AS n FROM link WHERE up IS NOT NULL GROUP BY tree_id, up),
bin AS MATERIALIZED (
  SELECT tree_id FROM link GROUP BY tree_id HAVING count(*) FILTER (WHERE up IS NULL) = 1
  EXCEPT SELECT tree_id FROM kid WHERE n <> 2 EXCEPT SELECT tree_id FROM lost)"""
_ALIGNED = f"""{_TREES}, {_BINARY},
fit AS MATERIALIZED (
  SELECT tree_id, bool_and(regexp_matches(residues, '{DNA_WORD}')) AS dna FROM tip GROUP BY tree_id
  HAVING bool_and(residues IS NOT NULL) AND min(length(residues)) = max(length(residues)) AND max(length(residues)) > 0
    AND (bool_and(regexp_matches(residues, '{DNA_WORD}')) OR bool_and(regexp_matches(residues, '{PROTEIN_WORD}')))
  INTERSECT SELECT f.tree_id, f.dna FROM (SELECT tree_id, bool_and(regexp_matches(residues, '{DNA_WORD}')) AS dna FROM tip GROUP BY tree_id) f SEMI JOIN bin USING (tree_id)),
deep AS MATERIALIZED (SELECT w.tree_id, w.node_id, w.levels AS depth, l.up, n.b FROM way w JOIN link l USING (tree_id, node_id) JOIN nod n USING (tree_id, node_id) SEMI JOIN fit USING (tree_id)),
site AS MATERIALIZED (
  SELECT tree_id, node_id, i::INT AS col, substr(residues, i::INT, 1) AS ch FROM (
    SELECT tree_id, node_id, residues, unnest(range(1, length(residues) + 1)) AS i FROM tip SEMI JOIN fit USING (tree_id))),
real AS (SELECT tree_id, col, count(*) FILTER (WHERE ch <> '-') AS total FROM site GROUP BY tree_id, col),
gapped AS (SELECT tree_id, col, total FROM real WHERE total > 0)"""


def _mask_case(alphabet) -> str:
    known = " ".join(f"WHEN '{c}' THEN {alphabet.mask(c)}" for c in alphabet.symbols + alphabet.codes + GAP)
    return f"CASE ch {known} ELSE {alphabet.full_mask} END"


_MASKS = f"""msk AS MATERIALIZED (
  SELECT s.tree_id, s.node_id, s.col, CASE WHEN dna THEN {_mask_case(DNA)} ELSE {_mask_case(PROTEIN)} END AS mask, CASE WHEN dna THEN {DNA.gap_mask} ELSE {PROTEIN.gap_mask} END AS gap,
    (ch <> '-')::INT AS n, g.total FROM site s JOIN gapped g USING (tree_id, col) JOIN fit USING (tree_id)),
top AS (SELECT max(depth) AS d FROM deep)"""


def _upward(leaf: str, names: str, combine: str) -> str:
    """A recursive fold from the deepest level to the roots: leaves wait until their level is reached."""
    carried = ", ".join(f"a.{c}" for c in names.split(", "))
    return f"""up_ AS (
      SELECT (SELECT d FROM top) AS lev, x.tree_id, x.node_id, x.col, deep.depth, deep.up, {leaf}
      FROM msk x JOIN deep ON x.tree_id = deep.tree_id AND x.node_id = deep.node_id
      UNION ALL
      SELECT * FROM (
        SELECT a.lev - 1 AS lev, a.tree_id, a.node_id, a.col, a.depth, a.up, {carried} FROM up_ a WHERE a.lev > 1 AND a.depth < a.lev
        UNION ALL
        SELECT x.lev - 1, x.tree_id, p.node_id, x.col, p.depth, p.up, {combine}
        FROM up_ x JOIN up_ y ON x.tree_id = y.tree_id AND x.up = y.up AND x.col = y.col AND x.node_id < y.node_id
        JOIN deep p ON p.tree_id = x.tree_id AND p.node_id = x.up WHERE x.lev > 1 AND x.depth = x.lev AND y.depth = x.lev)),
    ends AS (SELECT * FROM up_ WHERE lev = 1 AND depth = 1)"""


_FITCH = _upward("mask, 0::BIGINT AS k", "mask, k", "CASE WHEN x.mask & y.mask = 0 THEN x.mask | y.mask ELSE x.mask & y.mask END, x.k + y.k + (x.mask & y.mask = 0)::BIGINT")
_DOLLO = _upward(
    "mask, gap, n, total, 0::BIGINT AS k",
    "mask, gap, n, total, k",
    """CASE WHEN x.mask & y.mask <> 0 THEN x.mask & y.mask WHEN x.n = x.total OR y.n = x.total THEN x.gap ELSE (x.mask | y.mask) & ~x.gap END,
       x.gap, x.n + y.n, x.total,
       x.k + y.k + CASE WHEN x.mask & y.mask <> 0 OR x.n = x.total OR y.n = x.total THEN 0 ELSE 1 END::BIGINT""",
)
_NEAREST = "list_sort(list_transform([" + ", ".join(f"{t}::DOUBLE" for t in TIMES) + "], lambda t: {'o': abs(p.b - t), 't': t}))[1].t"
_SAME, _OTHER = f"-ln(0.25 + 0.75::DOUBLE * exp(-4.0::DOUBLE / 3 * {_NEAREST}))", f"-ln(0.25 - 0.25::DOUBLE * exp(-4.0::DOUBLE / 3 * {_NEAREST}))"
_DOLLO_MODEL = _upward(
    "mask, gap, n, total, 0.0::DOUBLE AS k",
    "mask, gap, n, total, k",
    f"""CASE WHEN x.mask & y.mask <> 0 THEN x.mask & y.mask WHEN x.n = x.total OR y.n = x.total THEN x.gap ELSE (x.mask | y.mask) & ~x.gap END,
       x.gap, x.n + y.n, x.total,
       x.k + y.k + CASE WHEN x.mask & y.mask = x.gap THEN 0 WHEN x.mask & y.mask <> 0 THEN {_SAME} WHEN x.n = x.total OR y.n = x.total THEN 0
         WHEN x.mask = x.gap OR y.mask = x.gap THEN 2.5::DOUBLE * ({_SAME} + 3 * {_OTHER}) / 4 ELSE {_OTHER} END""",
)
_V = [f"CASE WHEN mask = {DNA.gap_mask} OR mask & {1 << i} <> 0 THEN 1.0::DOUBLE ELSE 0.0 END" for i in range(4)]
_SUM = "(" + " + ".join(_V) + ")"
_LEAF = ", ".join(f"exp(-4.0::DOUBLE / 3 * b) * ({v}) + (1 - exp(-4.0::DOUBLE / 3 * b)) / 4 * {_SUM} AS l{i}" for i, v in enumerate(_V))
_BOTH = "(" + " + ".join(f"x.l{i} * y.l{i}" for i in range(4)) + ")"
_JC69 = _upward(
    _LEAF, "l0, l1, l2, l3", ", ".join(f"exp(-4.0::DOUBLE / 3 * p.b) * x.l{i} * y.l{i} + (1 - exp(-4.0::DOUBLE / 3 * p.b)) / 4 * {_BOTH}" for i in range(4))
)

ORACLES = {
    "fasta_roundtrip": f"WITH {_SEQ} SELECT regexp_extract(seq_id, '^\\S*') AS seq_id, 'a>b' AS descr, residues FROM seq",
    "newick_files": f"""WITH RECURSIVE {_TREES}, {_BINARY}
      SELECT nodes, leaves, height FROM (SELECT tree_id, count(*) AS nodes, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM kid WHERE kid.tree_id = nod.tree_id AND kid.up = nod.node_id)) AS leaves,
      round(sum(b), 4) AS height FROM nod SEMI JOIN bin USING (tree_id) GROUP BY tree_id)""",
    "fasta_display": f"""WITH {_SEQ} SELECT seq_id, '>' || seq_id || coalesce(' ' || descr, '') || chr(10) || replace(residues, '-', '') || chr(10) AS text FROM seq""",
    "record_lookup": f"""WITH {_SEQ} SELECT family_id, record_id, seq_id, residues FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY record_id) AS rn
      FROM seq WHERE seq_id = (SELECT min(seq_id) FROM seq)) WHERE rn = 1""",
    "rounded_scoring": f"""WITH RECURSIVE {_TREES}, t(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TIMES)}),
      r AS (SELECT tree_id, node_id, t, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY abs(b - t), t) AS rn FROM nod, t),
      e AS (SELECT tree_id, node_id, exp(-t) AS e1, exp(-t * 1.5::DOUBLE) AS e2 FROM r WHERE rn = 1)
      SELECT tree_id, node_id, round(-ln(0.25 + 0.25::DOUBLE * e1 + 0.5::DOUBLE * e2), 2) AS same, round(-ln(0.25 + 0.25::DOUBLE * e1 - 0.5::DOUBLE * e2), 2) AS transition,
        round(-ln(0.25 - 0.25::DOUBLE * e1), 2) AS transversion FROM e""",
    "node_relations": f"""WITH RECURSIVE {_TREES}, k AS (SELECT tree_id, up, count(*) AS n FROM link WHERE up IS NOT NULL GROUP BY tree_id, up)
      SELECT l.tree_id, l.node_id, l.up AS parent, CASE WHEN k.n = 2 THEN s.node_id END AS sibling, coalesce(c.n, 0) AS children
      FROM link l LEFT JOIN k ON k.tree_id = l.tree_id AND k.up = l.up LEFT JOIN k c ON c.tree_id = l.tree_id AND c.up = l.node_id
      LEFT JOIN link s ON k.n = 2 AND s.tree_id = l.tree_id AND s.up = l.up AND s.node_id <> l.node_id""",
    "subtree_alignments": f"""WITH RECURSIVE {_TREES}, fit AS MATERIALIZED (
        SELECT tree_id FROM tip GROUP BY tree_id HAVING bool_and(residues IS NOT NULL) AND min(length(residues)) = max(length(residues)) AND max(length(residues)) > 0
        AND (bool_and(regexp_matches(residues, '{DNA_WORD}')) OR bool_and(regexp_matches(residues, '{PROTEIN_WORD}')))),
      r AS MATERIALIZED (SELECT DISTINCT w.tree_id, w.path[2] AS node_id, t.node_id AS leaf, t.seq_id, t.residues FROM tip t SEMI JOIN fit USING (tree_id)
        JOIN way w USING (tree_id, node_id) LEFT JOIN lost USING (tree_id, node_id) WHERE lost.node_id IS NULL AND w.levels >= 2),
      s AS (SELECT tree_id, node_id, leaf, seq_id, i::INT AS col, substr(residues, i::INT, 1) AS ch FROM (SELECT *, unnest(range(1, length(residues) + 1)) AS i FROM r)),
      g AS (SELECT tree_id, node_id, col FROM s GROUP BY ALL HAVING bool_or(ch <> '-'))
      SELECT tree_id, node_id, seq_id, string_agg(ch, '' ORDER BY col) AS residues FROM s SEMI JOIN g USING (tree_id, node_id, col) GROUP BY tree_id, node_id, leaf, seq_id
      UNION ALL SELECT tree_id, node_id, seq_id, '' FROM r WHERE NOT regexp_matches(residues, '[^-]')
        AND NOT EXISTS (SELECT 1 FROM g WHERE g.tree_id = r.tree_id AND g.node_id = r.node_id)""",
    "stream_symbol_windows": """WITH c AS (SELECT loaded_at, unnest(string_split(translate(upper(residues), '_*-', ''), '')) AS symbol FROM sequences WHERE loaded_at IS NOT NULL)
      SELECT CAST(floor(epoch_us(loaded_at)::DOUBLE / 2592000000000) AS BIGINT) * 2592000 AS begins, symbol, count(*) AS letters
      FROM c WHERE symbol <> '' GROUP BY ALL""",
    "fasta_normalise": f"WITH {_SEQ} SELECT record_id, seq_id, residues FROM seq",
    "family_alphabets": f"WITH {_SEQ}, {_FACTS} SELECT family_id, records, aligned, alphabet FROM facts",
    "gapless": f"WITH {_SEQ} SELECT record_id, replace(residues, '-', '') AS residues FROM seq",
    "gap_columns": f"WITH {_GONE} SELECT family_id, col FROM gone",
    "remove_gap_columns": f"""WITH {_GONE}, kept AS (
      SELECT c.record_id, c.family_id, string_agg(c.ch, '' ORDER BY c.col) AS r FROM each c ANTI JOIN gone g ON c.family_id = g.family_id AND c.col = g.col GROUP BY c.record_id, c.family_id),
      owner AS (SELECT record_id, family_id FROM seq UNION ALL SELECT record_id, family_id || '/' || (record_id % 3)::VARCHAR FROM seq JOIN facts USING (family_id) WHERE aligned)
      SELECT record_id, family_id, coalesce(kept.r, '') AS residues FROM owner LEFT JOIN kept USING (record_id, family_id)""",
    "align_map": f"""WITH {_CELLS}, p AS (SELECT record_id, col, ch, sum((ch <> '-')::INT) OVER (PARTITION BY record_id ORDER BY col) - 1 AS pos FROM cell),
      t AS (SELECT record_id, string_agg(CASE WHEN ch = '-' THEN '-' ELSE pos::VARCHAR END, ',' ORDER BY col) AS map FROM p GROUP BY record_id)
      SELECT record_id, coalesce(t.map, '') AS map FROM seq LEFT JOIN t USING (record_id)""",
    "align_map_roundtrip": f"WITH {_SEQ} SELECT record_id, residues FROM seq",
    "symbol_counts": f"WITH {_CELLS} SELECT family_id, ch, count(*) AS n FROM cell GROUP BY family_id, ch",
    "empirical_freqs": f"""WITH {_CELLS}, {_LUT},
      x AS (SELECT family_id, symbol, sum(n::DOUBLE / size) AS x FROM (SELECT family_id, ch, count(*) AS n FROM cell WHERE ch <> '-' GROUP BY family_id, ch)
        JOIN facts USING (family_id) JOIN lut USING (alphabet, ch) GROUP BY family_id, symbol),
      every AS (SELECT family_id, symbol FROM facts JOIN (SELECT DISTINCT alphabet, symbol FROM lut) USING (alphabet)),
      f AS (SELECT family_id, symbol, coalesce(x, 1.0::DOUBLE) AS x FROM every LEFT JOIN x USING (family_id, symbol))
      SELECT family_id, symbol, round(x / sum(x) OVER (PARTITION BY family_id), 6) AS freq FROM f""",
    "symbol_sets": f"""WITH {_CELLS}, {_LUT}, z AS (SELECT DISTINCT alphabet, ch, size FROM lut)
      SELECT family_id, size AS members, count(*) AS letters FROM cell JOIN facts USING (family_id) JOIN z USING (alphabet, ch) GROUP BY family_id, size""",
    "tip_problems": f"""WITH RECURSIVE {_TREES}
      SELECT DISTINCT tree_id, seq_id, 'no sequence' AS problem FROM tip WHERE residues IS NULL
      UNION ALL SELECT t.tree_id, nam.seq_id, 'no leaf' FROM nam JOIN (SELECT DISTINCT tree_id, family_id FROM tip) t USING (family_id)
      WHERE NOT EXISTS (SELECT 1 FROM tip WHERE tip.tree_id = t.tree_id AND tip.seq_id = nam.seq_id)""",
    "pair_distances": f"WITH RECURSIVE {_PAIRS} SELECT tree_id, a, b, edits, round(distance, 6) AS distance FROM dist",
    "distance_row_sums": f"WITH RECURSIVE {_PAIRS} SELECT tree_id, name, others, round(total, 5) AS total FROM sums",
    "nj_q_matrix": f"WITH RECURSIVE {_PAIRS} SELECT tree_id, a, b, round(q, 4) AS q FROM crit",
    "nj_first_pair": f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY round(q, 4), a, b) AS rn FROM crit)
      SELECT tree_id, a, b FROM r WHERE rn = 1""",
    "tree_facts": f"WITH RECURSIVE {_TREES} SELECT tree_id, count(*) AS nodes, count(*) FILTER (WHERE is_leaf) AS leaves, round(sum(b), 4) AS height FROM nod GROUP BY tree_id",
    "blen_percentiles": f"""WITH RECURSIVE {_TREES}, q AS (SELECT tree_id, quantile_cont(raw_blen, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS q FROM nod
        WHERE raw_blen IS NOT NULL AND NOT isnan(raw_blen) GROUP BY tree_id)
      SELECT tree_id, round(q[1], 6) AS p1, round(q[2], 6) AS p2, round(q[3], 6) AS p3, round(q[4], 6) AS p4 FROM q""",
    "leaf_descendants": f"""WITH RECURSIVE {_TREES}, e AS (SELECT tree_id, node_id AS leaf, unnest(path) AS node_id FROM way)
      SELECT e.tree_id, e.node_id, n.label FROM e JOIN nod n ON n.tree_id = e.tree_id AND n.node_id = e.leaf WHERE n.is_leaf""",
    "partitions": f"""WITH RECURSIVE {_TREES}, {_BINARY},
      lab AS (SELECT tree_id, node_id, label FROM nod ANTI JOIN kid ON kid.tree_id = nod.tree_id AND kid.up = nod.node_id),
      e AS (SELECT way.tree_id, label, unnest(path) AS node_id FROM way JOIN lab USING (tree_id, node_id) SEMI JOIN bin USING (tree_id)),
      s AS (SELECT tree_id, node_id, list_sort(list(DISTINCT label)) AS side FROM e GROUP BY tree_id, node_id),
      every AS (SELECT s.tree_id, s.side FROM s JOIN link USING (tree_id, node_id) WHERE up IS NULL),
      below AS (SELECT s.tree_id, s.side FROM s JOIN link USING (tree_id, node_id) WHERE up IS NOT NULL)
      SELECT DISTINCT tree_id, array_to_string(side, ',') AS leaves FROM (SELECT * FROM below UNION ALL
        SELECT b.tree_id, list_sort(list_filter(e.side, lambda v: NOT list_contains(b.side, v))) FROM below b JOIN every e USING (tree_id))""",
    "spr_moves": f"""WITH RECURSIVE {_TREES}, {_BINARY},
      size AS (SELECT tree_id, node_id, count(*) AS n FROM (SELECT tree_id, unnest(path) AS node_id FROM way SEMI JOIN bin USING (tree_id)) GROUP BY tree_id, node_id),
      full_ AS (SELECT tree_id, count(*) AS n FROM size GROUP BY tree_id)
      SELECT f.tree_id, coalesce(sum(f.n - s.n - 3) FILTER (WHERE w.levels > 2), 0)::BIGINT AS moves
      FROM full_ f JOIN size s USING (tree_id) JOIN way w USING (tree_id, node_id) GROUP BY f.tree_id""",
    "newick_roundtrip": f"""WITH RECURSIVE {_TREES}, {_BINARY}
      SELECT tree_id, count(*) AS nodes, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM kid WHERE kid.tree_id = nod.tree_id AND kid.up = nod.node_id)) AS leaves,
      round(sum(b), 4) AS height FROM nod SEMI JOIN bin USING (tree_id) GROUP BY tree_id""",
    "nearest_time": f"""WITH RECURSIVE {_TREES}, t(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TIMES)}),
      r AS (SELECT tree_id, node_id, t, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY abs(b - t), t) AS rn FROM nod, t)
      SELECT tree_id, node_id, t AS time FROM r WHERE rn = 1""",
    "jc69_p": f"""WITH RECURSIVE {_TREES} SELECT tree_id, node_id, round(0.25 + 0.75::DOUBLE * exp(b * (-4.0::DOUBLE / 3)), 8) AS same,
      round(0.25 - 0.25::DOUBLE * exp(b * (-4.0::DOUBLE / 3)), 8) AS other FROM nod""",
    "k80_p": f"""WITH RECURSIVE {_TREES}, t AS (SELECT tree_id, node_id, exp(-b) AS e1, exp(-b * 1.5::DOUBLE) AS e2 FROM nod)
      SELECT tree_id, node_id, round(0.25 + 0.25::DOUBLE * e1 + 0.5::DOUBLE * e2, 8) AS same, round(0.25 + 0.25::DOUBLE * e1 - 0.5::DOUBLE * e2, 8) AS transition,
      round(0.25 - 0.25::DOUBLE * e1, 8) AS transversion FROM t""",
    "model_scoring": f"""WITH RECURSIVE {_TREES}, t(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TIMES)}),
      r AS (SELECT tree_id, node_id, t, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY abs(b - t), t) AS rn FROM nod, t),
      c AS (SELECT tree_id, node_id, -ln(0.25 - 0.25::DOUBLE * exp(t * (-4.0::DOUBLE / 3))) AS c FROM r WHERE rn = 1)
      SELECT tree_id, node_id, round(2.5::DOUBLE * c * 0.75, 6) AS open, round(c * 0.75::DOUBLE, 6) AS ext, round(c * 0.75::DOUBLE, 6) AS mean,
        round(c, 6) AS mismatch, 0.0::DOUBLE AS within FROM c""",
    "model_rates": osql.model_rates(),
    "traversals": osql.traversals(_TREES, _BINARY),
    "tree_checks": osql.tree_checks(_TREES, _BINARY),
    "node_maps": osql.node_maps(_TREES, _BINARY, DNA_WORD, PROTEIN_WORD),
    "nj_branches": osql.nj_branches(_PAIRS),
    "rf_to_nj": osql.rf_to_nj(_PAIRS, _BINARY),
    "model_loglik": osql.loglik(_ALIGNED, _MASKS, _upward),
    "indel_loglik": osql.indel(_ALIGNED, _MASKS, _upward),
    "site_patterns": f"""WITH RECURSIVE {_ALIGNED}, all_ AS (SELECT tree_id, bool_and(residues IS NOT NULL) AND min(length(residues)) = max(length(residues)) AND max(length(residues)) > 0
        AND (bool_and(regexp_matches(residues, '{DNA_WORD}')) OR bool_and(regexp_matches(residues, '{PROTEIN_WORD}'))) AS good FROM tip GROUP BY tree_id),
      s2 AS (SELECT tree_id, seq_id, i::INT AS col, substr(residues, i::INT, 1) AS ch FROM (SELECT t.tree_id, t.seq_id, t.residues, unnest(range(1, length(t.residues) + 1)) AS i
        FROM tip t JOIN all_ USING (tree_id) WHERE good)),
      p AS (SELECT tree_id, col, string_agg(ch, '' ORDER BY seq_id, ch) AS p FROM s2 GROUP BY tree_id, col)
      SELECT tree_id, count(*) AS columns, count(DISTINCT p) AS patterns FROM p WHERE regexp_matches(p, '[^-]') GROUP BY tree_id""",
    "fitch_score": f"WITH RECURSIVE {_ALIGNED}, {_MASKS}, {_FITCH} SELECT tree_id, sum(k)::BIGINT AS score, count(*) AS columns FROM ends GROUP BY tree_id",
    "dollo_score": f"WITH RECURSIVE {_ALIGNED}, {_MASKS}, {_DOLLO} SELECT tree_id, sum(k)::BIGINT AS score FROM ends GROUP BY tree_id",
    "dollo_model_score": f"""WITH RECURSIVE {_ALIGNED}, {_MASKS}, {_DOLLO_MODEL}
      SELECT tree_id, round(sum(k), 4) AS score FROM ends SEMI JOIN (SELECT tree_id FROM fit WHERE dna) USING (tree_id) GROUP BY tree_id""",
    "jc69_loglik": f"""WITH RECURSIVE {_ALIGNED}, {_MASKS}, {_JC69}
      SELECT tree_id, round(sum(ln((l0 + l1 + l2 + l3) / 4)), 4) AS logl FROM ends SEMI JOIN (SELECT tree_id FROM fit WHERE dna) USING (tree_id) GROUP BY tree_id""",
    "stirling": f"""WITH {_SEQ}, {_FACTS}, n AS (SELECT family_id, longest::DOUBLE AS n FROM facts WHERE longest > 0)
      SELECT family_id, round(n * ln(n) - n + ln(n) / 2 + 1 / (12 * n) + 0.9189385332046727::DOUBLE, 6) AS log_factorial FROM n""",
}
