"""Facts, evidence graphs, compression and answers."""

from pyspark.sql import functions as F

from catalog.fixtures import view
from catalog.registry import query
from tracewell.operators import answers, facts, graph
from tracewell.operators.graph import Representation
from tracewell.session import cut_lineage

ACTIVE = """
SELECT p.patient_id, p.concept_type, p.day, MAX(f.fact_id) AS fact_id
FROM {f_points} p LEFT JOIN (
  SELECT f.*, g.day AS rday FROM {f_facts} f LEFT JOIN {f_facts} g ON g.revises = f.fact_id) f
 ON f.patient_id = p.patient_id AND f.concept_type = p.concept_type AND f.day <= p.day AND (f.rday IS NULL OR f.rday > p.day)
GROUP BY p.patient_id, p.concept_type, p.day"""


@query("d1_active_state", ACTIVE)
def d1(spark, sf):
    return facts.active_state(view(spark, sf, "f_facts"), view(spark, sf, "f_points")).drop("value")


@query("d1_active_counts", f"""
SELECT concept_type, COUNT(*) AS n_points, COUNT(fact_id) AS n_active, COUNT(DISTINCT fact_id) AS n_facts
FROM ({ACTIVE}) a GROUP BY concept_type""")
def d1_counts(spark, sf):
    return facts.active_state_counts(view(spark, sf, "f_facts"), view(spark, sf, "f_points"))


def base_graph(spark, sf, written=lambda nodes: nodes) -> Representation:
    """Mention graph with the confidences of the fixture; `written` writes the nodes, which the edges are then read from."""
    m = view(spark, sf, "f_mentions")
    nodes = m.select("id", F.lit("mention").alias("kind"), "fact_id", "patient_id", "concept_type", "value", "day",
                     "confidence", "note_id", F.lit(0).alias("ord_group"), "ord",
                     F.lit(None).cast("string").alias("approx_relation"), F.lit(None).cast("int").alias("approx_anchor_day"))
    nodes = written(nodes)
    e = view(spark, sf, "f_edges").select(
        F.lit("revises").alias("type"), F.col("to_fact_id").cast("string").alias("source"),
        F.col("from_fact_id").cast("string").alias("target"), "day")
    derived = nodes.select(F.lit("derived_from").alias("type"), F.col("id").alias("source"), F.col("note_id").alias("target"))
    return Representation(nodes, derived.unionByName(e, allowMissingColumns=True))


def noted(spark, sf):
    """Notes with the array of facts they mention."""
    docs = view(spark, sf, "documents")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))
    top = view(spark, sf, "events").agg(F.max("event_id").alias("top"))
    ids = lambda start: F.when(start <= F.col("top"), F.sequence(start, F.col("top"), F.col("n"))).otherwise(
        F.array().cast("array<bigint>"))
    return view(spark, sf, "f_notes").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(top)).withColumn(
        "mentioned_fact_ids", F.concat(ids(F.col("ord")), ids((F.col("ord") + 1) % F.col("n"))))


NORMAL = """ROUND(CASE n.lang WHEN 'en' THEN CAST(0.85 AS DOUBLE) WHEN 'fr' THEN CAST(0.75 AS DOUBLE) WHEN 'de' THEN CAST(0.60 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END
  + CAST(0.08 AS DOUBLE) * SQRT(-2 * LN(1 - CAST(CAST(CONCAT('0x', SUBSTR(MD5(CONCAT('11|', m.note_id, '|', m.fact_id)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296))
  * COS(CAST(6.283185307179586 AS DOUBLE) * (CAST(CAST(CONCAT('0x', SUBSTR(MD5(CONCAT('11|', m.note_id, '|', m.fact_id)), 9, 8)) AS BIGINT) AS DOUBLE) / 4294967296)), 6)"""


@query("d2_evidence_graph", f"""
SELECT m.id, m.fact_id, m.patient_id, m.concept_type, m.value, m.day, m.note_id,
       GREATEST(CAST(0.05 AS DOUBLE), LEAST(CAST(0.99 AS DOUBLE), {NORMAL})) AS confidence
FROM {{f_mentions}} m JOIN {{documents}} n ON CAST(n.doc_id AS VARCHAR) = m.note_id""")
def d2(spark, sf):
    rep = graph.build_evidence_graph(view(spark, sf, "f_facts"), view(spark, sf, "f_edges"), noted(spark, sf))
    return rep.nodes.select("id", "fact_id", "patient_id", "concept_type", "value", "day", "note_id", "confidence")


@query("d2_graph_edges", """
SELECT type, COUNT(*) AS n, COUNT(DISTINCT source) AS n_sources, COUNT(DISTINCT target) AS n_targets FROM (
  SELECT 'derived_from' AS type, id AS source, note_id AS target FROM {f_mentions}
  UNION ALL SELECT 'revises', CAST(to_fact_id AS VARCHAR), CAST(from_fact_id AS VARCHAR) FROM {f_edges}) e GROUP BY type""")
def d2_edges(spark, sf):
    rep = graph.build_evidence_graph(view(spark, sf, "f_facts"), view(spark, sf, "f_edges"), noted(spark, sf))
    return rep.edges.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"),
                                         F.count_distinct("target").alias("n_targets"))


@query("d3_confidence_by_style", f"""
SELECT n.lang AS lang, COUNT(*) AS n, ROUND(AVG(GREATEST(CAST(0.05 AS DOUBLE), LEAST(CAST(0.99 AS DOUBLE), {NORMAL}))), 4) AS mean_confidence
FROM {{f_mentions}} m JOIN {{documents}} n ON CAST(n.doc_id AS VARCHAR) = m.note_id GROUP BY n.lang""")
def d3(spark, sf):
    from tracewell.functions.hashing import draw_key
    styles = {"en": 0.85, "fr": 0.75, "de": 0.60, "es": 0.55}
    m = view(spark, sf, "f_mentions").join(
        view(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("note_id"), "lang"), "note_id")
    c = graph.mention_confidence(F.col("lang"), draw_key(11, "note_id", "fact_id"), styles)
    return m.withColumn("c", c).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("c"), 4).alias("mean_confidence"))


@query("d4_representation_size", """
SELECT (SELECT COUNT(*) FROM {f_mentions}) AS n_nodes,
       (SELECT COUNT(*) FROM {f_mentions}) + (SELECT COUNT(*) FROM {f_edges}) AS n_edges,
       2 * (SELECT COUNT(*) FROM {f_mentions}) + (SELECT COUNT(*) FROM {f_edges}) AS total""")
def d4(spark, sf):
    return graph.representation_size(base_graph(spark, sf)).drop("bytes")


@query("d5_recall_fixed_window", """
SELECT ROUND(CAST(SUM(CASE WHEN r <= 2 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS provenance_recall FROM (
  SELECT id, ROW_NUMBER() OVER (PARTITION BY patient_id, concept_type ORDER BY day DESC, ord) AS r FROM {f_mentions}) x""")
def d5(spark, sf):
    base = base_graph(spark, sf)
    return graph.provenance_recall(graph.fixed_window(base, 2), base).select(F.round("provenance_recall", 6).alias("provenance_recall"))


STATES = """
SELECT fact_id, CONCAT('state__', CAST(fact_id AS VARCHAR)) AS id, MIN(patient_id) AS patient_id, MIN(concept_type) AS concept_type,
       MIN(value) AS value, MIN(day) AS day, MAX(confidence) AS confidence, MIN(ord) AS ord FROM {f_mentions} GROUP BY fact_id"""


@query("d6_aggregate_mentions", f"SELECT id, fact_id, patient_id, concept_type, value, day, ROUND(confidence, 6) AS confidence FROM ({STATES}) s")
def d6(spark, sf):
    rep = graph.aggregate_mentions(base_graph(spark, sf))
    return rep.nodes.select("id", "fact_id", "patient_id", "concept_type", "value", "day", F.round("confidence", 6).alias("confidence"))


@query("d6_membership_edges", """
SELECT CONCAT('state__', CAST(fact_id AS VARCHAR)) AS source, note_id AS target, id AS orig_mention_id, day AS mention_day FROM {f_mentions}""")
def d6_edges(spark, sf):
    rep = graph.aggregate_mentions(base_graph(spark, sf))
    return rep.edges.where("type = 'membership'").select("source", "target", "orig_mention_id", "mention_day")


CHAIN = """
WITH RECURSIVE s AS (""" + STATES + """),
heads AS (SELECT s.fact_id AS head FROM s WHERE s.fact_id IN (SELECT to_fact_id FROM {f_edges}) AND s.fact_id NOT IN (SELECT from_fact_id FROM {f_edges})),
c(head, cur, depth) AS (
  SELECT head, head, 0 FROM heads
  UNION ALL SELECT c.head, e.from_fact_id, c.depth + 1 FROM c JOIN {f_edges} e ON e.to_fact_id = c.cur)
"""


@query("d7_revision_chains", CHAIN + "SELECT head, COUNT(*) AS n_facts, MAX(depth) AS depth, MIN(cur) AS oldest FROM c GROUP BY head")
def d7(spark, sf):
    parents, heads = graph.chain_heads(graph.aggregate_mentions(base_graph(spark, sf)))
    return graph.revision_chains(parents, heads).groupBy("head").agg(
        F.count("*").alias("n_facts"), F.max("depth").alias("depth"), F.min("fact_id").alias("oldest"))


@query("d7_collapse_revisions", CHAIN + """
SELECT CONCAT('revstate__', CAST(c.head AS VARCHAR)) AS id, MAX(h.patient_id) AS patient_id, MAX(h.concept_type) AS concept_type,
       MAX(h.value) AS value, MAX(h.day) AS day, COUNT(*) AS n_history, ROUND(SUM(m.confidence), 4) AS history_confidence
FROM c JOIN s h ON h.fact_id = c.head JOIN s m ON m.fact_id = c.cur GROUP BY c.head
UNION ALL SELECT id, patient_id, concept_type, value, day, 0, 0 FROM s WHERE fact_id NOT IN (SELECT cur FROM c)""")
def d7_collapse(spark, sf):
    rep = graph.collapse_revisions(graph.aggregate_mentions(base_graph(spark, sf)))
    h = rep.history.groupBy(F.col("node_id").alias("id")).agg(
        F.count("*").alias("n_history"), F.round(F.sum("confidence"), 4).alias("history_confidence"))
    return rep.nodes.join(h, "id", "left").select(
        "id", "patient_id", "concept_type", "value", "day", F.coalesce("n_history", F.lit(0)).alias("n_history"),
        F.coalesce("history_confidence", F.lit(0.0)).alias("history_confidence"))


APPROX = """
a AS (SELECT s.*, MIN(CASE WHEN ROUND(confidence, 6) >= 0.65 THEN day END) OVER (PARTITION BY patient_id, concept_type) AS anchor FROM s)
"""


@query("d8_approximate_time", "WITH s AS (" + STATES + ")," + APPROX + """
SELECT id, CASE WHEN ROUND(confidence, 6) >= 0.65 OR anchor IS NULL THEN day END AS day,
       CASE WHEN ROUND(confidence, 6) < 0.65 AND anchor IS NOT NULL THEN CASE WHEN day < anchor THEN 'BEFORE' WHEN day > anchor THEN 'AFTER' ELSE 'OVERLAP' END END AS approx_relation,
       CASE WHEN ROUND(confidence, 6) < 0.65 THEN anchor END AS approx_anchor_day FROM a""")
def d8(spark, sf):
    rep = graph.aggregate_mentions(base_graph(spark, sf))
    rep = rep._replace(nodes=rep.nodes.withColumn("confidence", F.round("confidence", 6)))
    return graph.approximate_time(rep, 0.65).nodes.select("id", "day", "approx_relation", "approx_anchor_day")


@query("d9_fixed_window", """
SELECT id, patient_id, concept_type, day FROM (
  SELECT m.*, ROW_NUMBER() OVER (PARTITION BY patient_id, concept_type ORDER BY day DESC, ord) AS r FROM {f_mentions} m) x WHERE r <= 2""")
def d9(spark, sf):
    return graph.fixed_window(base_graph(spark, sf), 2).nodes.select("id", "patient_id", "concept_type", "day")


@query("d10_query_active_value", "WITH s AS (" + STATES + ")," + APPROX + """,
e AS (SELECT patient_id, concept_type, value, ord, ROUND(confidence, 6) < 0.65 AND anchor IS NOT NULL AS vague, day, anchor FROM a),
j AS (SELECT p.patient_id, p.concept_type, p.day AS q, e.value, e.ord,
        CASE WHEN e.patient_id IS NULL THEN NULL WHEN NOT vague THEN CASE WHEN e.day <= p.day THEN e.day END
             WHEN e.day <= anchor AND p.day >= anchor THEN anchor END AS cand,
        COALESCE(vague AND ((e.day > anchor AND p.day > anchor) OR (e.day < anchor AND p.day < anchor)), FALSE) AS open
      FROM {f_points} p LEFT JOIN e ON e.patient_id = p.patient_id AND e.concept_type = p.concept_type)
SELECT patient_id, concept_type, q AS day, ARG_MAX(value, ROW(cand, ord)) FILTER (WHERE cand IS NOT NULL) AS answer,
       CASE WHEN COUNT(cand) > 0 THEN 'value' WHEN BOOL_OR(open) THEN 'abstain' ELSE 'none' END AS status
FROM j GROUP BY patient_id, concept_type, q""")
def d10(spark, sf):
    rep = graph.aggregate_mentions(base_graph(spark, sf))
    rep = rep._replace(nodes=rep.nodes.withColumn("confidence", F.round("confidence", 6)))
    return answers.query_active_value(answers.entries(graph.approximate_time(rep, 0.65)), view(spark, sf, "f_points"))


def _unit(args, part=0):
    return f"(CAST(CAST(CONCAT('0x', SUBSTR(MD5(CONCAT({args})), {8 * part + 1}, 8)) AS BIGINT) AS DOUBLE) / 4294967296)"


@query("d11_sample_query_points", f"""
SELECT DISTINCT f.patient_id, c.concept_type, CAST(lo + FLOOR({_unit("'11|', f.patient_id, '|', c.concept_type, '|', i.i")} * (hi + 3 - lo + 1)) AS INT) AS day
FROM (SELECT patient_id, MIN(day) AS lo, MAX(day) AS hi FROM {{f_facts}} GROUP BY patient_id) f
CROSS JOIN (VALUES ('diagnosis'), ('treatment')) AS c(concept_type) CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS i(i)""")
def d11(spark, sf):
    return facts.sample_query_points(view(spark, sf, "f_facts"), ["diagnosis", "treatment"], 6, 11)


@query("d12_query_subsets", """
SELECT p.patient_id, p.concept_type, p.day, p.patient_id IN (SELECT patient_id FROM {f_edges}) AS revision_patient,
       EXISTS (SELECT 1 FROM {f_edges} e JOIN {f_facts} f ON f.fact_id = e.to_fact_id
               WHERE e.patient_id = p.patient_id AND f.concept_type = p.concept_type AND e.day <= p.day) AS post_revision
FROM {f_points} p""")
def d12(spark, sf):
    return facts.query_subsets(view(spark, sf, "f_points"), view(spark, sf, "f_facts"), view(spark, sf, "f_edges"))


@query("d13_evaluate_baselines", f"""
WITH act AS (SELECT a.patient_id, a.concept_type, a.day, f.value AS truth FROM ({ACTIVE}) a LEFT JOIN {{f_facts}} f ON f.fact_id = a.fact_id),
w AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY patient_id, concept_type ORDER BY day DESC, ord) AS r FROM {{f_mentions}} m),
e AS (SELECT 'uncompressed_baseline' AS representation, patient_id, concept_type, value, day, ord FROM w
      UNION ALL SELECT 'fixed_window_baseline', patient_id, concept_type, value, day, ord FROM w WHERE r <= 2
      UNION ALL SELECT 'aggregation', patient_id, concept_type, value, day, ord FROM ({STATES}) s),
ans AS (SELECT n.representation, t.patient_id, t.concept_type, t.day, MAX(t.truth) AS truth, ARG_MAX(e.value, ROW(e.day, e.ord)) AS answer
        FROM act t CROSS JOIN (SELECT DISTINCT representation FROM e) n
        LEFT JOIN e ON e.representation = n.representation AND e.patient_id = t.patient_id AND e.concept_type = t.concept_type AND e.day <= t.day
        GROUP BY n.representation, t.patient_id, t.concept_type, t.day),
sub AS (SELECT ans.*, patient_id IN (SELECT patient_id FROM {{f_edges}}) AS rp,
        EXISTS (SELECT 1 FROM {{f_edges}} e JOIN {{f_facts}} f ON f.fact_id = e.to_fact_id
                WHERE e.patient_id = ans.patient_id AND f.concept_type = ans.concept_type AND e.day <= ans.day) AS pr FROM ans),
long AS (SELECT representation, 'all' AS subset, truth, answer FROM sub UNION ALL SELECT representation, 'revision_patients', truth, answer FROM sub WHERE rp
         UNION ALL SELECT representation, 'post_revision', truth, answer FROM sub WHERE pr)
SELECT representation, subset, COUNT(*) AS n, COUNT(*) FILTER (WHERE answer IS NOT DISTINCT FROM truth) AS correct,
       COUNT(*) FILTER (WHERE answer IS NULL AND truth IS NOT NULL) AS no_value,
       ROUND(CAST(COUNT(*) FILTER (WHERE answer IS NOT DISTINCT FROM truth) AS DOUBLE) / COUNT(*), 6) AS accuracy_on_resolved
FROM long GROUP BY representation, subset""")
def d13(spark, sf):
    base = base_graph(spark, sf, cut_lineage)
    reps = {"uncompressed_baseline": base, "aggregation": graph.aggregate_mentions(base), "fixed_window_baseline": graph.fixed_window(base, 2)}
    out = answers.evaluate_representations(reps, view(spark, sf, "f_facts"), view(spark, sf, "f_edges"), view(spark, sf, "f_points"))
    return out.select("representation", "subset", "n", "correct", "no_value", F.round("accuracy_on_resolved", 6).alias("accuracy_on_resolved"))


# Entries of all five representations; `since` is the day from which an entry counts.
ALL_ANSWERS = CHAIN.replace("{f_mentions}", "(SELECT * REPLACE (ROUND(confidence, 6) AS confidence) FROM {f_mentions}) m") + f""",
act AS (SELECT a.patient_id, a.concept_type, a.day, f.value AS truth FROM ({ACTIVE}) a LEFT JOIN {{f_facts}} f ON f.fact_id = a.fact_id),
w AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY patient_id, concept_type ORDER BY day DESC, ord) AS r FROM {{f_mentions}} m),
ch AS (SELECT c.head, c.depth, s.*, MAX(c.depth) OVER (PARTITION BY c.head) AS oldest FROM c JOIN s ON s.fact_id = c.cur),
hist AS (SELECT ARG_MAX(patient_id, depth) OVER k AS patient_id, ARG_MAX(concept_type, depth) OVER k AS concept_type, value, day, confidence, 1 AS og, ARG_MIN(ord, depth) OVER k AS ord, oldest - depth AS pos
         FROM ch WINDOW k AS (PARTITION BY head)),
rev AS (SELECT patient_id, concept_type, value, day, confidence, 0 AS og, ord, 0 AS pos FROM s WHERE fact_id NOT IN (SELECT cur FROM c) UNION ALL SELECT * FROM hist),
anchored AS (SELECT *, MIN(CASE WHEN confidence >= 0.65 THEN day END) OVER (PARTITION BY patient_id, concept_type) AS anchor FROM rev),
vague AS (SELECT *, confidence < 0.65 AND anchor IS NOT NULL AS lossy, CASE WHEN day < anchor THEN 'BEFORE' WHEN day > anchor THEN 'AFTER' ELSE 'OVERLAP' END AS rel FROM anchored),
e AS (SELECT 'uncompressed_baseline' AS representation, patient_id, concept_type, value, day AS since, 0 AS og, ord, 0 AS pos, CAST(NULL AS VARCHAR) AS rel, CAST(NULL AS INT) AS anchor FROM w
      UNION ALL SELECT 'fixed_window_baseline', patient_id, concept_type, value, day, 0, ord, 0, NULL, NULL FROM w WHERE r <= 2
      UNION ALL SELECT 'aggregation', patient_id, concept_type, value, day, 0, ord, 0, NULL, NULL FROM s
      UNION ALL SELECT 'revision_representation', patient_id, concept_type, value, day, og, ord, pos, NULL, NULL FROM rev
      UNION ALL SELECT 'temporal_approximation', patient_id, concept_type, value, CASE WHEN NOT lossy THEN day WHEN rel <> 'AFTER' THEN anchor END, og, ord, pos, CASE WHEN lossy THEN rel END, CASE WHEN lossy THEN anchor END FROM vague),
ans AS (SELECT n.representation, t.patient_id, t.concept_type, t.day, MAX(t.truth) AS truth, ARG_MAX(e.value, ROW(e.since, e.og, e.ord, e.pos)) FILTER (WHERE e.since <= t.day) AS answer,
        COUNT(*) FILTER (WHERE e.since <= t.day) AS n_found, COUNT(*) FILTER (WHERE (e.rel = 'BEFORE' AND e.anchor > t.day) OR (e.rel = 'AFTER' AND e.anchor < t.day)) AS n_open
        FROM act t CROSS JOIN (SELECT DISTINCT representation FROM e) n
        LEFT JOIN e ON e.representation = n.representation AND e.patient_id = t.patient_id AND e.concept_type = t.concept_type
        GROUP BY n.representation, t.patient_id, t.concept_type, t.day),
sub AS (SELECT ans.*, CASE WHEN n_found = 0 AND n_open > 0 THEN 'abstain' WHEN answer IS NOT DISTINCT FROM truth THEN 'correct' WHEN answer IS NULL THEN 'no_value' ELSE 'wrong_value' END AS outcome,
        patient_id IN (SELECT patient_id FROM {{f_edges}}) AS rp,
        EXISTS (SELECT 1 FROM {{f_edges}} e JOIN {{f_facts}} f ON f.fact_id = e.to_fact_id
                WHERE e.patient_id = ans.patient_id AND f.concept_type = ans.concept_type AND e.day <= ans.day) AS pr FROM ans),
long AS (SELECT representation, 'all' AS subset, outcome FROM sub UNION ALL SELECT representation, 'revision_patients', outcome FROM sub WHERE rp
         UNION ALL SELECT representation, 'post_revision', outcome FROM sub WHERE pr),
tally AS (SELECT representation, subset, COUNT(*) AS n, COUNT(*) FILTER (WHERE outcome = 'correct') AS correct, COUNT(*) FILTER (WHERE outcome = 'wrong_value') AS wrong_value,
         COUNT(*) FILTER (WHERE outcome = 'no_value') AS no_value, COUNT(*) FILTER (WHERE outcome = 'abstain') AS abstain FROM long GROUP BY representation, subset)
"""


def rounded_graph(spark, sf):
    """The base graph, written once; confidences to six digits, so that both engines hold them against a limit alike."""
    return base_graph(spark, sf, lambda nodes: cut_lineage(nodes.withColumn("confidence", F.round("confidence", 6))))


@query("d13_evaluate_compression", ALL_ANSWERS + """SELECT representation, subset, n, correct, wrong_value, no_value, abstain, ROUND(CAST(n - abstain AS DOUBLE) / n, 6) AS coverage,
 ROUND(CAST(correct AS DOUBLE) / GREATEST(1, n - abstain), 6) AS accuracy_on_resolved FROM tally""")
def d13_all(spark, sf):
    reps = answers.compress(rounded_graph(spark, sf), 0.65, 2)
    out = answers.evaluate_representations(reps, view(spark, sf, "f_facts"), view(spark, sf, "f_edges"), view(spark, sf, "f_points"))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy_on_resolved")})


# Membership edges keep every mention, so nothing is lost of their provenance.
@query("d14_reversibility", ALL_ANSWERS + """SELECT representation, ROUND(CAST(correct AS DOUBLE) / GREATEST(1, n - abstain), 6) AS accuracy_on_resolved, 1.0 AS provenance_recall
FROM tally WHERE subset = 'all' AND representation IN ('aggregation', 'revision_representation') AND CAST(correct AS DOUBLE) / GREATEST(1, n - abstain) < 0.999""")
def d14(spark, sf):
    reps = answers.compress(rounded_graph(spark, sf), 0.65, 2)
    reps = {name: reps[name] for name in ("uncompressed_baseline", "aggregation", "revision_representation")}
    ev = answers.evaluate_representations(reps, view(spark, sf, "f_facts"), view(spark, sf, "f_edges"), view(spark, sf, "f_points"))
    out = answers.reversibility_check(ev, answers.representation_report(reps))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy_on_resolved", "provenance_recall")})


@query("d15_revision_fraction", """
SELECT ROUND(AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS revision_fraction, COUNT(*) AS n_patients
FROM (SELECT patient_id, COUNT(revises) AS r FROM {f_facts} GROUP BY patient_id) x""")
def d15(spark, sf):
    return facts.revision_fraction(view(spark, sf, "f_facts")).withColumn("revision_fraction", F.round("revision_fraction", 6))


@query("d16_revision_edges", "SELECT * FROM {f_edges}")
def d16(spark, sf):
    return facts.revision_edges(view(spark, sf, "f_facts"))
