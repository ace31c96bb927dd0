"""Gates over saved answers, acceptance of edits and spans, judges, certificates."""

from pyspark.sql import functions as F

from catalog.fixtures import texts, view
from catalog.registry import query
from catalog.scalar_queries import PARSED, parsed_answers
from catalog.text_queries import MARKERS, _brace
from tracewell import constants as K
from tracewell.functions import spans
from tracewell.functions.stats import with_lower_bound
from tracewell.operators import acceptance, gates, judging, robustness, store

VALID = "(evidence_span IS NOT NULL AND STRPOS(text, evidence_span) > 0)"
COVERAGE = f"CASE WHEN {VALID} THEN CAST(LENGTH(evidence_span) AS DOUBLE) / GREATEST(1, LENGTH(text)) ELSE 0 END"
AGREE = """(CASE WHEN relation IS NULL THEN 0 ELSE CAST((CASE WHEN relation = gold_relation THEN 1 ELSE 0 END) + (CASE WHEN relation = 'EVENT1-BEFORE-EVENT2' THEN 1 ELSE 0 END)
 + (CASE WHEN relation = 'EVENT1-OVERLAP-EVENT2' THEN 1 ELSE 0 END) AS DOUBLE) / 3 END)"""
REASON = f"""CASE WHEN relation IS NULL THEN 'no_relation' WHEN NOT ({VALID} AND LENGTH(evidence_span) >= 10 AND {COVERAGE} >= 0.03) THEN 'insufficient_evidence_span'
 WHEN {AGREE} < 0.5 THEN 'necessity_check_failed' END"""


def responses(spark, sf):
    """Parsed answers with three re-queries each: the gold relation and two fixed ones."""
    r = parsed_answers(spark, sf).withColumnRenamed("note_id", "example_id")
    probes = r.select("example_id", F.explode(F.array("gold_relation", F.lit(K.E1_BEFORE), F.lit(K.OVERLAP))).alias("relation"))
    return gates.reask_agreement(r, probes)


@query("g1_span_coverage", f"SELECT note_id AS example_id, {VALID} AS valid, ROUND({COVERAGE}, 6) AS coverage FROM ({PARSED}) p")
def g1(spark, sf):
    s = gates.span_coverage("text", "evidence_span")
    return parsed_answers(spark, sf).select(F.col("note_id").alias("example_id"), s["valid"].alias("valid"), F.round(s["coverage"], 6).alias("coverage"))


@query("g2_reask_agreement", f"SELECT note_id AS example_id, ROUND({AGREE}, 6) AS agreement FROM ({PARSED}) p")
def g2(spark, sf):
    return responses(spark, sf).select("example_id", F.round("agreement", 6).alias("agreement"))


@query("g3_availability_gate", f"""
SELECT note_id AS example_id, r AS gate_reason, r IS NOT NULL AS abstained, CASE WHEN r IS NULL THEN relation END AS answer,
  CASE WHEN r IS NULL THEN CASE WHEN relation = gold_relation THEN 1 ELSE 0 END END AS correct FROM (SELECT *, {REASON} AS r FROM ({PARSED}) p) q""")
def g3(spark, sf):
    return gates.availability_gate(responses(spark, sf)).select("example_id", "gate_reason", "abstained", "answer", "correct")


@query("g4_baseline_and_gated", f"""
SELECT note_id AS example_id, m.model, relation IS NULL OR (m.model = 'gated' AND r IS NOT NULL) AS abstained,
  CASE WHEN NOT (relation IS NULL OR (m.model = 'gated' AND r IS NOT NULL)) THEN relation END AS answer
FROM (SELECT *, {REASON} AS r FROM ({PARSED}) p) q CROSS JOIN (VALUES ('baseline'), ('gated')) AS m(model)""")
def g4(spark, sf):
    return gates.baseline_and_gated(gates.availability_gate(responses(spark, sf))).select("example_id", "model", "abstained", "answer")


def hard_gated(spark, sf):
    r = parsed_answers(spark, sf).withColumns({
        "failed": F.col("reason") == "invalid_json",
        "evidence_spans": F.when(F.col("evidence_span").isNotNull(), F.array("evidence_span")).otherwise(F.array().cast("array<string>"))}).drop("reason")
    probes = r.select("note_id", F.explode(F.array(
        F.struct(F.col("gold_relation").alias("relation"), F.lit(False).alias("failed")),
        F.struct(F.lit(K.E1_BEFORE).alias("relation"), F.lit(False).alias("failed")),
        F.struct(F.lit(K.OVERLAP).alias("relation"), (F.col("ord") % 2 == 0).alias("failed")))).alias("_p")).select("note_id", "_p.*")
    # Only verbatim citations count here, which SQL can follow; the fuzzy match has its own tests.
    return gates.hard_gate(r, probes, fuzzy_threshold=1.0)


@query("g5_hard_gate", f"""
SELECT note_id, CASE WHEN reason = 'invalid_json' THEN 'llm_call_failed' WHEN NOT (LENGTH(TRIM(evidence_span)) >= 10 AND ok AND cov >= 0.03) OR evidence_span IS NULL THEN 'low_coverage'
  WHEN change < 0.5 THEN 'necessity_check_failed' END AS reason
FROM (SELECT *, STRPOS(text, TRIM(evidence_span)) > 0 AS ok, CAST(LENGTH(TRIM(evidence_span)) AS DOUBLE) / LENGTH(text) AS cov,
  CAST((CASE WHEN relation IS NOT DISTINCT FROM gold_relation THEN 0 ELSE 1 END) + (CASE WHEN relation IS NOT DISTINCT FROM 'EVENT1-BEFORE-EVENT2' THEN 0 ELSE 1 END)
   + (CASE WHEN ord % 2 = 1 AND relation IS DISTINCT FROM 'EVENT1-OVERLAP-EVENT2' THEN 1 ELSE 0 END) AS DOUBLE) / (2 + ord % 2) AS change FROM ({PARSED}) p) q""")
def g5(spark, sf):
    return hard_gated(spark, sf).select("note_id", "reason")


def token_scores(spark, sf):
    """Vectors as evidence scores of tokens; their first three entries give class probabilities."""
    e = view(spark, sf, "embeddings")
    raw = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x).cast("double"))
    return e.select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("evidence_scores"), raw.alias("probs"),
                    (F.get("embedding", F.lit(3)).cast("double")).alias("necessity_drop"))


_VEC = "(SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: ABS(CAST(x AS DOUBLE))) AS s, CAST(embedding[4] AS DOUBLE) AS drop FROM {embeddings}) v"


@query("g6_coverage_gate", f"""
SELECT vec_id, ROUND(cov, 6) AS coverage, CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN 0 WHEN s[2] >= s[3] THEN 1 ELSE 2 END AS argmax,
  CASE WHEN cov < 0.2 THEN 'low_coverage' WHEN drop < 0 THEN 'necessity_check_failed' END AS reason
FROM (SELECT *, CAST(LEN(LIST_FILTER(s, lambda x: x >= 0.15)) AS DOUBLE) / LEN(s) AS cov FROM {_VEC}) w""")
def g6(spark, sf):
    return gates.coverage_gate(token_scores(spark, sf), tau=0.15, min_coverage=0.2, min_drop=0.0).select(
        "vec_id", F.round("coverage", 6).alias("coverage"), "argmax", "reason")


@query("g7_availability_threshold", f"""
SELECT vec_id, ROUND(GREATEST(s[1], s[2], s[3]), 6) AS max_relation_prob, s[4] < 0.1 AS abstained,
  CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN 'EVENT1-BEFORE-EVENT2' WHEN s[2] >= s[3] THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END AS argmax_relation FROM {_VEC}""")
def g7(spark, sf):
    t = token_scores(spark, sf).withColumns({"availability_probability": F.abs("necessity_drop"), "is_gate": F.lit(True)})
    return gates.availability_threshold_gate(t, 0.1, K.RELATIONS).select(
        "vec_id", F.round("max_relation_prob", 6).alias("max_relation_prob"), "abstained", "argmax_relation")


def candidates(spark, sf):
    """Three edit attempts per document and variant: unchanged, cut, marked, rewritten, cued or clean."""
    d = texts(spark, sf).select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("note_id"), F.col("text").alias("original_text"), "lang",
        F.get(F.array(*[F.lit(r) for r in K.RELATIONS]), (F.col("doc_id") % 3).cast("int")).alias("gold_relation"))
    c = d.withColumn("variant", F.explode(F.array(F.lit("silent_removal"), F.lit("silent_keep")))).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    kind, t = (F.col("doc_id") + F.col("attempt")) % 6, F.col("original_text")
    verdict = (F.col("doc_id") + 2 * F.col("attempt")) % 3
    return c.withColumns({
        "text": F.when(kind == 0, t).when(kind == 1, F.substring(t, 1, 10)).when(kind == 2, F.concat(t, F.lit(" timing unknown")))
        .when(kind == 3, F.replace(t, F.lit("e"), F.lit("3"))).when(kind == 4, F.concat(t, F.lit(" before"))).otherwise(F.concat(t, F.lit(" ok"))),
        "determinable": F.when(verdict == 0, False).when(verdict == 1, True).when(F.col("doc_id") % 7 != 0, False),
        "relation": F.when(F.col("doc_id") % 2 == 1, F.col("gold_relation")),
        "event1_mentioned": F.lit(True), "event2_mentioned": F.col("doc_id") % 13 != 0})


CANDIDATES = r"""
c0 AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS note_id, text AS o, v.variant, a.attempt, (doc_id + a.attempt) % 6 AS kind,
  CASE WHEN (doc_id + 2 * a.attempt) % 3 = 0 THEN FALSE WHEN (doc_id + 2 * a.attempt) % 3 = 1 THEN TRUE WHEN doc_id % 7 <> 0 THEN FALSE END AS det
  FROM {documents} CROSS JOIN (VALUES ('silent_removal'), ('silent_keep')) AS v(variant) CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt)),
c1 AS (SELECT *, CASE kind WHEN 0 THEN o WHEN 1 THEN SUBSTR(o, 1, 10) WHEN 2 THEN CONCAT(o, ' timing unknown') WHEN 3 THEN REPLACE(o, 'e', '3') WHEN 4 THEN CONCAT(o, ' before') ELSE CONCAT(o, ' ok') END AS e FROM c0),
c2 AS (SELECT *, REGEXP_EXTRACT_ALL(LOWER(e), '[a-z0-9]+') AS et, LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(o), '[a-z0-9]+')) AS ot, CAST(LENGTH(e) AS DOUBLE) / GREATEST(1, LENGTH(o)) AS ratio,
  REGEXP_REPLACE(e, '[\x{{00C0}}-\x{{024F}}]', 'q', 'g') AS ep, REGEXP_REPLACE(o, '[\x{{00C0}}-\x{{024F}}]', 'q', 'g') AS op FROM c1),
c3 AS (SELECT *, CAST(LEN(LIST_FILTER(et, lambda t: NOT LIST_CONTAINS(ot, t))) AS DOUBLE) / GREATEST(1, LEN(et)) AS novel,
  (@EM@) AS em, (@OM@) AS om FROM c2),
r AS (SELECT *, variant = 'silent_removal' AS rem, CASE WHEN TRIM(e, E' \t\n\r') = '' OR TRIM(e, E' \t\n\r') = TRIM(o, E' \t\n\r') THEN 'empty_or_unchanged'
  WHEN variant = 'silent_removal' AND NOT ratio BETWEEN CAST(0.3 AS DOUBLE) AND CAST(1.25 AS DOUBLE) OR variant <> 'silent_removal' AND NOT ratio BETWEEN CAST(0.7 AS DOUBLE) AND CAST(1.4 AS DOUBLE) THEN 'length_ratio'
  WHEN LEN(LIST_FILTER(em, lambda m: NOT LIST_CONTAINS(om, m))) > 0 THEN CONCAT('marker:', ARRAY_TO_STRING(LIST_FILTER(em, lambda m: NOT LIST_CONTAINS(om, m)), '+'))
  WHEN novel > CASE WHEN variant = 'silent_removal' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END THEN 'novel_tokens'
  WHEN variant = 'silent_removal' AND REGEXP_MATCHES(ep, '(?i)@CUE@') THEN 'explicit_cue_remains'
  WHEN det IS NULL THEN 'judge_error' WHEN doc_id % 13 = 0 THEN 'event_not_mentioned'
  WHEN variant = 'silent_removal' AND det THEN 'implied_timing_retry'
  WHEN variant <> 'silent_removal' AND NOT (det AND doc_id % 2 = 1) THEN 'relation_not_preserved' END AS reason FROM c3)
""".replace("@EM@", MARKERS.replace("(t,", "(ep,")).replace("@OM@", MARKERS.replace("(t,", "(op,")).replace("@CUE@", _brace(K.EXPLICIT_CUE))


@query("g8_edit_reasons", "WITH " + CANDIDATES + "SELECT note_id, variant, attempt, reason FROM r")
def g8_reasons(spark, sf):
    return acceptance.edit_reasons(candidates(spark, sf)).select("note_id", "variant", "attempt", "reason")


ACCEPTED = """, acc AS (SELECT note_id, variant, COALESCE(MIN(CASE WHEN reason IS NULL THEN attempt END), MAX(CASE WHEN reason = 'implied_timing_retry' THEN attempt END)) AS attempts,
  CASE WHEN COUNT(*) FILTER (WHERE reason IS NULL) > 0 THEN CASE WHEN variant = 'silent_removal' THEN 'strict' ELSE 'keep_verified' END ELSE 'implied_only' END AS validity_tier,
  MIN(CASE WHEN reason IS NULL THEN attempt END) AS first_ok FROM r GROUP BY note_id, variant)
"""


@query("g8_accept_edit", "WITH " + CANDIDATES + ACCEPTED + "SELECT note_id, variant, attempts, validity_tier FROM acc WHERE attempts IS NOT NULL")
def g8(spark, sf):
    return acceptance.accept_edit(acceptance.edit_reasons(candidates(spark, sf))).select("note_id", "variant", "attempts", "validity_tier")


@query("g9_original_valid", "SELECT note_id FROM {f_notes} WHERE ord % 5 <> 0 AND ord % 3 = 0 AND ord % 7 <> 0")
def g9(spark, sf):
    o = F.col("ord")
    j = view(spark, sf, "f_notes").withColumns({
        "determinable": F.when(o % 5 != 0, True), "relation": F.lit(K.E1_BEFORE), "event1_mentioned": F.lit(True), "event2_mentioned": o % 7 != 0})
    return acceptance.original_valid(j).select("note_id")


@query("g10_edit_report", "WITH " + CANDIDATES + ACCEPTED + """
SELECT variant, COUNT(*) AS accepted, ROUND(AVG(attempts), 3) AS mean_attempts, (SELECT COUNT(*) FROM {documents}) AS n_valid_originals FROM acc WHERE attempts IS NOT NULL GROUP BY variant""")
def g10(spark, sf):
    acc = acceptance.accept_edit(acceptance.edit_reasons(candidates(spark, sf)))
    n = view(spark, sf, "f_notes")
    return acceptance.edit_report(acc, n, n).select("variant", "accepted", "mean_attempts", "n_valid_originals")


@query("g10_edit_rejections", "WITH " + CANDIDATES + ACCEPTED + """
SELECT r.variant, CASE WHEN r.reason LIKE 'marker%' THEN r.reason ELSE SPLIT_PART(r.reason, ':', 1) END AS reason, COUNT(*) AS n
FROM r JOIN acc a ON a.note_id = r.note_id AND a.variant = r.variant WHERE r.reason IS NOT NULL AND (a.first_ok IS NULL OR r.attempt < a.first_ok) GROUP BY 1, 2""")
def g10_rejections(spark, sf):
    return acceptance.edit_rejections(acceptance.edit_reasons(candidates(spark, sf)))


def span_candidates(spark, sf):
    n = view(spark, sf, "f_notes").select("note_id", "ord", "style", "text", F.col("gold_evidence_span").alias("original_span"),
                                          F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    k = (F.col("ord") + F.col("attempt")) % 7
    return n.withColumns({
        "call_error": F.when(k == 0, "Timeout"), "parse_error": k == 1,
        "span": F.when(k == 2, F.lit(None)).when(k == 3, "not in the note").otherwise(F.substring("text", 1, 12)),
        "relation_entailed": F.when(k != 4, k == 6), "same_information": F.col("ord") % 2 == 0})


SPANS = """
s AS (SELECT note_id, ord, style, a.attempt, CASE WHEN gold_evidence_span IS NULL THEN 'no_original_span' ELSE CASE (ord + a.attempt) % 7 WHEN 0 THEN 'relocate_error:Timeout' WHEN 1 THEN 'invalid_json'
  WHEN 2 THEN 'evidence_lost_in_paraphrase' WHEN 3 THEN 'not_verbatim' WHEN 4 THEN 'judge_error' WHEN 5 THEN 'relation_not_entailed' ELSE 'accepted' END END AS reason
  FROM {f_notes} CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt)),
o AS (SELECT note_id, ANY_VALUE(ord) AS ord, ANY_VALUE(style) AS style, COALESCE(ARG_MIN(reason, attempt) FILTER (WHERE reason IN ('no_original_span', 'evidence_lost_in_paraphrase', 'accepted')), 'attempts_exhausted') AS reason,
  COALESCE(MIN(attempt) FILTER (WHERE reason IN ('no_original_span', 'evidence_lost_in_paraphrase', 'accepted')), 3) AS attempts FROM s GROUP BY note_id)
"""


@query("g11_accept_span", "WITH " + SPANS + """
SELECT note_id, reason, CASE WHEN reason = 'accepted' THEN CASE WHEN ord % 2 = 0 THEN 'verified' ELSE 'relation_only' END END AS validity_tier,
  CASE WHEN reason <> 'no_original_span' THEN attempts END AS attempts FROM o""")
def g11(spark, sf):
    return acceptance.accept_span(acceptance.span_reasons(span_candidates(spark, sf))).select("note_id", "reason", "validity_tier", "attempts")


@query("g12_span_report", "WITH " + SPANS + """
SELECT COUNT(*) AS n_notes, COUNT(*) FILTER (WHERE reason = 'accepted') AS accepted, ROUND(CAST(COUNT(*) FILTER (WHERE reason = 'accepted') AS DOUBLE) / COUNT(*), 4) AS accepted_rate,
  ROUND(CAST(COUNT(*) FILTER (WHERE reason = 'evidence_lost_in_paraphrase') AS DOUBLE) / COUNT(*), 4) AS evidence_lost_in_paraphrase_rate,
  ROUND(AVG(attempts) FILTER (WHERE reason = 'accepted'), 3) AS mean_attempts_accepted FROM o""")
def g12(spark, sf):
    return acceptance.span_report(acceptance.accept_span(acceptance.span_reasons(span_candidates(spark, sf))))


@query("g12_span_tiers", "WITH " + SPANS + """
SELECT reason, CASE WHEN reason = 'accepted' THEN CASE WHEN ord % 2 = 0 THEN 'verified' ELSE 'relation_only' END END AS validity_tier, style, COUNT(*) AS n FROM o GROUP BY 1, 2, 3""")
def g12_tiers(spark, sf):
    c = span_candidates(spark, sf)
    return acceptance.span_tiers(acceptance.accept_span(acceptance.span_reasons(c)), view(spark, sf, "f_notes"))


@query("g13_effective_verdict", r"""
SELECT doc_id, CASE WHEN raw IN ('explicit', 'implied') AND NOT (rel IS NOT NULL AND ok) THEN 'unsupported' ELSE raw END AS verdict,
  CASE WHEN raw IN ('explicit', 'implied') AND ok OR raw = 'parse_error' THEN rel END AS relation, ok AS evidence_ok
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implied' WHEN 2 THEN 'none' WHEN 3 THEN 'explicit' ELSE 'parse_error' END AS raw,
   CASE WHEN doc_id % 4 <> 0 THEN 'EVENT2-BEFORE-EVENT1' END AS rel, doc_id % 3 <> 0 AS ok FROM {documents}) d""")
def g13(spark, sf):
    d = F.col("doc_id")
    verdicts = F.array(*[F.lit(v) for v in (" Explicit", "implied", "none", "EXPLICIT", "maybe")])
    quote = F.when(d % 3 == 0, "words that are not there").otherwise(F.concat(F.lit("\n "), F.substring("text", 3, 9), F.lit("  ")))
    v = judging.effective_verdict(F.get(verdicts, (d % 5).cast("int")), F.when(d % 4 != 0, "event2_before_event1"), quote, "text")
    return view(spark, sf, "documents").select("doc_id", v["verdict"].alias("verdict"), v["relation"].alias("relation"), v["evidence_ok"].alias("evidence_ok"))


@query("g14_judge_tier", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'missing' WHEN 2 THEN 'strict' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'strict' ELSE 'implied_only' END
  ELSE CASE WHEN doc_id % 2 = 0 THEN 'strict' ELSE 'rejected' END END AS tier FROM {documents}""")
def g14(spark, sf):
    d = F.col("doc_id")
    v = F.get(F.array(*[F.lit(x) for x in ("parse_error", "unsupported", "none", "implied", "explicit")]), (d % 5).cast("int"))
    return view(spark, sf, "documents").select("doc_id", judging.judge_tier(v, F.when(d % 2 == 1, K.E1_BEFORE)).alias("tier"))


@query("g15_rejudge_tier", "SELECT doc_id, CASE WHEN toxic IS NULL THEN 'judge_error' WHEN toxic = 1 THEN 'implied_only' ELSE 'strict' END AS tier FROM (SELECT d.doc_id, l.toxic FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) x")
def g15(spark, sf):
    d = view(spark, sf, "documents").join(view(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", judging.rejudge_tier(F.col("toxic") == 1).alias("tier"))


def manipulated(spark, sf):
    n = view(spark, sf, "f_notes")
    o = F.col("ord")
    base = n.select("note_id", (o % 9 == 0).alias("abstained"), "gold_relation", F.col("gold_relation").alias("relation"))
    edited = n.withColumns({
        "base_note_id": F.col("note_id"), "variant": F.when(o % 2 == 0, "adversarial").otherwise("natural_variability"),
        "abstained": o % 5 == 0, "relation": F.when(o % 4 != 0, F.col("gold_relation")).otherwise(K.OVERLAP),
        "injected_spans": F.lit('[{"type": "t", "start": 10, "end": 20, "clause": "c"}]'),
        "ranges": F.array(spans.make_range((o % 30).cast("int"), (o % 30 + 5).cast("int")))})
    return edited, base


@query("g16_manipulation_eval", """
SELECT variant, COUNT(*) AS n, ROUND(AVG(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS abstain_rate, ROUND(AVG(CASE WHEN NOT a AND ord % 9 <> 0 AND (ord % 4 <> 0 OR ord % 3 = 2) THEN 1.0 ELSE 0.0 END), 6) AS prediction_stability,
  ROUND(AVG(CASE WHEN variant = 'adversarial' AND NOT a AND LEAST(20, s + 5) > GREATEST(10, s) THEN 1.0 ELSE 0.0 END), 6) AS evidence_shift_rate,
  ROUND(AVG(CASE WHEN variant <> 'adversarial' AND NOT a AND g >= 0 THEN CAST(GREATEST(0, LEAST(s + 5, g + gn) - GREATEST(s, g)) AS DOUBLE) / gn END), 6) AS mean_evidence_recall
FROM (SELECT ord, CASE WHEN ord % 2 = 0 THEN 'adversarial' ELSE 'natural_variability' END AS variant, ord % 5 = 0 AS a, ord % 30 AS s, STRPOS(text, gold_evidence_span) - 1 AS g, LENGTH(gold_evidence_span) AS gn FROM {f_notes}) x GROUP BY variant""")
def g16(spark, sf):
    m = robustness.manipulation_eval(*manipulated(spark, sf))
    return m.select("variant", "n", *[F.round(c, 6).alias(c) for c in ("abstain_rate", "prediction_stability", "evidence_shift_rate", "mean_evidence_recall")])


def perturbed(spark, sf):
    """Events as perturbed copies of the notes of their users."""
    e = view(spark, sf, "events")
    p = e.select(F.col("user_id").alias("note_id"), F.lit(100).alias("text_len"), (F.col("event_id") % 50 == 0).alias("abstained"),
                 F.when(F.col("event_id") % 40 != 1, "R").otherwise("S").alias("relation"),
                 F.array(spans.make_range((F.col("event_id") % 15).cast("int"), F.lit(30))).alias("ranges"), F.col("event_type").alias("perturbation"))
    b = e.select(F.col("user_id").alias("note_id")).distinct().select(
        "note_id", (F.col("note_id") % 11 == 0).alias("abstained"), F.lit("R").alias("relation"), F.array(spans.make_range(F.lit(0), F.lit(30))).alias("ranges"))
    return b, p


@query("g17_certify_counts", """
SELECT user_id AS note_id, CASE WHEN user_id % 11 <> 0 THEN COUNT(*) END AS n_samples, CASE WHEN user_id % 11 <> 0 THEN COUNT(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 40 <> 1) END AS n_pred_success,
  CASE WHEN user_id % 11 <> 0 THEN COUNT(*) FILTER (WHERE event_id % 50 <> 0 AND CAST(30 - event_id % 15 AS DOUBLE) / 30 >= 0.6) END AS n_evi_success FROM {events} GROUP BY user_id""")
def g17(spark, sf):
    b, p = perturbed(spark, sf)
    return robustness.certify(b, p, theta=0.6).select("note_id", "n_samples", "n_pred_success", "n_evi_success")


@query("g17_perturbation_counts", "SELECT user_id AS note_id, event_type AS perturbation, COUNT(*) AS n FROM {events} GROUP BY 1, 2")
def g17_counts(spark, sf):
    return robustness.perturbation_counts(perturbed(spark, sf)[1])


# Halving until the chance of k or more successes at the bound is the wanted one.
BISECTION = """b AS (SELECT k, n, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS step FROM kn WHERE k > 0 UNION ALL
  SELECT k, n, CASE WHEN t < 0.025 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t < 0.025 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT *,
    list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS t FROM b WHERE step < 50) s),
bound AS (SELECT kn.k, kn.n, COALESCE((lo + hi) / 2, 0) AS lower FROM kn LEFT JOIN (SELECT * FROM b WHERE step = 50) x ON x.k = kn.k AND x.n = kn.n)"""


@query("g18_certification_summary", f"""
WITH RECURSIVE c AS (SELECT user_id, user_id % 11 = 0 AS ab, COUNT(*) AS n, COUNT(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 40 <> 1) AS p,
  COUNT(*) FILTER (WHERE event_id % 50 <> 0 AND CAST(30 - event_id % 15 AS DOUBLE) / 30 >= 0.5) AS e FROM {{events}} GROUP BY user_id),
kn AS (SELECT p AS k, n FROM c WHERE NOT ab UNION SELECT e, n FROM c WHERE NOT ab), {BISECTION},
z AS (SELECT c.ab, CASE WHEN ab THEN 0 ELSE x.lower END AS pl, CASE WHEN ab THEN 0 ELSE y.lower END AS el FROM c LEFT JOIN bound x ON x.k = c.p AND x.n = c.n LEFT JOIN bound y ON y.k = c.e AND y.n = c.n)
SELECT COUNT(*) AS n_examples, COUNT(*) FILTER (WHERE NOT ab AND pl >= 0.95 AND el >= 0.95) AS n_certified, COUNT(*) FILTER (WHERE ab) AS n_base_abstained,
  ROUND(CAST(COUNT(*) FILTER (WHERE NOT ab AND pl >= 0.95 AND el >= 0.95) AS DOUBLE) / COUNT(*), 8) AS certification_rate, ROUND(AVG(pl), 8) AS mean_prediction_confidence,
  ROUND(AVG(el), 8) AS mean_provenance_confidence, ROUND(POWER(CAST(0.025 AS DOUBLE), CAST(0.01 AS DOUBLE)), 8) AS ceiling, POWER(CAST(0.025 AS DOUBLE), CAST(0.01 AS DOUBLE)) >= 0.95 AS ceiling_reaches_target FROM z""")
def g18(spark, sf):
    out = robustness.certification_summary(robustness.certify(*perturbed(spark, sf)), 100)
    return out.select([F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("k9_ingest_token_gate", f"""
SELECT vec_id AS edge_key, CASE WHEN cov < 0.2 THEN 'ABSTAINED' ELSE CONCAT('REL_IDX_', CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN 0 WHEN s[2] >= s[3] THEN 1 ELSE 2 END) END AS relation_type,
  CASE WHEN cov >= 0.2 THEN LEN(LIST_FILTER(s, lambda x: x >= 0.15)) END AS n_tokens FROM (SELECT *, CAST(LEN(LIST_FILTER(s, lambda x: x >= 0.15)) AS DOUBLE) / LEN(s) AS cov FROM {_VEC}) w""")
def k9(spark, sf):
    g = gates.coverage_gate(token_scores(spark, sf), tau=0.15, min_coverage=0.2).withColumns({
        "note_id": F.col("vec_id"), "event1": F.lit("a"), "event2": F.lit("b"), "model_id": F.lit("m"), "site_id": F.lit(0), "seq": F.col("vec_id"),
        "valid_from": F.current_timestamp()})
    e = store.ingest_token_gate(g, 0.15)
    return e.select("edge_key", "relation_type", F.when(F.col("provenance.evidence_token_indices").isNotNull(), F.size("provenance.evidence_token_indices")).alias("n_tokens"))


@query("k10_ingest_span_gate", f"""
SELECT note_id AS source_note_id, CASE WHEN r IS NOT NULL THEN 'ABSTAINED' ELSE relation END AS relation_type, r AS reason FROM (SELECT *, {REASON} AS r FROM ({PARSED}) p) q""")
def k10(spark, sf):
    g = gates.availability_gate(responses(spark, sf)).withColumns({
        "note_id": F.col("example_id"), "event1": F.lit("a"), "event2": F.lit("b"), "model_id": F.lit("m"), "site_id": F.lit(0), "seq": F.col("ord"),
        "valid_from": F.current_timestamp(), "reason": F.col("gate_reason"), "evidence_spans": F.array("evidence_span"),
        "evidence_ranges": F.array(spans.span_range("text", "evidence_span")), "necessity_satisfied": F.col("agreement") >= 0.5})
    return store.ingest_span_gate(g).select("provenance.source_note_id", "relation_type", "provenance.reason")


@query("m4_clopper_pearson", f"""
WITH RECURSIVE g AS (SELECT model, variant, COUNT(*) FILTER (WHERE answer = gold_relation) AS k, COUNT(answer) AS n FROM {{f_pred}} GROUP BY model, variant),
kn AS (SELECT DISTINCT k, n FROM g), {BISECTION}
SELECT model, variant, k, n, ROUND(lower, 9) AS lower FROM g JOIN bound USING (k, n)""")
def m4(spark, sf):
    p = view(spark, sf, "f_pred").groupBy("model", "variant").agg(
        F.count(F.when(F.col("answer") == F.col("gold_relation"), 1)).alias("k"), F.count("answer").alias("n"))
    return with_lower_bound(p, "k", "n", 0.025, "lower").withColumn("lower", F.round("lower", 9))
