"""Metrics, reports, judges' agreement, splits and training sets."""


from pyspark.sql import functions as F

from catalog.fixtures import view
from catalog.registry import query
from catalog.scalar_queries import predictions
from catalog.text_queries import notes
from tracewell import constants as K
from tracewell.functions.stats import wilson_high, wilson_low
from tracewell.operators import judging, ranking, reports, splits

PRED = """p AS (SELECT *, abstained = 'True' AS ab, abstained = 'False' AS an, abstained = 'False' AND COALESCE(answer = gold_relation, FALSE) AS ok, masked_cue = 'True' AS mc FROM {f_pred})"""


def rounded(df, digits=6):
    """Round every double column."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(num, den):
    return f"ROUND(CAST({num} AS DOUBLE) / NULLIF({den}, 0), 6)"


def _n(cond):
    return f"COUNT(*) FILTER (WHERE {cond})"


def _wilson(k, n, z, sign, clamp):
    p = f"(CAST({k} AS DOUBLE) / NULLIF({n}, 0))"
    zz = f"CAST({z} AS DOUBLE) * CAST({z} AS DOUBLE)"
    x = f"(({p} + {zz} / (2 * NULLIF({n}, 0))) {sign} CAST({z} AS DOUBLE) * SQRT({p} * (1 - {p}) / NULLIF({n}, 0) + {zz} / (4 * CAST({n} AS DOUBLE) * NULLIF({n}, 0)))) / (1 + {zz} / NULLIF({n}, 0))"
    if clamp:
        x = f"CASE WHEN {n} > 0 THEN {'GREATEST(0, ' if sign == '-' else 'LEAST(1, '}{x}) END"
    return f"ROUND({x}, 6)"


def clean(spark, sf):
    return predictions(spark, sf).where("variant = 'clean'")


def control(spark, sf):
    return predictions(spark, sf).where("variant <> 'clean'")


@query("m1_wilson", f"WITH {PRED} SELECT source, variant, COUNT(*) AS n, {_wilson(_n('ok'), _n('an'), K.Z_EXACT, '-', True)} AS lo, {_wilson(_n('ok'), _n('an'), K.Z_EXACT, '+', True)} AS hi, {_wilson(_n('an'), 'COUNT(*)', K.Z_ROUNDED, '-', False)} AS lo2, {_wilson(_n('an'), 'COUNT(*)', K.Z_ROUNDED, '+', False)} AS hi2 FROM p GROUP BY source, variant")
def m1(spark, sf):
    g = predictions(spark, sf).groupBy("source", "variant").agg(
        F.count("*").alias("n"), reports.n_of(reports.correct()).alias("k"), reports.n_of(reports.answered()).alias("a"))
    return rounded(g.select("source", "variant", "n", wilson_low("k", "a", K.Z_EXACT, True).alias("lo"), wilson_high("k", "a", K.Z_EXACT, True).alias("hi"),
                            wilson_low("a", "n").alias("lo2"), wilson_high("a", "n").alias("hi2")))


@query("m2_auroc", f"""WITH {PRED}, c AS (SELECT model, score, {_n("variant = 'clean'")} AS pos, {_n("variant <> 'clean'")} AS neg FROM p GROUP BY model, score),
w AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY score) - neg AS below FROM c)
SELECT model, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg, ROUND(SUM(pos * (below + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) AS auroc FROM w GROUP BY model""")
def m2(spark, sf):
    return rounded(ranking.auroc(predictions(spark, sf), ["model"], "score", F.col("variant") == "clean"))


# Scores from minus hundreds to thousands.
@query("m2_auroc_logits", f"""WITH {PRED}, c AS (SELECT model, (CAST(n_chars AS DOUBLE) - 2000) / 4 AS s, {_n("variant = 'clean'")} AS pos, {_n("variant <> 'clean'")} AS neg FROM p GROUP BY model, s),
w AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY s) - neg AS below FROM c)
SELECT model, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg, ROUND(SUM(pos * (below + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) AS auroc FROM w GROUP BY model""")
def m2_logits(spark, sf):
    p = view(spark, sf, "f_pred").withColumn("logit", (F.col("n_chars").cast("double") - 2000) / 4)
    return rounded(ranking.auroc(p, ["model"], "logit", F.col("variant") == "clean"))


@query("m3_bootstrap_auroc")
def m3(spark, sf):
    cells = ranking.score_cells(predictions(spark, sf), ["model"], "score", F.col("variant") == "clean")
    return ranking.bootstrap_auroc(cells, ["model"], n_boot=200, blocks=64)


@query("m5_threshold_for_coverage", f"""WITH {PRED}, c AS (SELECT model, score, COUNT(*) AS n FROM p GROUP BY model, score),
w AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY model ORDER BY score DESC) AS DOUBLE) / SUM(n) OVER (PARTITION BY model) AS cov FROM c)
SELECT model, ROUND(score, 6) AS threshold, ROUND(cov, 6) AS coverage FROM w QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY ROUND(ABS(cov - CAST(0.7 AS DOUBLE)), 12), score) = 1""")
def m5(spark, sf):
    return rounded(ranking.threshold_for_coverage(predictions(spark, sf), ["model"], "score", 0.7))


@query("m6_aurc_rank", f"""WITH {PRED}, w AS (SELECT model, CASE WHEN ok THEN 0 ELSE 1 END AS e, ROW_NUMBER() OVER o AS r, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER o AS c FROM p
 WINDOW o AS (PARTITION BY model ORDER BY score DESC, MD5(CONCAT('0|', example_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, ROUND(AVG(CAST(c AS DOUBLE) / r), 6) AS aurc FROM w GROUP BY model""")
def m6(spark, sf):
    return rounded(ranking.aurc_rank(predictions(spark, sf), ["model"], "score", reports.correct(), ["example_id"]))


CURVE = f"""WITH {PRED}, g AS (SELECT CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS t FROM RANGE(101) x(i)),
curve AS (SELECT model, g.t AS threshold, {_n('an AND score >= t')} AS n_answered, CAST({_n('an AND score >= t')} AS DOUBLE) / COUNT(*) AS coverage,
 CAST({_n('ok AND score >= t')} AS DOUBLE) / NULLIF({_n('an AND score >= t')}, 0) AS acc FROM p CROSS JOIN g GROUP BY model, g.t)"""


def curve(spark, sf):
    return ranking.risk_coverage_curve(predictions(spark, sf), ["model"], "score", reports.answered(), reports.correct())


@query("m7_risk_coverage_curve", CURVE + "SELECT model, ROUND(threshold, 6) AS threshold, n_answered, ROUND(coverage, 6) AS coverage, ROUND(acc, 6) AS selective_accuracy, ROUND(1 - acc, 6) AS selective_risk FROM curve")
def m7(spark, sf):
    return rounded(curve(spark, sf))


@query("m8_aurc_trapezoid", CURVE + """, v AS (SELECT *, LAG(coverage) OVER o AS pc, LAG(acc) OVER o AS pa FROM curve WHERE acc IS NOT NULL WINDOW o AS (PARTITION BY model ORDER BY coverage, threshold DESC))
SELECT model, ROUND(SUM((coverage - pc) * ((1 - acc) + (1 - pa)) / 2), 6) AS aurc FROM v GROUP BY model""")
def m8(spark, sf):
    return rounded(ranking.aurc_trapezoid(curve(spark, sf), ["model"]))


@query("m9_choose_threshold", CURVE + """, v AS (SELECT *, MAX(coverage) OVER (PARTITION BY model) AS mc FROM curve WHERE acc IS NOT NULL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY CASE WHEN mc >= 0.5 AND coverage < 0.5 THEN 1 ELSE 0 END, CASE WHEN mc >= 0.5 THEN 1 - acc ELSE -coverage END, threshold) AS r FROM v)
SELECT model, ROUND(threshold, 6) AS threshold, CASE WHEN mc >= 0.5 THEN 'dev_min_risk_at_target_coverage' ELSE 'target_unattainable_maximum_coverage_used' END AS status, ROUND(mc, 6) AS maximum_available_coverage FROM k WHERE r = 1""")
def m9(spark, sf):
    return rounded(ranking.choose_threshold(curve(spark, sf), ["model"], 0.5)).drop("requested_coverage")


@query("m10_metrics_at_threshold", f"""WITH {PRED}, s AS (SELECT *, an AND score >= 0.3 AS sel FROM p)
SELECT model, COUNT(*) AS n_total, {_n('sel')} AS n_answered, {_r(_n('sel'), 'COUNT(*)')} AS coverage, {_r(_n('sel AND ok'), _n('sel'))} AS selective_accuracy,
 {_r(_n('ab'), 'COUNT(*)')} AS existing_abstention_rate, COUNT(evidence_sufficient) AS n_labeled, {_r(_n('sel AND evidence_sufficient = 1'), _n('evidence_sufficient = 1'))} AS sufficient_answer_rate,
 {_r(_n('NOT sel AND evidence_sufficient = 0'), _n('evidence_sufficient = 0'))} AS insufficient_abstention_rate, {_r(_n('sel AND NOT ok AND evidence_sufficient = 0'), _n('evidence_sufficient = 0'))} AS insufficient_unsafe_answer_rate,
 {_wilson(_n('sel AND ok'), _n('sel'), K.Z_EXACT, '-', True)} AS accuracy_lo, {_wilson(_n('sel AND ok'), _n('sel'), K.Z_EXACT, '+', True)} AS accuracy_hi FROM s GROUP BY model""")
def m10(spark, sf):
    m = reports.metrics_at_threshold(predictions(spark, sf), ["model"], F.lit(0.3))
    return rounded(m.drop("n_correct", "selective_risk", "n_sufficient", "n_insufficient", "label_status"))


@query("m11_random_matched_coverage")
def m11(spark, sf):
    return ranking.random_matched_coverage(predictions(spark, sf), ["model"], reports.answered(), reports.correct(), 0.5, 200)


@query("m12_mechanism_metrics", f"""WITH {PRED} SELECT COALESCE(model, 'overall') AS model, COUNT(*) AS n, {_r(_n('ab'), 'COUNT(*)')} AS abstention_rate, {_r(_n('ab'), 'COUNT(*)')} AS gate_reason_rate,
 {_r(_n("variant = 'clean'"), 'COUNT(*)')} AS provenance_recorded_rate, {_r(_n('an AND score IS NOT NULL'), _n('an'))} AS answer_has_evidence_score_rate FROM p GROUP BY ROLLUP(model)""")
def m12(spark, sf):
    p = predictions(spark, sf).withColumns({"gate_reason": F.when(F.col("abstained"), "r"), "provenance_recorded": (F.col("variant") == "clean").cast("int")})
    return rounded(reports.mechanism_metrics(p))


SELECTIVE = f"""WITH {PRED}, t AS (SELECT * FROM p WHERE variant <> 'clean' UNION ALL SELECT * REPLACE ('overall' AS model) FROM p WHERE variant <> 'clean'),
g AS (SELECT CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS t FROM RANGE(101) x(i)),
dev AS (SELECT g.t, CAST({_n('an AND score >= t')} AS DOUBLE) / COUNT(*) AS cov, CAST({_n('ok AND score >= t')} AS DOUBLE) / NULLIF({_n('an AND score >= t')}, 0) AS acc FROM p CROSS JOIN g WHERE variant = 'clean' GROUP BY g.t),
pick AS (SELECT t AS th, CASE WHEN mc >= 0.5 THEN 'dev_min_risk_at_target_coverage' ELSE 'target_unattainable_maximum_coverage_used' END AS src FROM (SELECT *, MAX(cov) OVER () AS mc FROM dev WHERE acc IS NOT NULL) d
  ORDER BY CASE WHEN mc >= 0.5 AND cov < 0.5 THEN 1 ELSE 0 END, CASE WHEN mc >= 0.5 THEN 1 - acc ELSE -cov END, t LIMIT 1),
curve AS (SELECT model, g.t, CAST({_n('an AND score >= g.t')} AS DOUBLE) / COUNT(*) AS cov, CAST({_n('ok AND score >= g.t')} AS DOUBLE) / NULLIF({_n('an AND score >= g.t')}, 0) AS acc FROM t CROSS JOIN g GROUP BY model, g.t),
v AS (SELECT *, LAG(cov) OVER o AS pc, LAG(acc) OVER o AS pa FROM curve WHERE acc IS NOT NULL WINDOW o AS (PARTITION BY model ORDER BY cov, t DESC)),
area AS (SELECT model, SUM((cov - pc) * ((1 - acc) + (1 - pa)) / 2) AS aurc FROM v GROUP BY model)
"""
AT = f"""SELECT model, COUNT(*) AS n_total, ROUND(MAX(th), 6) AS threshold, MAX(src) AS threshold_source, MAX(src) <> 'dev_min_risk_at_target_coverage' AS threshold_selection_warning, {_n('sel')} AS n_answered, {_r(_n('sel'), 'COUNT(*)')} AS coverage,
 {_r(_n('sel AND ok'), _n('sel'))} AS selective_accuracy, {_r(_n('sel AND NOT ok'), _n('sel'))} AS selective_risk, {_r(_n('ab'), 'COUNT(*)')} AS existing_abstention_rate, ROUND(AVG(score), 6) AS mean_score, ROUND(MAX(aurc), 6) AS aurc,
 GREATEST(1, CAST(ROUND_EVEN(0.5 * COUNT(*), 0) AS BIGINT)) AS random_n_selected, TRUE AS random_accuracy_as_expected"""


def selective_columns(out):
    """What SQL can state: of the random control its size, and that its mean lies by the share of correct answers."""
    near = F.abs(F.col("random_mean_accuracy") - F.col("_share")) < 0.01
    return out.select("model", "n_total", "threshold", "threshold_source", "threshold_selection_warning", "n_answered", "coverage", "selective_accuracy", "selective_risk",
                      "existing_abstention_rate", "mean_score", "aurc", "random_n_selected", near.alias("random_accuracy_as_expected"))


def selective(spark, sf, **how):
    test = control(spark, sf)
    both = test.withColumn("model", F.explode(F.array(F.col("model"), F.lit("overall"))))
    share = both.groupBy("model").agg((reports.n_of(reports.correct()) / reports.n_of(reports.answered())).alias("_share"))
    return rounded(selective_columns(reports.selective_report(clean(spark, sf), test, 0.5, **how).join(share, "model")))


@query("m13_selective_report", SELECTIVE + AT + " FROM (SELECT t.*, pick.*, area.aurc, an AND score >= th AS sel FROM t CROSS JOIN pick JOIN area USING (model)) s GROUP BY model")
def m13(spark, sf):
    return selective(spark, sf)


@query("m13_given_threshold", SELECTIVE + AT + " FROM (SELECT t.*, CAST(0.3 AS DOUBLE) AS th, 'user_fixed_threshold' AS src, area.aurc, an AND score >= 0.3 AS sel FROM t JOIN area USING (model)) s GROUP BY model")
def m13_given(spark, sf):
    return selective(spark, sf, threshold=0.3)


@query("m14_workflow_outcomes", f"""SELECT event_type AS "system", COUNT(*) AS n_cases, ROUND(AVG(value), 6) AS mean_time_seconds, ROUND(MEDIAN(value), 6) AS median_time_seconds,
 {_r(_n('event_id % 3 = 0'), 'COUNT(*)')} AS task_success_rate, {_wilson(_n('event_id % 3 = 0'), 'COUNT(*)', K.Z_EXACT, '-', True)} AS task_success_lo, {_r(_n('event_id % 7 = 0'), 'COUNT(*)')} AS unsafe_error_rate,
 {_wilson(_n('event_id % 7 = 0'), 'COUNT(*)', K.Z_EXACT, '+', True)} AS unsafe_error_hi FROM {{events}} GROUP BY event_type""")
def m14(spark, sf):
    e = view(spark, sf, "events").select(
        F.col("event_type").alias("system"), (F.col("event_id") % 3 == 0).cast("int").alias("task_success"),
        (F.col("event_id") % 7 == 0).cast("int").alias("unsafe_error"), F.col("value").alias("time_seconds"))
    return rounded(reports.workflow_outcomes(e)).drop("task_success_hi", "unsafe_error_lo")


def labels_of(spark, sf):
    n = notes(spark, sf)
    adv = n.where(F.col("ord") % 2 == 0).select("note_id", F.when(F.col("ord") % 4 == 0, '["t"]').otherwise("[]").alias("injected_spans"))
    return reports.oracle_labels(n, adv)


ORACLE = """o AS (SELECT note_id AS example_id, CASE WHEN ord % 2 <> 0 THEN CASE WHEN gold_evidence_span IS NOT NULL THEN 1 ELSE 0 END END AS ev, CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END AS co,
 CASE WHEN ord % 2 = 0 THEN 'adversarial_not_clean_evidence_label' WHEN gold_evidence_span IS NULL THEN 'no_generator_evidence_label' WHEN STRPOS(text, gold_evidence_span) > 0 THEN 'exact' ELSE 'not_exactly_located' END AS st FROM {f_notes})"""


@query("m15_oracle_labels", f"WITH {ORACLE} SELECT example_id, ev AS evidence_sufficient_oracle, co AS contradiction_present_oracle, st AS evidence_alignment_status FROM o")
def m15(spark, sf):
    return labels_of(spark, sf).drop("oracle_source")


@query("m16_oracle_abstention", f"""WITH {PRED}, {ORACLE}, j AS (SELECT p.*, o.ev, COALESCE(o.co, 0) AS co FROM p LEFT JOIN o ON o.example_id = p.example_id)
SELECT COALESCE(model, 'overall') AS model, COUNT(*) AS n, {_r(_n('ab'), 'COUNT(*)')} AS abstention_rate, {_n('ev = 1')} AS n_sufficient, {_n('ev IS NULL')} AS n_unlabeled, {_n('co = 1')} AS n_contradiction,
 {_r(_n('an AND ev = 1'), _n('ev = 1'))} AS sufficient_answer_rate, {_r(_n('ab AND ev = 0'), _n('ev = 0'))} AS insufficient_abstention_recall, {_r(_n('an AND NOT ok AND ev = 0'), _n('ev = 0'))} AS insufficient_unsafe_rate,
 {_r(_n('ab AND co = 1'), _n('co = 1'))} AS contradiction_abstention_rate, {_r(_n('an AND NOT ok AND co = 1'), _n('co = 1'))} AS contradiction_unsafe_rate, {_r(_n('ok'), _n('an'))} AS answered_accuracy,
 {_wilson(_n('ok'), _n('an'), K.Z_EXACT, '-', True)} AS accuracy_lo FROM j GROUP BY ROLLUP(model)""")
def m16(spark, sf):
    m = reports.oracle_abstention(predictions(spark, sf), labels_of(spark, sf))
    return rounded(m.drop("coverage", "n_insufficient", "sufficient_false_abstention_rate", "n_answered", "n_correct", "accuracy_hi"))


@query("m16_alignment_counts", f"WITH {PRED}, {ORACLE} SELECT p.model, o.st AS evidence_alignment_status, COUNT(*) AS n FROM p LEFT JOIN o ON o.example_id = p.example_id GROUP BY 1, 2")
def m16_alignment(spark, sf):
    return reports.alignment_counts(predictions(spark, sf), labels_of(spark, sf))


@query("m17_control_abstention", f"""WITH {PRED}, c AS (SELECT model, COUNT(*) AS clean_n, {_r(_n('an'), 'COUNT(*)')} AS clean_coverage, {_r(_n('ok'), _n('an'))} AS clean_answered_accuracy FROM p WHERE variant = 'clean' GROUP BY model),
d AS (SELECT model, COUNT(*) AS control_n, {_r(_n('ab'), 'COUNT(*)')} AS control_abstention_recall, {_r(_n('an AND NOT ok'), 'COUNT(*)')} AS control_unsafe_answer_rate FROM p WHERE variant <> 'clean' GROUP BY model)
SELECT COALESCE(c.model, d.model) AS model, clean_n, clean_coverage, clean_answered_accuracy, control_n, control_abstention_recall, control_unsafe_answer_rate FROM c FULL JOIN d ON c.model = d.model""")
def m17(spark, sf):
    return rounded(reports.control_abstention(clean(spark, sf), control(spark, sf))).drop("clean_false_abstention_rate", "control_coverage", "control_answered_accuracy")


@query("m17_control_by_case", f"""WITH {PRED} SELECT model, CASE WHEN variant IN ('remove_evidence', 'mask_temporal_cue') THEN variant ELSE 'evidence_unavailable' END AS evidence_case, COUNT(*) AS control_n,
 {_r(_n('ab'), 'COUNT(*)')} AS control_abstention_recall, {_r(_n('an'), 'COUNT(*)')} AS control_coverage, {_r(_n('an AND NOT ok'), 'COUNT(*)')} AS control_unsafe_answer_rate, {_r(_n('ok'), _n('an'))} AS control_answered_accuracy
 FROM p WHERE variant <> 'clean' GROUP BY 1, 2""")
def m17_case(spark, sf):
    return rounded(reports.control_abstention_by_case(control(spark, sf)))


STRATA = """x AS (SELECT p.*, UNNEST(LIST_FILTER([CASE WHEN variant = 'remove_evidence' THEN variant END, CASE WHEN variant = 'mask_temporal_cue' THEN 'mask_temporal_cue (all)' END,
  CASE WHEN variant = 'mask_temporal_cue' THEN CASE WHEN mc THEN 'mask_temporal_cue: token inserted (masked_cue=True)' ELSE 'mask_temporal_cue: note intact + notice (masked_cue=False)' END END,
  CASE WHEN variant LIKE 'silent%' THEN variant END, CASE WHEN variant = 'silent_removal' THEN CONCAT(variant, ' [', validity_tier, ']') END], lambda s: s IS NOT NULL)) AS stratum FROM p WHERE variant <> 'clean')"""


@query("m18_stratified_paired", f"""WITH {PRED}, {STRATA}, cl AS (SELECT base_id, an AS can, ok AS cok FROM p WHERE variant = 'clean')
SELECT model, stratum, COUNT(*) AS n, {_n('an')} AS n_answered, {_r(_n('ab'), 'COUNT(*)')} AS abstention_recall, {_wilson(_n('ab'), 'COUNT(*)', K.Z_ROUNDED, '-', False)} AS abst_ci_low, {_wilson(_n('ab'), 'COUNT(*)', K.Z_ROUNDED, '+', False)} AS abst_ci_high,
 {_r(_n('an AND NOT ok'), 'COUNT(*)')} AS unsafe_answer_rate, {_r(_n('ok'), _n('an'))} AS answered_accuracy, COUNT(*) AS clean_n_same_notes, {_r(_n('can'), 'COUNT(*)')} AS clean_coverage_same_notes, {_r(_n('cok'), _n('can'))} AS clean_answered_accuracy_same_notes
FROM x JOIN cl ON cl.base_id = x.base_id GROUP BY model, stratum""")
def m18(spark, sf):
    m = reports.stratified_paired(control(spark, sf), clean(spark, sf))
    return rounded(m).drop("coverage_on_unavailable", "unsafe_ci_low", "unsafe_ci_high")


@query("m19_control_composition", f"""SELECT CASE WHEN ord % 2 = 0 THEN 'remove_evidence' ELSE 'mask_temporal_cue' END AS variant, COUNT(*) AS n, COUNT(DISTINCT text) AS distinct_texts,
 {_n("STRPOS(text, 'initiated after') > 0")} AS token_inserted FROM {{f_notes}} GROUP BY 1""")
def m19(spark, sf):
    n = notes(spark, sf).withColumn("variant", F.when(F.col("ord") % 2 == 0, "remove_evidence").otherwise("mask_temporal_cue"))
    return reports.control_composition(n, "initiated after")


@query("m20_per_class_breakdown", f"""WITH {PRED}, c AS (SELECT * FROM p WHERE variant = 'clean'), e AS (SELECT * FROM p WHERE variant <> 'clean'),
rows AS (SELECT 'edited' AS condition, variant, COALESCE(validity_tier, 'keep') AS tier, gold_relation, answer, an FROM e
 UNION ALL SELECT 'clean_same_notes', e.variant, COALESCE(e.validity_tier, 'keep'), e.gold_relation, c.answer, c.an FROM e JOIN c ON c.example_id = e.base_id)
SELECT condition, variant, COALESCE(tier, 'all') AS tier, gold_relation, COUNT(*) AS n, {_r(_n('an'), 'COUNT(*)')} AS coverage, {_n('an')} AS n_answered, {_r(_n('an AND answer = gold_relation'), _n('an'))} AS accuracy,
 {_r(_n("an AND answer = 'EVENT1-BEFORE-EVENT2'"), _n('an'))} AS pred_0, {_r(_n("an AND answer = 'EVENT2-BEFORE-EVENT1'"), _n('an'))} AS pred_1, {_r(_n("an AND answer = 'EVENT1-OVERLAP-EVENT2'"), _n('an'))} AS pred_2
FROM rows GROUP BY GROUPING SETS ((condition, variant, tier, gold_relation), (condition, variant, gold_relation))""")
def m20(spark, sf):
    return rounded(reports.per_class_breakdown(control(spark, sf), clean(spark, sf)))


@query("m21_baseline_table", f"""WITH {PRED}, c AS (SELECT score, COUNT(*) AS n FROM p WHERE variant = 'clean' GROUP BY score),
w AS (SELECT score, CAST(SUM(n) OVER (ORDER BY score DESC) AS DOUBLE) / SUM(n) OVER () AS cov FROM c), t AS (SELECT score AS th FROM w ORDER BY ROUND(ABS(cov - CAST(0.7 AS DOUBLE)), 12), score LIMIT 1),
cells AS (SELECT v.variant, s.score, s.n AS pos, COALESCE(k.n, 0) AS neg FROM c s CROSS JOIN (SELECT DISTINCT variant FROM p WHERE variant <> 'clean') v LEFT JOIN (SELECT variant, score, COUNT(*) AS n FROM p GROUP BY 1, 2) k ON k.variant = v.variant AND k.score = s.score
 UNION ALL SELECT variant, score, 0, COUNT(*) FROM p WHERE variant <> 'clean' AND score NOT IN (SELECT score FROM c) GROUP BY 1, 2),
r AS (SELECT *, SUM(neg) OVER (PARTITION BY variant ORDER BY score) - neg AS below FROM cells),
a AS (SELECT variant, ROUND(SUM(pos * (below + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) AS auroc FROM r GROUP BY variant)
SELECT p.variant AS condition, COUNT(*) AS n, ROUND(MAX(th), 6) AS threshold, {_r(_n('score >= th'), 'COUNT(*)')} AS coverage, {_r(_n('score >= th AND ok'), _n('score >= th'))} AS answered_accuracy, MAX(a.auroc) AS auroc_vs_clean
FROM p CROSS JOIN t LEFT JOIN a ON a.variant = p.variant GROUP BY p.variant""")
def m21(spark, sf):
    prep = lambda d: d.select(F.col("variant").alias("condition"), "score", F.col("correct_answered").alias("correct"))
    return rounded(reports.baseline_table(prep(clean(spark, sf)), prep(control(spark, sf)), 0.7)).drop("abstention")


@query("m22_subset_scores", f"""WITH {PRED}, s AS (SELECT DISTINCT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS "set", CAST(doc_id AS VARCHAR) AS note_id FROM {{labels}})
SELECT e.model, s."set", COUNT(*) AS n, {_n('e.an')} AS edited_answered, {_n('e.ok')} AS edited_correct, {_r(_n('c.an'), 'COUNT(*)')} AS clean_coverage, {_r(_n('c.ok'), _n('c.an'))} AS clean_accuracy,
 {_r(_n('e.an'), 'COUNT(*)')} AS edited_coverage, {_wilson(_n('e.an'), 'COUNT(*)', K.Z_ROUNDED, '-', False)} AS edited_coverage_lo, {_r(_n('e.ok'), _n('e.an'))} AS edited_accuracy
FROM p e JOIN s ON s.note_id = e.base_id JOIN p c ON c.example_id = e.base_id AND c.model = e.model WHERE e.variant <> 'clean' GROUP BY e.model, s."set" """)
def m22(spark, sf):
    ids = view(spark, sf, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("set"), F.lit("edit").alias("kind"), F.col("doc_id").cast("string").alias("note_id"))
    m = reports.subset_scores(control(spark, sf).withColumn("kind", F.lit("edit")), clean(spark, sf), ids)
    return rounded(m).drop("ids_in_list", "edited_coverage_hi", "edited_accuracy_lo", "edited_accuracy_hi")


def runs(spark, sf):
    """Predictions of three seeds per model; later seeds shift the score and drop some answers."""
    p = predictions(spark, sf).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return p.withColumns({"abstained": F.col("abstained") | (F.col("n_chars") % 10 < F.col("seed")), "score": F.col("score") / F.col("seed")})


RUNS = f"""{PRED}, q AS (SELECT p.* EXCLUDE (ab, an, ok), s.seed, ab OR n_chars % 10 < s.seed AS ab, NOT (ab OR n_chars % 10 < s.seed) AS an, ok AND NOT (n_chars % 10 < s.seed) AS ok FROM p CROSS JOIN (VALUES (1), (2), (3)) AS s(seed)),
sets AS (SELECT q.*, UNNEST(LIST_FILTER([CASE WHEN variant = 'clean' THEN 'clean' END, CASE WHEN variant IN ('remove_evidence', 'mask_temporal_cue') THEN 'marker' END, CASE WHEN variant = 'remove_evidence' THEN variant END,
  CASE WHEN variant = 'mask_temporal_cue' THEN CASE WHEN mc THEN 'mask_token' ELSE 'notice_appended' END END, CASE WHEN variant = 'silent_removal' AND validity_tier = 'strict' THEN 'silent_strict' END,
  CASE WHEN variant = 'silent_removal' AND validity_tier = 'strict' AND tier2 = 'strict' THEN 'silent_both_strict' END, CASE WHEN variant = 'silent_removal' AND validity_tier = 'implied_only' THEN 'silent_implied' END,
  CASE WHEN variant = 'silent_removal' THEN 'silent_all' END, CASE WHEN variant = 'silent_keep' THEN 'silent_keep' END], lambda s: s IS NOT NULL)) AS "set" FROM q),
m AS (SELECT model, seed, "set", COUNT(*) AS n, CAST({_n('an')} AS DOUBLE) / COUNT(*) AS coverage, CAST({_n('ok')} AS DOUBLE) / NULLIF({_n('an')}, 0) AS accuracy FROM sets GROUP BY model, seed, "set")"""


@query("m23_run_metrics", f"""WITH {RUNS}, c AS (SELECT model, seed, base_id, an, ok FROM q WHERE variant = 'clean')
SELECT m.model, m.seed, m."set", m.n, ROUND(m.coverage, 6) AS coverage, ROUND(m.accuracy, 6) AS accuracy, ROUND(pc.cov, 6) AS clean_cov_paired, ROUND(pc.acc, 6) AS clean_acc_paired FROM m JOIN (
 SELECT s.model, s.seed, s."set", CAST({_n('c.an')} AS DOUBLE) / COUNT(*) AS cov, CAST({_n('c.ok')} AS DOUBLE) / NULLIF({_n('c.an')}, 0) AS acc FROM sets s JOIN c ON c.model = s.model AND c.seed = s.seed AND c.base_id = s.base_id GROUP BY 1, 2, 3) pc
 ON pc.model = m.model AND pc.seed = m.seed AND pc."set" = m."set" """)
def m23(spark, sf):
    return rounded(reports.run_metrics(runs(spark, sf), ["model", "seed"])).drop("abstention", "auroc")


@query("m23_run_summary", f"""WITH {RUNS} SELECT model, "set", ROUND(AVG(n), 6) AS n_mean, ROUND(AVG(coverage), 6) AS coverage_mean, ROUND(STDDEV_SAMP(coverage), 6) AS coverage_sd, ROUND(AVG(accuracy), 6) AS accuracy_mean,
 ROUND(STDDEV_SAMP(accuracy), 6) AS accuracy_sd, COUNT(DISTINCT seed) AS seeds FROM m GROUP BY model, "set" """)
def m23_summary(spark, sf):
    s = reports.run_summary(reports.run_metrics(runs(spark, sf), ["model", "seed"]), ["model"])
    return rounded(s).select("model", "set", "n_mean", "coverage_mean", "coverage_sd", "accuracy_mean", "accuracy_sd", "seeds")


@query("m24_report_cells")
def m24(spark, sf):
    return reports.report_cells(reports.run_summary(reports.run_metrics(runs(spark, sf), ["model", "seed"]), ["model"]), ["model"])


def worded_runs(spark, sf):
    n = notes(spark, sf).withColumn("text", F.when(F.col("ord") % 3 == 0, F.replace("text", F.lit("day"), F.lit("d"))).otherwise(F.col("text")))
    return n.select(F.lit("A").alias("condition"), (F.col("ord") % 2).alias("seed"), F.col("style").alias("set"), "text", (F.col("ord") % 4 == 0).alias("abstained"))


RULE = rf"""w AS (SELECT ord % 2 AS seed, style AS "set", ord % 4 = 0 AS g, NOT REGEXP_MATCHES(REGEXP_REPLACE(CASE WHEN ord % 3 = 0 THEN REPLACE(text, 'day', 'd') ELSE text END, '[\x{{{{00C0}}}}-\x{{{{024F}}}}]', 'q', 'g'), '(?i)\bday\s*(\d+)') AS nd, NOT REGEXP_MATCHES(text, '[0-9]') AS ng FROM {{f_notes}}),
a AS (SELECT seed, "set", COUNT(*) AS n, CAST({_n('nd')} AS DOUBLE) / COUNT(*) AS share_no_day, CAST({_n('g = nd')} AS DOUBLE) / COUNT(*) AS agree_with_rule, CAST({_n('g AND nd')} AS DOUBLE) / NULLIF({_n('nd')}, 0) AS gate_abst_if_no_day, CAST({_n('g = ng')} AS DOUBLE) / COUNT(*) AS agree_with_no_digit FROM w GROUP BY 1, 2)""".replace("{{{{", "{{").replace("}}}}", "}}")


@query("m25_rule_agreement", f"""WITH {RULE} SELECT seed, "set", n, ROUND(share_no_day, 6) AS share_no_day, ROUND(agree_with_rule, 6) AS agree_with_rule, ROUND(gate_abst_if_no_day, 6) AS gate_abst_if_no_day FROM a""")
def m25(spark, sf):
    return rounded(reports.rule_agreement(worded_runs(spark, sf), ["condition", "seed"])).select("seed", "set", "n", "share_no_day", "agree_with_rule", "gate_abst_if_no_day")


@query("m25_rule_agreement_means", f"""WITH {RULE} SELECT 'A' AS condition, "set", ROUND(AVG(n), 6) AS n, ROUND(AVG(share_no_day), 6) AS share_no_day FROM a GROUP BY "set" """)
def m25_means(spark, sf):
    r = reports.rule_agreement_means(reports.rule_agreement(worded_runs(spark, sf), ["condition", "seed"]), ["condition"])
    return rounded(r).select("condition", "set", "n", "share_no_day")


@query("m25_rule_agreement_overall", f"""WITH {RULE} SELECT 'A' AS condition, ROUND(SUM(agree_with_rule * n) / SUM(n), 6) AS agree_with_rule, ROUND(SUM(agree_with_no_digit * n) / SUM(n), 6) AS agree_with_no_digit FROM a""")
def m25_overall(spark, sf):
    return rounded(reports.rule_agreement_overall(reports.rule_agreement(worded_runs(spark, sf), ["condition", "seed"]), ["condition"]))


@query("m26_label_set", f"""WITH {PRED} SELECT example_id, CASE variant WHEN 'mask_temporal_cue' THEN CASE WHEN mc THEN 'mask_token' ELSE 'notice_appended' END WHEN 'silent_removal' THEN CONCAT('silent_', validity_tier) ELSE variant END AS "set" FROM p""")
def m26(spark, sf):
    notice = reports.notice_flag(F.col("variant"), F.col("masked_cue"))
    return predictions(spark, sf).select("example_id", reports.label_set("example_id", F.col("validity_tier"), notice).alias("set"))


KAPPA = """k AS (SELECT COUNT(*) AS n, SUM(CASE WHEN a = b THEN 1 ELSE 0 END) AS g FROM t), e AS (SELECT SUM(CAST(x.n AS DOUBLE) * y.n) AS c FROM (SELECT a, COUNT(*) AS n FROM t GROUP BY a) x JOIN (SELECT b, COUNT(*) AS n FROM t GROUP BY b) y ON x.a = y.b)
SELECT k.n, CAST(k.g AS BIGINT) AS n_agree, ROUND(CAST(g AS DOUBLE) / n, 6) AS agreement, ROUND((CAST(g AS DOUBLE) / n - c / (CAST(n AS DOUBLE) * n)) / (1 - c / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM k, e"""


@query("m27_cohen_kappa", "WITH t AS (SELECT CASE WHEN quality = 1 THEN 'strict' ELSE 'implied_only' END AS a, CASE WHEN toxic = 0 THEN 'strict' ELSE 'implied_only' END AS b FROM {labels}), " + KAPPA)
def m27(spark, sf):
    return rounded(judging.cohen_kappa(tiers(spark, sf), "tier1", "tier2"))


def tiers(spark, sf):
    return view(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("note_id"), F.when(F.col("quality") == 1, "strict").otherwise("implied_only").alias("tier1"),
        F.when(F.col("toxic") == 0, "strict").otherwise("implied_only").alias("tier2"))


@query("m28_tier_crosstab", """SELECT COALESCE(a, 'All') AS tier1, COALESCE(b, 'All') AS tier2, COUNT(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'strict' ELSE 'implied_only' END AS a,
 CASE WHEN toxic = 0 THEN 'strict' ELSE 'implied_only' END AS b FROM {labels}) t GROUP BY CUBE(a, b)""")
def m28(spark, sf):
    return judging.tier_crosstab(tiers(spark, sf), "tier1", "tier2")


def judged(spark, sf):
    n = notes(spark, sf)
    o = F.col("ord")
    records = n.select("note_id", F.col("gold_relation").alias("gold"), F.when(o % 3 == 0, "Strict").when(o % 3 == 1, "implied").alias("orig_tier"),
                       F.when(o % 4 != 0, F.when(o % 5 < 3, "strict").otherwise("implied-only")).alias("rerun_tier"))
    j = n.select("ord", "note_id", "gold_relation", F.explode(F.array(F.lit("clean"), F.lit("silent_removal"), F.lit("silent_keep"))).alias("condition"))
    k = F.when(F.col("condition") == "clean", 0).when(F.col("condition") == "silent_removal", 1).otherwise(2)
    v = F.get(F.array(*[F.lit(x) for x in ("explicit", "implied", "none", "unsupported")]), ((o + k) % 4).cast("int"))
    return judging.judged_sets(records, j.select("note_id", "condition", v.alias("verdict"), F.when(v.isin("explicit", "implied"), F.when((o + k) % 7 != 0, F.col("gold_relation")).otherwise("EVENT1-OVERLAP-EVENT2")).alias("relation")))


JUDGED = """b AS (SELECT note_id, ord, (ord % 4) < 2 AND (ord % 7 <> 0 OR ord % 3 = 2) AS ok, ((ord + 2) % 4) < 2 AND ((ord + 2) % 7 <> 0 OR ord % 3 = 2) AS kp,
 CASE (ord + 1) % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'implied_only' WHEN 2 THEN 'strict' ELSE 'missing' END AS jt, CASE ord % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'implied_only' ELSE 'none' END AS ot,
 CASE WHEN ord % 4 <> 0 THEN CASE WHEN ord % 5 < 3 THEN 'strict' ELSE 'implied_only' END END AS rt FROM {f_notes})"""


@query("m29_judge_report", f"""WITH {JUDGED} SELECT name, COUNT(*) AS n FROM (SELECT UNNEST(LIST_FILTER(['clean_notes_judged', CASE WHEN ok THEN 'clean_recovered' END, CASE WHEN ok THEN 'prefilter_clean_ok' END, CASE WHEN ok AND jt = 'strict' THEN 'removal_strict' END,
 CASE WHEN ok AND jt = 'strict' AND ot = 'strict' THEN 'removal_strict_both_judges' END, CASE WHEN ok AND jt = 'implied_only' THEN 'removal_implied' END, CASE WHEN ok AND jt = 'implied_only' AND ot = 'implied_only' THEN 'removal_implied_both_judges' END,
 CASE WHEN ok AND jt IN ('strict', 'implied_only') THEN 'removal_all' END, CASE WHEN ok AND kp THEN 'keep_valid' END], lambda s: s IS NOT NULL)) AS name FROM b) x GROUP BY name""")
def m29(spark, sf):
    return judging.judge_report(judged(spark, sf))


@query("m29_judge_agreement", f"""WITH {JUDGED}, t AS (SELECT ot AS a, jt AS b FROM b WHERE ot <> 'none' AND jt <> 'missing'), {KAPPA}""")
def m29_agreement(spark, sf):
    return rounded(judging.judge_agreement(judged(spark, sf)).where("pair = 'original_vs_judge'").drop("pair"))


def _agreement(pair: str, a: str, b: str, rule: str) -> str:
    return f"SELECT '{pair}' AS pair, x.* FROM (WITH t AS (SELECT {a} AS a, {b} AS b FROM b WHERE ot <> 'none' AND {rule}), {KAPPA}) x"


@query("m29_judge_agreement_pairs", f"WITH {JUDGED} " + " UNION ALL ".join([
    _agreement("original_vs_judge", "ot", "jt", "jt <> 'missing'"), _agreement("original_vs_rerun", "ot", "rt", "rt IS NOT NULL"),
    _agreement("rerun_vs_judge", "rt", "jt", "rt IS NOT NULL AND jt <> 'missing'")]))
def m29_agreement_pairs(spark, sf):
    return rounded(judging.judge_agreement(judged(spark, sf)))


@query("m29_judge_confusion", f"WITH {JUDGED} SELECT ot AS orig, jt AS judge, COUNT(*) AS n FROM b GROUP BY 1, 2")
def m29_confusion(spark, sf):
    return judging.judge_confusion(judged(spark, sf))


def scored_spans(spark, sf):
    n = notes(spark, sf)
    gold = n.select("note_id", "text", F.when(F.col("ord") % 5 != 0, "accepted").otherwise("attempts_exhausted").alias("reason"), F.substring("text", 5, 40).alias("gold_evidence_span_v2"),
                    F.when(F.col("ord") % 2 == 0, "verified").otherwise("relation_only").alias("validity_tier"))
    p = n.select(F.col("note_id").alias("example_id"), (F.col("ord") % 7 == 0).alias("abstained"),
                 F.when(F.col("ord") % 3 != 0, F.expr("substring(text, 1 + cast(ord % 30 as int), 35)")).alias("predicted_evidence_span"))
    return reports.score_spans(p, gold)


SPAN_SCORES = """g AS (SELECT note_id, ord, text, SUBSTR(text, 5, 40) AS gold, CASE WHEN ord % 3 <> 0 THEN SUBSTR(text, 1 + ord % 30, 35) END AS pred FROM {f_notes} WHERE ord % 5 <> 0),
h AS (SELECT *, STRPOS(text, gold) AS gs, LENGTH(gold) AS gn, COALESCE(STRPOS(text, pred), 0) AS ps, LENGTH(COALESCE(pred, '')) AS pn FROM g),
i AS (SELECT *, CASE WHEN ps = 0 THEN 0 ELSE GREATEST(0, LEAST(gs + gn, ps + pn) - GREATEST(gs, ps)) END AS x FROM h),
s AS (SELECT note_id, ord, CAST(x AS DOUBLE) / gn AS r, CASE WHEN ps > 0 THEN CAST(x AS DOUBLE) / pn END AS pr, CAST(pn AS DOUBLE) / LENGTH(text) AS f FROM i),
z AS (SELECT *, UNNEST(LIST_FILTER(['all', CASE WHEN ord % 7 <> 0 THEN 'answered_only' END, CASE WHEN ord % 2 = 0 THEN 'tier:verified' ELSE 'tier:relation_only' END], lambda v: v IS NOT NULL)) AS "rows" FROM s)"""


@query("m30_span_recall_report", f"""WITH {SPAN_SCORES} SELECT "rows", COUNT(*) AS n_scorable, ROUND(AVG(r), 5) AS mean_recall, ROUND(AVG(pr), 5) AS mean_precision, ROUND(CAST({_n('r = 0')} AS DOUBLE) / COUNT(*), 5) AS frac_zero_recall,
 ROUND(AVG(f), 5) AS mean_span_len_frac, ROUND(MEDIAN(r), 5) AS median_recall, ROUND(MEDIAN(pr), 5) AS median_precision, ROUND(MEDIAN(f), 5) AS median_span_len_frac FROM z GROUP BY "rows" """)
def m30(spark, sf):
    # Five digits: some means end in an exact half at the sixth.
    return rounded(reports.span_recall_report(scored_spans(spark, sf)), digits=5).drop("mean_f1", "frac_full_recall", "frac_span_over_80pct")


@query("m31_extraction_metrics", f"""WITH {PRED}, t AS (SELECT source, COUNT(*) AS n, {_n('ab')} AS a, {_n('ok')} AS o, SUM(CASE WHEN an THEN score END) AS s, {_n('an')} AS c, SUM(score) AS v FROM p GROUP BY source)
SELECT CAST(SUM(n) AS BIGINT) AS n, ROUND(CAST(SUM(o) AS DOUBLE) / (SUM(n) - SUM(a)), 6) AS accuracy_on_answered, ROUND(CAST(SUM(a) AS DOUBLE) / SUM(n), 6) AS abstain_rate, ROUND(SUM(s) / SUM(c), 6) AS mean_evidence_recall,
 ROUND(SUM(v) / SUM(n), 6) AS mean_coverage, ROUND(MAX(CAST(a AS DOUBLE) / n) - MIN(CAST(a AS DOUBLE) / n), 6) AS abstention_spread, MAX(CAST(a AS DOUBLE) / n) - MIN(CAST(a AS DOUBLE) / n) > 0.5 AS shortcut_flag FROM t""")
def m31(spark, sf):
    p = predictions(spark, sf).withColumns({"recall": F.col("score"), "coverage": F.col("score"), "template": F.col("source")})
    return rounded(reports.extraction_metrics(p))


@query("m32_decision_stability", f"WITH {RUNS} SELECT a.model, COUNT(*) AS n, {_r(_n('a.ab = b.ab'), 'COUNT(*)')} AS identical_decisions FROM q a JOIN q b ON a.model = b.model AND a.example_id = b.example_id AND a.seed = 1 AND b.seed = 3 GROUP BY a.model")
def m32(spark, sf):
    r = runs(spark, sf)
    return rounded(reports.decision_stability(r.where("seed = 1"), r.where("seed = 3"), ["model"]))


@query("m33_check_numbers", f"""WITH {PRED}, v AS (SELECT model AS section, variant AS quantity, CAST({_n('an')} AS DOUBLE) / COUNT(*) AS value FROM p GROUP BY 1, 2)
SELECT section, quantity, ROUND(value, 6) AS value, CASE WHEN variant2 IS NULL THEN 'INFO' WHEN ROUND(CAST(value AS DECIMAL(30, 15)), 2) = ROUND(CAST(printed AS DECIMAL(30, 15)), 2) THEN 'OK' ELSE 'MISMATCH' END AS status
FROM (SELECT v.*, CASE WHEN section = 'm0' THEN quantity END AS variant2, CASE WHEN quantity = 'clean' THEN CAST(0.5 AS DOUBLE) ELSE value END AS printed FROM v) x""")
def m33(spark, sf):
    found = predictions(spark, sf).groupBy(F.col("model").alias("section"), F.col("variant").alias("quantity")).agg(reports.rate(reports.answered(), F.lit(True)).alias("value"))
    expected = found.where("section = 'm0'").select("section", "quantity", F.when(F.col("quantity") == "clean", 0.5).otherwise(F.col("value")).alias("printed"),
                                                   F.lit(2).alias("digits"), F.lit(False).alias("pct"))
    return rounded(reports.check_numbers(expected, found)).select("section", "quantity", "value", "status")


@query("m34_class_confusion", f"WITH {PRED} SELECT model, gold_relation, CASE WHEN an THEN answer END AS answer, COUNT(*) AS n FROM p WHERE variant = 'clean' GROUP BY 1, 2, 3")
def m34(spark, sf):
    return reports.class_confusion(clean(spark, sf), ["model"])


@query("m34_class_scores", f"WITH {PRED} SELECT model, gold_relation, COUNT(*) AS n, {_r(_n('an'), 'COUNT(*)')} AS coverage, {_r(_n('ok'), _n('an'))} AS accuracy FROM p GROUP BY 1, 2")
def m34_scores(spark, sf):
    return rounded(reports.class_scores(predictions(spark, sf), ["model"]))


@query("m35_marker_totals", f"""WITH {PRED}, w AS (SELECT *, variant = 'remove_evidence' OR NOT mc AS wd FROM p WHERE variant IN ('remove_evidence', 'mask_temporal_cue'))
SELECT model, COUNT(*) AS n, {_n('ab')} AS n_abstained, {_n('ab AND wd')} AS n_abstained_worded, {_r(_n('ab AND wd'), _n('ab'))} AS worded_share FROM w GROUP BY model""")
def m35(spark, sf):
    return rounded(reports.marker_totals(control(spark, sf)))


@query("m36_span_entailment_rate", f"WITH {PRED} SELECT source, COUNT(*) AS n, {_n('answer = gold_relation')} AS n_entailed, {_r(_n('answer = gold_relation'), 'COUNT(*)')} AS entailment_rate FROM p GROUP BY source")
def m36(spark, sf):
    p = view(spark, sf, "f_pred").select("source", F.col("answer").alias("relation"), F.col("gold_relation").alias("gold"))
    return rounded(judging.span_entailment_rate(p, ["source"]).withColumn("n_entailed", F.col("n_entailed").cast("long")))


# ---------------------------------------------------------------- splits and training sets

RANKED = "k AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT('7|', user_id)), user_id) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM {events}) u)"


@query("s1_split_by_entity", f"""WITH {RANKED}, l AS (SELECT user_id, CASE WHEN r <= GREATEST(1, FLOOR(n * CAST(0.15 AS DOUBLE))) THEN 'test' WHEN r <= GREATEST(1, FLOOR(n * CAST(0.15 AS DOUBLE))) * 2 THEN 'dev' ELSE 'train' END AS split FROM k)
SELECT e.event_id, e.user_id, l.split FROM {{events}} e JOIN l ON l.user_id = e.user_id""")
def s1(spark, sf):
    return splits.split_by_entity(view(spark, sf, "events"), "user_id").select("event_id", "user_id", "split")


@query("s2_test_entities", f"WITH {RANKED} SELECT user_id FROM k WHERE r <= 20")
def s2(spark, sf):
    return splits.test_entities(view(spark, sf, "events"), "user_id", 20)


@query("s3_split_rest", f"""WITH {RANKED}, t AS (SELECT user_id FROM k WHERE r <= 20), q AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT('13|', user_id)), user_id) AS r FROM k WHERE user_id NOT IN (SELECT user_id FROM t))
SELECT user_id, CASE WHEN r <= 10 THEN 'dev' ELSE 'train' END AS split FROM q UNION ALL SELECT user_id, 'test' FROM t""")
def s3(spark, sf):
    e = view(spark, sf, "events")
    return splits.split_rest(e, "user_id", splits.test_entities(e, "user_id", 20), 10)


@query("s4_sample_fraction", "SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT('7|', doc_id)), doc_id) AS r, COUNT(*) OVER () AS n FROM {documents}) d WHERE r <= GREATEST(1, ROUND(n * CAST(0.3 AS DOUBLE)))")
def s4(spark, sf):
    return splits.sample_fraction(view(spark, sf, "documents").select("doc_id"), 0.3, ["doc_id"])


@query("s4_sample_per_group", "SELECT doc_id, source FROM (SELECT doc_id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY MD5(CONCAT('7|', doc_id)), doc_id) AS r FROM {documents}) d WHERE r <= 5")
def s4_group(spark, sf):
    return splits.sample_per_group(view(spark, sf, "documents").select("doc_id", "source"), ["source"], 5, ["doc_id"])


def recipe(spark, sf):
    p = predictions(spark, sf)
    return splits.training_recipe(p, p.where("source <> 'src0'"), "source", ["strict"])


RECIPE = f"""WITH {PRED}, b AS (SELECT example_id, gold_relation, CASE WHEN variant = 'clean' THEN 'clean' WHEN variant = 'mask_temporal_cue' AND NOT mc THEN 'notice' WHEN variant IN ('mask_temporal_cue', 'remove_evidence') THEN 'marker' ELSE variant END AS part
 FROM p WHERE source <> 'src0' AND NOT (variant = 'silent_removal' AND validity_tier <> 'strict')),
r(condition, part, kind, available) AS (VALUES ('A', 'clean', 'clean', 1), ('A', 'marker', 'marker', 0), ('A', 'notice', 'marker', 0), ('B', 'clean', 'clean', 1), ('B', 'silent_removal', 'silent_removal', 0), ('B', 'silent_keep', 'silent_keep', 1),
 ('C', 'clean', 'clean', 1), ('C', 'marker', 'marker', 0), ('C', 'notice', 'marker', 0), ('C', 'silent_removal', 'silent_removal', 0), ('C', 'silent_keep', 'silent_keep', 1), ('D', 'clean', 'clean', 1), ('D', 'silent_removal', 'silent_removal', 0),
 ('E', 'clean', 'clean', 1), ('E', 'marker', 'marker', 0), ('E', 'notice', 'notice_intact', 1), ('E', 'silent_removal', 'silent_removal', 0), ('E', 'silent_keep', 'silent_keep', 1))
"""


@query("s5_training_recipe", RECIPE + "SELECT r.condition, b.example_id, r.kind, r.available, b.gold_relation FROM b JOIN r ON r.part = b.part")
def s5(spark, sf):
    return recipe(spark, sf).select("condition", "example_id", "kind", "available", "gold_relation")


@query("s6_recipe_manifest", RECIPE + "SELECT r.condition, r.kind, r.available, COUNT(*) AS n FROM b JOIN r ON r.part = b.part GROUP BY 1, 2, 3")
def s6(spark, sf):
    return splits.recipe_manifest(recipe(spark, sf))


@query("s7_notice_flag", f"WITH {PRED} SELECT example_id, variant = 'mask_temporal_cue' AND NOT COALESCE(mc, FALSE) AS notice FROM p")
def s7(spark, sf):
    return predictions(spark, sf).select("example_id", reports.notice_flag(F.col("variant"), F.col("masked_cue")).alias("notice"))


@query("s8_text_gate")
def s8(spark, sf):
    from tracewell.operators.model import fit_text_gate, predict_text_gate
    d = notes(spark, sf).join(view(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("available")), "ord")
    model = fit_text_gate(d, features=1 << 12, max_iter=5)
    return predict_text_gate(model, notes(spark, sf)).select("note_id", "availability_probability", "max_relation_prob", "abstained", "answer")


@query("g19_apply_model", """SELECT note_id, LENGTH(text) / 1000.0 AS score, LENGTH(text) < 300 AS abstained FROM {f_notes}""")
def g19(spark, sf):
    from tracewell.operators.model import apply_model

    def scorer(pdf):
        return pdf.assign(score=pdf["text"].str.len() / 1000.0, abstained=pdf["text"].str.len() < 300)[["note_id", "score", "abstained"]]

    return apply_model(notes(spark, sf).select("note_id", "text"), scorer, "note_id string, score double, abstained boolean")
