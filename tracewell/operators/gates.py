"""Decisions over saved model responses: cited evidence, agreement of re-queries, thresholds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import find_span, locate_spans_fuzzy


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def span_coverage(text, span, min_chars: int = 10, min_frac: float = 0.03) -> Column:
    """Struct(valid, coverage, enough): the span is verbatim, its share of the note, both limits met."""
    text, span = _c(text), _c(span)
    valid = find_span(text, span) >= 0
    n = F.char_length(F.coalesce(span, F.lit("")))
    coverage = F.when(valid, n / F.greatest(F.lit(1), F.char_length(text))).otherwise(F.lit(0.0))
    return F.struct(valid.alias("valid"), coverage.alias("coverage"),
                    (valid & (n >= min_chars) & (coverage >= min_frac)).alias("enough"))


def reask_agreement(responses: DataFrame, probes: DataFrame, key: str = "example_id") -> DataFrame:
    """Add `agreement`: share of re-queries that repeat the relation; 0 without a relation or probe."""
    asked = probes.select(key, F.col("relation").alias("_probe"))
    first = responses.select(key, F.col("relation").alias("_first"))
    share = asked.join(first, key).groupBy(key).agg(
        F.avg(F.coalesce((F.col("_probe") == F.col("_first")).cast("int"), F.lit(0))).alias("agreement"))
    return responses.join(share, key, "left").withColumn(
        "agreement", F.when(F.col("relation").isNull(), F.lit(0.0)).otherwise(F.coalesce("agreement", F.lit(0.0))))


def availability_gate(responses: DataFrame, min_chars: int = 10, min_frac: float = 0.03,
                      agreement_threshold: float = 0.5) -> DataFrame:
    """Add gate_reason, abstained, answer, correct, coverage and evidence_span_valid.

    Needs text, relation, evidence_span, agreement and gold_relation. The first failing check gives
    the reason: no relation, too little verbatim evidence, re-queries that disagree.
    """
    span = span_coverage("text", "evidence_span", min_chars, min_frac)
    reason = (F.when(F.col("relation").isNull(), "no_relation")
              .when(~F.col("_s.enough"), "insufficient_evidence_span")
              .when(F.col("agreement") < agreement_threshold, "necessity_check_failed"))
    out = responses.withColumn("_s", span).withColumn("gate_reason", reason)
    kept = F.col("gate_reason").isNull()
    return out.select(
        *responses.columns, "gate_reason", (~kept).alias("abstained"),
        F.when(kept, F.col("relation")).alias("answer"),
        F.when(kept, (F.col("relation") == F.col("gold_relation")).cast("int")).alias("correct"),
        F.col("_s.coverage").alias("coverage"), F.col("_s.valid").alias("evidence_span_valid"))


def baseline_and_gated(gated: DataFrame, names=("baseline", "gated")) -> DataFrame:
    """Two prediction rows per response: the ungated one abstains only without a relation."""
    rows = gated.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names])))
    is_gated = F.col("model") == names[1]
    abstained = F.col("relation").isNull() | (is_gated & F.col("gate_reason").isNotNull())
    return rows.withColumns({
        "abstained": abstained,
        "answer": F.when(~abstained, F.col("relation")),
        "correct": F.when(~abstained, (F.col("relation") == F.col("gold_relation")).cast("int")),
        "gate_reason": F.when(is_gated, F.col("gate_reason")),
    })


def hard_gate(responses: DataFrame, probes: DataFrame, key: str = "note_id", min_chars: int = 10, min_frac: float = 0.03,
              change_threshold: float = 0.5, fuzzy_threshold: float = 0.85) -> DataFrame:
    """Span gate with masked probes.

    `responses`: key, text, relation, evidence_spans, confidence, failed. `probes`: key, relation,
    failed for queries on the note with its cited ranges masked. Evidence is necessary when enough
    probes change the relation.
    """
    located = locate_spans_fuzzy(responses, "text", "evidence_spans", threshold=fuzzy_threshold)
    located = located.withColumn("coverage", F.col("coverage_chars") / F.greatest(F.lit(1), F.char_length("text")))
    first = responses.select(key, F.col("relation").alias("_first"))
    probed = probes.where(~F.col("failed")).join(first, key).groupBy(key).agg(
        F.count("*").alias("n_valid_probes"),
        F.avg((~F.col("relation").eqNullSafe(F.col("_first"))).cast("int")).alias("change_fraction"))
    low = (F.size("ranges") == 0) | (F.col("coverage_chars") < min_chars) | (F.col("coverage") < min_frac)
    reason = (F.when(F.col("failed"), "llm_call_failed").when(low, "low_coverage")
              .when(F.col("n_valid_probes").isNull(), "necessity_probe_failed")
              .when(F.col("change_fraction") < change_threshold, "necessity_check_failed"))
    out = located.join(probed, key, "left").withColumn("reason", reason)
    checked = F.col("reason").isNull() | (F.col("reason") == "necessity_check_failed")
    return out.withColumns({
        "abstained": F.col("reason").isNotNull(),
        "necessity_satisfied": F.when(checked, F.col("change_fraction") >= change_threshold),
        "relation": F.when(~F.col("failed"), F.col("relation")),
    })


def coverage_gate(scores: DataFrame, tau: float = 0.5, min_coverage: float = 0.08, min_drop: float | None = None) -> DataFrame:
    """Token gate: share of token scores at or above tau, then the drop without the evidence.

    Needs evidence_scores, probs and necessity_drop; adds coverage, ev_mask, argmax, abstained, reason.
    """
    mask = F.transform("evidence_scores", lambda s: F.when(s >= tau, 1).otherwise(0))
    out = scores.withColumn("ev_mask", mask).withColumn(
        "coverage", F.coalesce(F.try_divide(F.aggregate("ev_mask", F.lit(0), lambda a, x: a + x), F.size("ev_mask")), F.lit(0.0)))
    reason = F.when(F.col("coverage") < min_coverage, "low_coverage")
    if min_drop is not None:
        reason = reason.when(F.col("necessity_drop") < min_drop, "necessity_check_failed")
    return out.withColumns({
        "argmax": (F.array_position("probs", F.array_max("probs")) - 1).cast("int"),
        "reason": reason, "abstained": reason.isNotNull()})


def availability_threshold_gate(scores: DataFrame, threshold: float, labels: list[str]) -> DataFrame:
    """Abstain when a gated model's availability probability is below the threshold.

    Needs probs, availability_probability and is_gate; adds argmax_relation, max_relation_prob,
    abstained and answer.
    """
    names = F.array(*[F.lit(x) for x in labels])
    best = F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int"))
    abstained = F.col("is_gate") & (F.col("availability_probability") < threshold)
    return scores.withColumns({
        "argmax_relation": best, "max_relation_prob": F.array_max("probs"), "abstained": abstained,
        "answer": F.when(~abstained, best), "gate_reason": F.when(abstained, "evidence_unavailable")})
