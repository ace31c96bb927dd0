"""Acceptance of saved edit and span candidates, attempt by attempt."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import text as T
from tracewell.functions.scalars import let, strip
from tracewell.functions.spans import find_span
from tracewell.session import cut_lineage

ITEM = ["note_id", "variant"]


def edit_reasons(candidates: DataFrame, strict_only: bool = False, removal_ratio=K.REMOVAL_LENGTH_RATIO,
                 keep_ratio=K.KEEP_LENGTH_RATIO, max_novel_removal=K.MAX_NOVEL_REMOVAL, max_novel_keep=K.MAX_NOVEL_KEEP) -> DataFrame:
    """Add `reason` (NULL when the attempt is accepted) and, for usable attempts, `tier`,
    `length_ratio` and `novel_token_frac`.

    Needs note_id, variant, attempt, original_text, text, gold_relation, determinable, relation,
    event1_mentioned, event2_mentioned and optionally edit_error. Checks run from cheap to costly and
    stop at the first that fails.
    """
    removal = F.col("variant") == "silent_removal"
    original, edited = F.col("original_text"), F.col("text")
    error = F.col("edit_error") if "edit_error" in candidates.columns else F.lit(None).cast("string")
    ratio = T.length_ratio(original, edited)
    low = F.when(removal, removal_ratio[0]).otherwise(keep_ratio[0])
    high = F.when(removal, removal_ratio[1]).otherwise(keep_ratio[1])
    implied = removal & F.col("determinable")
    seen = F.coalesce(F.col("event1_mentioned") & F.col("event2_mentioned"), F.lit(False))
    # coalesce stops at the first objection, so costly checks only run on what is left.
    early = F.coalesce(
        F.when(error.isNotNull(), F.concat(F.lit("edit_error:"), error)),
        F.when(edited.isNull() | (strip(edited) == "") | (strip(edited) == strip(original)), "empty_or_unchanged"),
        F.when((ratio < low) | (ratio > high), "length_ratio"),
        let(T.new_markers(original, edited), lambda m: F.when(F.size(m) > 0, F.concat(F.lit("marker:"), F.array_join(m, "+")))))
    # Only texts without an objection so far go to Python.
    left = F.col("_early").isNull()
    novel = T.novel_frac(F.when(left, original), F.when(left, edited))
    late = F.coalesce(
        F.col("_early"),
        F.when(F.col("_novel") > F.when(removal, max_novel_removal).otherwise(max_novel_keep), "novel_tokens"),
        F.when(removal & T.has_explicit_cue(edited), "explicit_cue_remains"),
        F.when(F.col("determinable").isNull(), "judge_error"),
        F.when(~seen, "event_not_mentioned"),
        F.when(implied, F.lit("still_determinable" if strict_only else "implied_timing_retry")),
        F.when(~removal & ~(F.col("determinable") & F.col("relation").eqNullSafe(F.col("gold_relation"))), "relation_not_preserved"),
    )
    out = candidates.withColumn("_early", early).withColumn("_novel", novel).withColumn("reason", late)
    kept = F.col("reason").isNull() | (F.col("reason") == "implied_timing_retry")
    return out.withColumns({
        "tier": F.when(F.col("reason").isNull(), F.when(removal, "strict").otherwise("keep_verified"))
        .when(F.col("reason") == "implied_timing_retry", "implied_only"),
        "length_ratio": F.when(kept, F.round(ratio, 4)), "novel_token_frac": F.when(kept, F.round("_novel", 4))}).drop("_early", "_novel")


def accept_edit(reasoned: DataFrame) -> DataFrame:
    """Accepted attempt per note and variant: the first without objection, else the last implied one."""
    kept = F.struct("attempt", "text", "tier", "length_ratio", "novel_token_frac", "relation", "determinable")
    attempt = F.col("attempt")
    best = reasoned.groupBy(*ITEM).agg(
        F.min_by(kept, F.when(F.col("reason").isNull(), attempt)).alias("_first"),
        F.max_by(kept, F.when(F.col("tier") == "implied_only", attempt)).alias("_implied"))
    return best.withColumn("_k", F.coalesce("_first", "_implied")).where(F.col("_k").isNotNull()).select(*ITEM, "_k.*").withColumnsRenamed(
        {"attempt": "attempts", "tier": "validity_tier"})


def edit_rejections(reasoned: DataFrame) -> DataFrame:
    """Objections per variant, over the attempts made before the first acceptance.

    The reasons are written once: filters on them would otherwise be worked out before the columns they stand for, and again
    on both sides of the join.
    """
    reasoned = cut_lineage(reasoned.select(*ITEM, "attempt", "reason"))
    first = reasoned.where(F.col("reason").isNull()).groupBy(*ITEM).agg(F.min("attempt").alias("_first"))
    made = reasoned.join(first, ITEM, "left").where(F.col("reason").isNotNull() & (
        F.col("_first").isNull() | (F.col("attempt") < F.col("_first"))))
    short = F.when(F.col("reason").startswith("marker"), F.col("reason")).otherwise(F.split("reason", ":")[0])
    return made.groupBy("variant", short.alias("reason")).agg(F.count("*").alias("n"))


def original_valid(judged: DataFrame) -> DataFrame:
    """Notes on which the judge recovers the gold relation and sees both events."""
    ok = F.col("determinable") & (F.col("relation") == F.col("gold_relation")) & F.col("event1_mentioned") & F.col("event2_mentioned")
    return judged.where(F.coalesce(ok, F.lit(False)))


def edited_notes(notes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows of the accepted edits, with labels and provenance of the original note."""
    base = notes.withColumnRenamed("note_id", "base_note_id").withColumnRenamed("text", "original_text")
    base = base.drop("variant", "injected_spans", "contradiction_types")
    edit = accepted.withColumnRenamed("note_id", "base_note_id")
    joined = base.join(edit, "base_note_id")
    name = F.concat_ws("_", "base_note_id", "variant")
    return joined.withColumns({
        "note_id": name, "example_id": name, "evidence_case": F.col("variant"),
        "evidence_available_oracle": F.when(F.col("variant") == "silent_removal", 0).otherwise(1),
        "contradiction_present_oracle": F.lit(0), "removed_gold_span": F.lit(False), "masked_cue": F.lit(False),
        "injected_spans": F.lit(""), "contradiction_types": F.lit("")})


def edit_report(accepted: DataFrame, notes: DataFrame, n_valid: DataFrame, test_patients: DataFrame | None = None) -> DataFrame:
    """Per variant: accepted edits, their share of the valid originals, mean attempts and novelty."""
    rows = accepted.join(notes.select("note_id", "patient_id"), "note_id", "left")
    in_test = F.lit(None).cast("int")
    if test_patients is not None:
        rows = rows.join(test_patients.select("patient_id").distinct().withColumn("_test", F.lit(1)), "patient_id", "left")
        in_test = F.count("_test")
    total = n_valid.agg(F.count("*").alias("n_valid_originals"))
    return rows.groupBy("variant").agg(
        F.count("*").alias("accepted"), F.round(F.avg("attempts"), 3).alias("mean_attempts"),
        F.round(F.avg("novel_token_frac"), 4).alias("mean_novel_token_frac"), in_test.alias("rows_in_test_patients"),
    ).crossJoin(total).withColumn(
        "accepted_of_valid_originals", F.round(F.col("accepted") / F.greatest(F.lit(1), F.col("n_valid_originals")), 4))


def edit_tiers(accepted: DataFrame, notes: DataFrame) -> DataFrame:
    """Accepted edits by variant, tier and note style."""
    return accepted.join(notes.select("note_id", "style"), "note_id", "left").groupBy("variant", "validity_tier", "style").agg(
        F.count("*").alias("n"))


# ---------------------------------------------------------------- gold spans

def span_reasons(candidates: DataFrame) -> DataFrame:
    """Add `reason` per relocation attempt.

    Needs note_id, attempt, text, original_span, span, parse_error, call_error, relation_entailed,
    same_information.
    """
    span = F.col("span")
    return candidates.withColumn("reason", (
        F.when(F.col("original_span").isNull() | (strip("original_span") == ""), "no_original_span")
        .when(F.col("call_error").isNotNull(), F.concat(F.lit("relocate_error:"), F.col("call_error")))
        .when(F.col("parse_error"), "invalid_json")
        .when(span.isNull(), "evidence_lost_in_paraphrase")
        .when(find_span("text", "span") < 0, "not_verbatim")
        .when(F.col("relation_entailed").isNull(), "judge_error")
        .when(~F.col("relation_entailed"), "relation_not_entailed")
        .otherwise("accepted")))


def accept_span(reasoned: DataFrame) -> DataFrame:
    """Outcome per note: the first attempt that settles it, else `attempts_exhausted`."""
    settled = F.col("reason").isin("no_original_span", "evidence_lost_in_paraphrase", "accepted")
    tier = F.when(F.coalesce("same_information", F.lit(False)), "verified").otherwise("relation_only")
    row = F.struct("reason", "attempt", "span", tier.alias("tier"))
    best = reasoned.groupBy("note_id").agg(
        F.min_by(row, F.when(settled, F.col("attempt"))).alias("_r"), F.max("attempt").alias("_last"))
    accepted = F.col("_r.reason") == "accepted"
    reason = F.coalesce(F.col("_r.reason"), F.lit("attempts_exhausted"))
    return best.select(
        "note_id", reason.alias("reason"),
        F.when(accepted, F.col("_r.span")).alias("gold_evidence_span_v2"), F.when(accepted, F.col("_r.tier")).alias("validity_tier"),
        F.when(reason != "no_original_span", F.coalesce("_r.attempt", "_last")).alias("attempts"))


def span_report(outcomes: DataFrame) -> DataFrame:
    """Outcome shares over all notes."""
    n = F.greatest(F.lit(1), F.count("*"))
    hit = lambda r: F.count(F.when(F.col("reason") == r, 1))
    return outcomes.agg(
        F.count("*").alias("n_notes"), hit("accepted").alias("accepted"), F.round(hit("accepted") / n, 4).alias("accepted_rate"),
        F.round(hit("evidence_lost_in_paraphrase") / n, 4).alias("evidence_lost_in_paraphrase_rate"),
        F.round(F.avg(F.when(F.col("reason") == "accepted", F.col("attempts"))), 3).alias("mean_attempts_accepted"))


def span_tiers(outcomes: DataFrame, notes: DataFrame) -> DataFrame:
    return outcomes.join(notes.select("note_id", "style"), "note_id").groupBy("reason", "validity_tier", "style").agg(F.count("*").alias("n"))
