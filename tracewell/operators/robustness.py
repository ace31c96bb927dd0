"""Behaviour under edits and perturbations: manipulation rates and certificates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import text as T
from tracewell.functions.hashing import draw_key
from tracewell.functions.spans import (find_span, injected_spans, range_jaccard, range_recall, ranges_overlap_any)
from tracewell.functions.stats import ratio, with_lower_bound


def manipulation_eval(edited: DataFrame, base: DataFrame) -> DataFrame:
    """Per variant: abstention, stability of the answer, citations of injected text, evidence recall.

    `edited`: base_note_id, variant, text, injected_spans, gold_evidence_span, abstained, relation,
    ranges. `base`: note_id, abstained, relation. Rows without a base note are left out; rates are
    over all rows of the variant.
    """
    b = base.select(F.col("note_id").alias("base_note_id"), F.col("abstained").alias("_ba"), F.col("relation").alias("_br"))
    rows = edited.join(b, "base_note_id")
    adversarial = F.col("variant") == "adversarial"
    answered = ~F.col("abstained")
    stable = answered & ~F.col("_ba") & F.col("relation").eqNullSafe(F.col("_br"))
    shifted = answered & adversarial & ranges_overlap_any(injected_spans("injected_spans", "text"), F.col("ranges"))
    start = find_span("text", "gold_evidence_span")
    recall = F.when(answered & ~adversarial, range_recall(start, start + F.char_length("gold_evidence_span"), F.col("ranges")))
    share = lambda c: F.count(F.when(c, 1)) / F.greatest(F.lit(1), F.count("*"))
    return rows.withColumns({"_stable": stable, "_shift": shifted, "_recall": recall}).groupBy("variant").agg(
        F.count("*").alias("n"), share(F.col("abstained")).alias("abstain_rate"), share(F.col("_stable")).alias("prediction_stability"),
        share(F.col("_shift")).alias("evidence_shift_rate"), F.avg("_recall").alias("mean_evidence_recall"))


def perturbed_notes(notes: DataFrame, n_samples: int, budget: int = 2, seed: int = 7, kinds=K.PERTURBATIONS) -> DataFrame:
    """n_samples perturbed copies of each note, one row each: the inputs of a certificate."""
    rows = notes.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))
    rows = rows.withColumn("_p", T.sample_perturbation(draw_key(seed, "note_id", "sample"), budget, kinds))
    return rows.withColumns({
        "perturbation": F.col("_p.kind"), "k": F.col("_p.k"),
        "text": T.perturb(F.col("text"), F.col("_p.kind"), F.col("_p.k"), F.xxhash64("note_id", "sample"))}).drop("_p")


def certify(base: DataFrame, perturbed: DataFrame, alpha: float = 0.05, theta: float = 0.5) -> DataFrame:
    """Certificate per note from gate results on perturbed copies.

    `base`: note_id, abstained, relation, ranges. `perturbed`: note_id, text_len, abstained,
    relation, ranges, perturbation. Both lower bounds at alpha / 2 must reach 1 - alpha; an
    abstention counts against both.
    """
    b = base.select("note_id", F.col("abstained").alias("_ba"), F.col("relation").alias("_br"), F.col("ranges").alias("_bg"))
    rows = perturbed.join(b.where(~F.col("_ba")), "note_id")
    answered = ~F.col("abstained")
    near = range_jaccard("ranges", "_bg", F.col("text_len")) >= theta
    counted = rows.groupBy("note_id").agg(
        F.count("*").alias("n_samples"),
        F.count(F.when(answered & F.col("relation").eqNullSafe(F.col("_br")), 1)).alias("n_pred_success"),
        F.count(F.when(answered & near, 1)).alias("n_evi_success"))
    out = b.select("note_id", F.col("_ba").alias("base_abstained")).join(counted, "note_id", "left")
    out = with_lower_bound(out, "n_pred_success", "n_samples", alpha / 2, "p_pred_lower")
    out = with_lower_bound(out, "n_evi_success", "n_samples", alpha / 2, "p_evi_lower")
    pred_ok, evi_ok = F.col("p_pred_lower") >= 1 - alpha, F.col("p_evi_lower") >= 1 - alpha
    certified = ~F.col("base_abstained") & pred_ok & evi_ok
    return out.withColumns({
        "status": F.when(certified, "CERTIFIED").otherwise("UNCERTIFIED"),
        "reason": F.when(F.col("base_abstained"), "base_input_abstained").when(~pred_ok, "prediction").when(~evi_ok, "provenance")})


def perturbation_counts(perturbed: DataFrame) -> DataFrame:
    return perturbed.groupBy("note_id", "perturbation").agg(F.count("*").alias("n"))


def certification_summary(certificates: DataFrame, n_samples: int, alpha: float = 0.05) -> DataFrame:
    """Counts and mean bounds, with the highest bound that n_samples can reach."""
    ceiling = (alpha / 2) ** (1 / n_samples) if n_samples else 0.0  # all successes of n: the quantile in closed form
    hit = lambda c: F.count(F.when(c, 1))
    return certificates.agg(
        F.count("*").alias("n_examples"), hit(F.col("status") == "CERTIFIED").alias("n_certified"),
        hit(F.col("reason") == "base_input_abstained").alias("n_base_abstained"),
        F.coalesce(ratio(hit(F.col("status") == "CERTIFIED"), F.count("*")), F.lit(0.0)).alias("certification_rate"),
        F.avg("p_pred_lower").alias("mean_prediction_confidence"), F.avg("p_evi_lower").alias("mean_provenance_confidence"),
        F.lit(ceiling).alias("ceiling"), F.lit(ceiling >= 1 - alpha).alias("ceiling_reaches_target"))
