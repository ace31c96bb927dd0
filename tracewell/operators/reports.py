"""Selective-prediction, abstention and paired reports over prediction tables.

A prediction table has example_id, model, answer, abstained (boolean) and correct (0/1 or NULL);
`sources.readers.read_predictions` makes one from files.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.scalars import has_injected_content, printed_status, strip, to_double
from tracewell.functions.spans import alignment_status, char_overlap, notice_visibility, notice_visible_tokens
from tracewell.functions.stats import ratio, wilson_high, wilson_low
from tracewell.functions.text import day_mentions, find_cue, has_digit, word_count
from tracewell.operators import ranking
from tracewell.operators.running import on_keys
from tracewell.session import cut_lineage
from tracewell.sources.readers import accepted_spans


def answered() -> Column:
    return ~F.col("abstained")


def correct() -> Column:
    """Answered and correct; a missing `correct` counts as wrong."""
    return answered() & F.coalesce(to_double("correct") == 1, F.lit(False))


def n_of(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rate(cond: Column, base: Column) -> Column:
    """Share of the rows with `base` that also have `cond`; NULL when there are none."""
    return ratio(n_of(base & cond), n_of(base))


def per_model(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates per model plus a row `overall`; rows without a model count in the latter alone."""
    out = df.rollup("model").agg(*aggs, F.grouping("model").alias("_all"))
    return out.where(F.col("model").isNotNull() | (F.col("_all") == 1)).withColumn("model", F.coalesce("model", F.lit("overall"))).drop("_all")


# ---------------------------------------------------------------- selective prediction

def metrics_at_threshold(df: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Coverage, accuracy, risk and evidence-label rates when answering at or above a threshold."""
    chosen = answered() & (F.col("score") >= threshold)
    label = to_double("evidence_sufficient") if "evidence_sufficient" in df.columns else F.lit(None).cast("double")
    work = df.withColumns({"_sel": chosen, "_ok": correct(), "_label": label})
    sel, ok, lab = F.col("_sel"), F.col("_ok"), F.col("_label")
    n_sel, n_ok = n_of(sel), n_of(sel & ok)
    out = work.groupBy(*keys).agg(
        F.count("*").alias("n_total"), n_sel.alias("n_answered"), n_ok.alias("n_correct"),
        ratio(n_sel, F.count("*")).alias("coverage"), ratio(n_ok, n_sel).alias("selective_accuracy"),
        (1 - ratio(n_ok, n_sel)).alias("selective_risk"),
        F.avg(F.col("abstained").cast("int")).alias("existing_abstention_rate"),
        n_of(lab.isNotNull()).alias("n_labeled"), n_of(lab == 1).alias("n_sufficient"), n_of(lab == 0).alias("n_insufficient"),
        rate(sel, lab == 1).alias("sufficient_answer_rate"), rate(~sel, lab == 0).alias("insufficient_abstention_rate"),
        rate(sel & ~ok, lab == 0).alias("insufficient_unsafe_answer_rate"))
    return out.withColumns({
        "accuracy_lo": wilson_low("n_correct", "n_answered", K.Z_EXACT, clamp=True),
        "accuracy_hi": wilson_high("n_correct", "n_answered", K.Z_EXACT, clamp=True),
        "label_status": F.when(F.col("n_labeled") > 0, "evaluated").otherwise("not_evaluable")})


def mechanism_metrics(df: DataFrame) -> DataFrame:
    """How completely gate reasons, provenance and scores are recorded, per model and overall."""
    has = lambda c: c in df.columns
    reason = F.length(F.coalesce(F.col("gate_reason").cast("string"), F.lit(""))) > 0 if has("gate_reason") else F.lit(False)
    recorded = F.coalesce(to_double(F.col("provenance_recorded").cast("string")) != 0, F.col("provenance_recorded").cast("string") == "true",
                          F.lit(False)) if has("provenance_recorded") else F.lit(False)
    flag = lambda c: F.avg(c.cast("int"))
    return per_model(
        df, F.count("*").alias("n"), flag(F.col("abstained")).alias("abstention_rate"), flag(reason).alias("gate_reason_rate"),
        flag(recorded).alias("provenance_recorded_rate"),
        rate(F.col("score").isNotNull(), answered()).alias("answer_has_evidence_score_rate"))


def selective_report(dev: DataFrame, test: DataFrame, target: float, threshold: float | None = None, repeats: int = 1000, seed: int = 7) -> DataFrame:
    """AURC, metrics at the chosen threshold and a random control of equal coverage, per model and overall.

    The threshold is the given one, or chosen on development data. The control is the accuracy of random subsets of
    the target size; a threshold that does no better does not select.
    """
    if threshold is None:
        curve = ranking.risk_coverage_curve(dev, [], "score", answered(), correct())
        chosen = ranking.choose_threshold(curve, [], target).select(F.col("threshold").alias("_t"), F.col("status").alias("threshold_source"))
    else:
        chosen = dev.sparkSession.range(1).select(F.lit(float(threshold)).alias("_t"), F.lit("user_fixed_threshold").alias("threshold_source"))
    both = test.withColumn("model", F.explode(F.array(F.col("model"), F.lit("overall"))))
    area = ranking.aurc_trapezoid(ranking.risk_coverage_curve(both, ["model"], "score", answered(), correct()), ["model"])
    scored = on_keys(both, chosen, [])
    keys = ["model", "_t", "threshold_source"]
    at = metrics_at_threshold(scored, keys, F.col("_t"))
    means = both.groupBy("model").agg(F.avg("score").alias("mean_score"))
    control = ranking.random_matched_coverage(both, ["model"], answered(), correct(), target, repeats, seed)
    control = control.select("model", *[F.col(c).alias(f"random_{c}") for c in control.columns if c != "model"])
    out = on_keys(on_keys(on_keys(at, area, ["model"]), means, ["model"]), control, ["model"])
    return out.withColumnRenamed("_t", "threshold").withColumn(
        "threshold_selection_warning", F.col("threshold_source") != "dev_min_risk_at_target_coverage")


def workflow_outcomes(df: DataFrame) -> DataFrame:
    """Success and unsafe-error rates with Wilson intervals, mean and median time per system."""
    cols = {c: to_double(c) for c in ("task_success", "unsafe_error", "time_seconds")}
    work = df.withColumns(cols)
    out = work.groupBy("system").agg(
        F.count("*").alias("n_cases"), *[f(c).alias(f"_{n}_{c}") for c in ("task_success", "unsafe_error")
                                         for n, f in (("n", F.count), ("k", F.sum))],
        F.avg("time_seconds").alias("mean_time_seconds"))
    median = ranking.exact_quantiles(work, ["system"], ["time_seconds"], {"median": 0.5})
    z = K.Z_EXACT
    stats = {}
    for c in ("task_success", "unsafe_error"):
        k, n = F.col(f"_k_{c}"), F.col(f"_n_{c}")
        stats |= {f"{c}_rate": ratio(k, n), f"{c}_lo": wilson_low(k, n, z, True), f"{c}_hi": wilson_high(k, n, z, True)}
    return out.withColumns(stats).drop(*[c for c in out.columns if c.startswith("_")]).join(median, "system", "left")


# ---------------------------------------------------------------- labels and abstention

def clean_labels(notes: DataFrame) -> DataFrame:
    """Evidence label and alignment of the gold span for clean notes, last row per id."""
    sufficient = F.col("gold_relation").isNotNull() & F.coalesce(strip("gold_evidence_span") != "", F.lit(False))
    return notes.select(
        F.col("note_id").cast("string").alias("example_id"), sufficient.cast("int").alias("evidence_sufficient_oracle"),
        F.lit(0).alias("contradiction_present_oracle"),
        alignment_status("text", "gold_evidence_span", sufficient).alias("evidence_alignment_status"),
        F.lit("clean").alias("oracle_source"))


def adversarial_labels(adversarial: DataFrame) -> DataFrame:
    injected = F.lit(False)
    for c in ("injected_spans", "contradiction_types"):
        if c in adversarial.columns:
            injected = injected | has_injected_content(c)
    return adversarial.select(
        F.col("note_id").cast("string").alias("example_id"), F.lit(None).cast("int").alias("evidence_sufficient_oracle"),
        injected.cast("int").alias("contradiction_present_oracle"),
        F.lit("adversarial_not_clean_evidence_label").alias("evidence_alignment_status"), F.lit("adversarial").alias("oracle_source"))


def oracle_labels(notes: DataFrame, adversarial: DataFrame | None = None) -> DataFrame:
    """Labels by example; adversarial ones override clean ones of the same id."""
    both = clean_labels(notes)
    if adversarial is not None:
        both = both.unionByName(adversarial_labels(adversarial))
    fields = [c for c in both.columns if c != "example_id"]
    # "adversarial" sorts before "clean".
    best = both.groupBy("example_id").agg(F.min_by(F.struct(*fields), F.struct("oracle_source", "evidence_sufficient_oracle")).alias("_b"))
    return best.select("example_id", "_b.*")


def oracle_abstention(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Abstention against the evidence and contradiction labels, per model and overall."""
    df = predictions.join(labels, "example_id", "left")
    ans, ok, abst = answered(), correct(), F.col("abstained")
    label = F.col("evidence_sufficient_oracle")
    contra = F.coalesce(F.col("contradiction_present_oracle") == 1, F.lit(False))
    out = per_model(
        df, F.count("*").alias("n"), rate(abst, F.lit(True)).alias("abstention_rate"), rate(ans, F.lit(True)).alias("coverage"),
        n_of(label == 1).alias("n_sufficient"), n_of(label == 0).alias("n_insufficient"), n_of(label.isNull()).alias("n_unlabeled"),
        n_of(contra).alias("n_contradiction"),
        rate(ans, label == 1).alias("sufficient_answer_rate"), rate(abst, label == 1).alias("sufficient_false_abstention_rate"),
        rate(abst, label == 0).alias("insufficient_abstention_recall"), rate(ans & ~ok, label == 0).alias("insufficient_unsafe_rate"),
        rate(abst, contra).alias("contradiction_abstention_rate"), rate(ans & ~ok, contra).alias("contradiction_unsafe_rate"),
        n_of(ans).alias("n_answered"), n_of(ok).alias("n_correct"), rate(ok, ans).alias("answered_accuracy"))
    return out.withColumns({"accuracy_lo": wilson_low("n_correct", "n_answered", K.Z_EXACT, True),
                            "accuracy_hi": wilson_high("n_correct", "n_answered", K.Z_EXACT, True)})


def alignment_counts(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per model and alignment status; unlabelled rows keep a NULL status."""
    return predictions.join(labels, "example_id", "left").groupBy("model", "evidence_alignment_status").agg(F.count("*").alias("n"))


def evidence_case(example_id: str = "example_id") -> Column:
    """Case named by the id suffix, else `evidence_unavailable`."""
    return F.coalesce(F.nullif(F.regexp_extract(example_id, "_(remove_evidence|mask_temporal_cue)$", 1), F.lit("")),
                      F.lit("evidence_unavailable"))


def _control_aggs() -> list[Column]:
    ans, ok = answered(), correct()
    every = F.lit(True)
    return [F.count("*").alias("control_n"), rate(F.col("abstained"), every).alias("control_abstention_recall"),
            rate(ans, every).alias("control_coverage"), rate(ans & ~ok, every).alias("control_unsafe_answer_rate"),
            rate(ok, ans).alias("control_answered_accuracy")]


def control_abstention(clean: DataFrame, control: DataFrame) -> DataFrame:
    """Clean coverage beside abstention on controls, over the models of either side."""
    ans = answered()
    c = clean.groupBy("model").agg(
        F.count("*").alias("clean_n"), rate(ans, F.lit(True)).alias("clean_coverage"),
        rate(F.col("abstained"), F.lit(True)).alias("clean_false_abstention_rate"), rate(correct(), ans).alias("clean_answered_accuracy"))
    return c.join(control.groupBy("model").agg(*_control_aggs()), "model", "full_outer")


def control_abstention_by_case(control: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The control side by evidence case, from the control labels where given, else from the id."""
    df = control
    case = evidence_case()
    if labels is not None:
        df = df.join(labels.select("example_id", F.col("evidence_case").alias("_case")), "example_id", "left")
        case = F.coalesce("_case", case)
    return df.withColumn("evidence_case", case).groupBy("model", "evidence_case").agg(*_control_aggs())


def _summary(z=K.Z_ROUNDED):
    """Abstention and unsafe answers with intervals, over rows that carry abstained and correct."""
    aggs = [F.count("*").alias("n"), n_of(answered()).alias("n_answered"), n_of(correct()).alias("_c")]
    abst, unsafe = F.col("n") - F.col("n_answered"), F.col("n_answered") - F.col("_c")
    derived = {
        "abstention_recall": ratio(abst, "n"), "abst_ci_low": wilson_low(abst, "n", z), "abst_ci_high": wilson_high(abst, "n", z),
        "coverage_on_unavailable": ratio("n_answered", "n"), "unsafe_answer_rate": ratio(unsafe, "n"),
        "unsafe_ci_low": wilson_low(unsafe, "n", z), "unsafe_ci_high": wilson_high(unsafe, "n", z),
        "answered_accuracy": ratio("_c", "n_answered")}
    return aggs, derived


def on_same_notes(members: DataFrame, side: DataFrame, other_models: bool = True) -> DataFrame:
    """Rows of `side` on the base notes of `members`, which has example_id.

    Where both name a model, a model is held against its own rows. One that `side` does not know is
    held against the rows of all models with `other_models`, else against none.
    """
    if "model" not in members.columns or "model" not in side.columns:
        return members.join(side.drop("model"), "example_id")
    theirs = side.withColumnRenamed("model", "_model")
    known = theirs.select(F.col("_model").alias("model")).distinct().withColumn("_known", F.lit(True))
    matched = members.join(known, "model", "left" if other_models else "inner").join(theirs, "example_id")
    return matched.where(F.col("_known").isNull() | F.col("_model").eqNullSafe(F.col("model"))).drop("_known", "_model")


def paired_clean(members: DataFrame, clean: DataFrame, keys: list[str], other_models: bool = True) -> DataFrame:
    """Clean results on the base notes of each group: members holds keys and base_id."""
    base = members.select(*keys, F.col("base_id").alias("example_id")).distinct()
    model = [c for c in ("model",) if c in clean.columns]
    side = clean.select("example_id", *model, answered().alias("_a"), correct().alias("_o"))
    return on_same_notes(base, side, other_models).groupBy(*keys).agg(
        F.count("*").alias("clean_n_same_notes"), F.avg(F.col("_a").cast("int")).alias("clean_coverage_same_notes"),
        ratio(n_of(F.col("_o")), n_of(F.col("_a"))).alias("clean_answered_accuracy_same_notes"))


def stratified_paired(control: DataFrame, clean: DataFrame | None = None, other_models: bool = True) -> DataFrame:
    """Abstention per model and stratum, next to clean results on the same notes.

    `control` has variant, base_id, masked_cue (boolean or NULL) and validity_tier.
    """
    v, tier = F.col("variant"), F.col("validity_tier")
    mask = v == "mask_temporal_cue"
    masked = F.coalesce(F.col("masked_cue"), F.lit(False))
    other = ~v.isin("remove_evidence", "mask_temporal_cue")
    strata = F.array_compact(F.array(
        F.when(v == "remove_evidence", F.struct(F.lit("remove_evidence").alias("stratum"), F.lit(False).alias("tiered"))),
        F.when(mask, F.struct(F.lit("mask_temporal_cue (all)").alias("stratum"), F.lit(False).alias("tiered"))),
        F.when(mask & masked, F.struct(F.lit("mask_temporal_cue: token inserted (masked_cue=True)").alias("stratum"), F.lit(False).alias("tiered"))),
        F.when(mask & ~masked, F.struct(F.lit("mask_temporal_cue: note intact + notice (masked_cue=False)").alias("stratum"), F.lit(False).alias("tiered"))),
        F.when(other, F.struct(v.alias("stratum"), F.lit(False).alias("tiered"))),
        F.when(other & tier.isNotNull(), F.struct(F.concat(v, F.lit(" ["), tier, F.lit("]")).alias("stratum"), F.lit(True).alias("tiered")))))
    rows = control.where(v.isNotNull()).select("*", F.explode(strata).alias("_s")).select("*", "_s.*").drop("_s")
    aggs, derived = _summary()
    keys = ["model", "stratum"]
    out = rows.groupBy(*keys, "variant", "tiered").agg(*aggs).withColumns(derived)
    # Tiers are listed only where a variant has more than one.
    n_tiers = control.where(tier.isNotNull()).groupBy("model", "variant").agg(
        (F.min("validity_tier") != F.max("validity_tier")).alias("_many"))
    out = out.join(n_tiers, ["model", "variant"], "left").where(~F.col("tiered") | F.col("_many")).drop("variant", "tiered", "_many", "_c")
    if clean is not None:
        out = out.join(paired_clean(rows, clean, keys, other_models), keys, "left").withColumn(
            "clean_n_same_notes", F.coalesce("clean_n_same_notes", F.lit(0)))
    return out


def control_composition(control: DataFrame, token: str = K.MASK_TOKEN) -> DataFrame:
    """Rows, distinct texts and masked texts per variant. Texts are compared by digest."""
    digest = F.sha2("text", 256)
    return control.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_distinct(digest).alias("distinct_texts"),
        n_of(F.contains(F.col("text"), F.lit(token))).alias("token_inserted"))


def per_class_breakdown(control: DataFrame, clean: DataFrame, relations=K.RELATIONS, other_models: bool = True) -> DataFrame:
    """Coverage, accuracy and predicted classes per variant, tier (and over tiers) and gold class,
    on the edited notes and on the clean versions of the same notes, by the same model where both name one."""
    tier = F.coalesce("validity_tier", F.lit("keep"))
    edited = control.select("variant", tier.alias("tier"), "gold_relation", "answer", "abstained", F.lit("edited").alias("condition"))
    named = lambda df: [c for c in ("model",) if c in df.columns]
    members = control.select("variant", tier.alias("tier"), "gold_relation", *named(control), F.col("base_id").alias("example_id"))
    paired = on_same_notes(members, clean.select("example_id", *named(clean), "answer", "abstained"), other_models).select(
        "variant", "tier", "gold_relation", "answer", "abstained", F.lit("clean_same_notes").alias("condition"))
    rows = edited.unionByName(paired).where(F.col("variant").isNotNull() & F.col("gold_relation").isNotNull())
    ans = answered()
    share = {f"pred_{i}": rate(F.col("answer").eqNullSafe(F.lit(r)), ans) for i, r in enumerate(relations)}
    out = rows.groupingSets([["condition", "variant", "tier", "gold_relation"], ["condition", "variant", "gold_relation"]],
                            "condition", "variant", "tier", "gold_relation").agg(
        F.count("*").alias("n"), rate(ans, F.lit(True)).alias("coverage"), n_of(ans).alias("n_answered"),
        rate(F.col("answer").eqNullSafe(F.col("gold_relation")), ans).alias("accuracy"), *[c.alias(n) for n, c in share.items()])
    return out.withColumn("tier", F.coalesce("tier", F.lit("all")))


def baseline_table(clean: DataFrame, control: DataFrame, target: float, n_boot: int = 0, seed: int = 7) -> DataFrame:
    """Thresholding a score at a clean coverage: coverage, accuracy and AUROC per condition.

    Both sides have score (NULL when missing) and correct (boolean); `control` has `condition`.
    """
    chosen = ranking.threshold_for_coverage(clean, [], "score", target)
    t = chosen.select("threshold")
    rows = clean.withColumn("condition", F.lit("clean")).select("condition", "score", "correct").unionByName(
        control.select("condition", "score", "correct")).crossJoin(F.broadcast(t))
    above = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    out = rows.groupBy("condition", "threshold").agg(
        F.count("*").alias("n"), rate(above, F.lit(True)).alias("coverage"), rate(F.col("correct"), above).alias("answered_accuracy"))
    filled = lambda d: d.withColumn("score", F.coalesce("score", F.lit(-1e9)))
    auc = ranking.auroc_against(filled(clean), filled(control), [], "condition", "score").select("condition", F.col("auroc").alias("auroc_vs_clean"))
    out = out.withColumn("abstention", 1 - F.col("coverage")).join(auc, "condition", "left")
    if n_boot:
        sets = control.select("condition").distinct()
        pos = filled(clean).groupBy("score").agg(F.count("*").alias("pos")).crossJoin(sets).withColumn("neg", F.lit(0).cast("long"))
        neg = filled(control).groupBy("condition", "score").agg(F.count("*").alias("neg")).withColumn("pos", F.lit(0).cast("long"))
        cells = pos.unionByName(neg).groupBy("condition", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        out = out.join(ranking.bootstrap_auroc(cells, ["condition"], n_boot, seed), "condition", "left")
    return out


def subset_scores(edited: DataFrame, clean: DataFrame, id_sets: DataFrame, gate: str = "model") -> DataFrame:
    """Clean and edited results per gate on sets of base notes.

    `edited` has kind and base_id; `id_sets` has set, kind and note_id.
    """
    ids = id_sets.select("set", "kind", F.col("note_id").alias("base_id")).distinct()
    sizes = ids.groupBy("set").agg(F.count("*").alias("ids_in_list"))
    rows = edited.join(ids, ["kind", "base_id"])
    keys = [gate, "set"]
    e = rows.groupBy(*keys).agg(F.count("*").alias("n"), n_of(answered()).alias("edited_answered"), n_of(correct()).alias("edited_correct"))
    side = clean.select(F.col("example_id"), F.col(gate), answered().alias("_a"), correct().alias("_o"))
    c = rows.select(*keys, F.col("base_id").alias("example_id")).distinct().join(side, ["example_id", gate]).groupBy(*keys).agg(
        ratio(n_of(F.col("_a")), F.count("*")).alias("clean_coverage"), ratio(n_of(F.col("_o")), n_of(F.col("_a"))).alias("clean_accuracy"))
    low_high = lambda k, n, name: {f"{name}": ratio(k, n), f"{name}_lo": wilson_low(k, n), f"{name}_hi": wilson_high(k, n)}
    return e.join(c, keys, "left").join(sizes, "set", "left").withColumns(
        low_high("edited_answered", "n", "edited_coverage") | low_high("edited_correct", "edited_answered", "edited_accuracy"))


# ---------------------------------------------------------------- runs over seeds

def label_set(example_id, tier, is_notice) -> Column:
    """Set of one input by id suffix, tier and notice flag."""
    e = F.col(example_id) if isinstance(example_id, str) else example_id
    return (F.when(e.endswith("_remove_evidence"), "remove_evidence")
            .when(e.endswith("_mask_temporal_cue"), F.when(F.coalesce(is_notice, F.lit(False)), "notice_appended").otherwise("mask_token"))
            .when(e.endswith("_silent_removal"), F.concat(F.lit("silent_"), F.coalesce(tier, F.lit("?"))))
            .when(e.endswith("_silent_keep"), "silent_keep").otherwise("clean"))


def notice_flag(variant, masked_cue) -> Column:
    """A mask control in which no cue was found, so that only a notice was appended."""
    return (variant == "mask_temporal_cue") & ~F.coalesce(masked_cue, F.lit(False))


def run_sets(variant: str = "variant", tier: str = "validity_tier", tier2: str = "tier2", masked: str = "masked_cue") -> Column:
    """All sets a row of a run counts in."""
    v, t, t2 = F.col(variant), F.col(tier), F.col(tier2)
    mask, removal = v == "mask_temporal_cue", v == "silent_removal"
    token = F.coalesce(F.col(masked), F.lit(False))
    member = {
        "clean": v == "clean", "marker": v.isin("remove_evidence", "mask_temporal_cue"), "remove_evidence": v == "remove_evidence",
        "mask_token": mask & token, "notice_appended": mask & ~token, "silent_strict": removal & (t == "strict"),
        "silent_both_strict": removal & (t == "strict") & (t2 == "strict"), "silent_implied": removal & (t == "implied_only"),
        "silent_all": removal, "silent_keep": v == "silent_keep"}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in member.items()]))


def run_metrics(runs: DataFrame, run_keys: list[str]) -> DataFrame:
    """Per run and set: coverage, abstention, accuracy, the paired clean figures and the AUROC."""
    work = runs.withColumn("score", F.coalesce("score", F.lit(-1.0)))
    rows = work.select("*", F.explode(run_sets()).alias("set"))
    keys = [*run_keys, "set"]
    n, a, c = F.count("*"), n_of(answered()), n_of(correct())
    own = rows.groupBy(*keys).agg(n.alias("n"), ratio(a, n).alias("coverage"), (1 - ratio(a, n)).alias("abstention"), ratio(c, a).alias("accuracy"))
    clean = work.where(F.col("variant") == "clean")
    side = clean.select(*run_keys, F.col("example_id").alias("base_id"), answered().alias("_a"), correct().alias("_o"))
    paired = rows.select(*keys, "base_id").distinct().join(side, [*run_keys, "base_id"]).groupBy(*keys).agg(
        F.avg(F.col("_a").cast("int")).alias("clean_cov_paired"), ratio(n_of(F.col("_o")), n_of(F.col("_a"))).alias("clean_acc_paired"))
    auc = ranking.auroc_against(clean, rows.where(F.col("set") != "clean"), run_keys, "set", "score").select(*keys, "auroc")
    return own.join(paired, keys, "left").join(auc, keys, "left")


def run_summary(metrics: DataFrame, group: list[str], seed: str = "seed") -> DataFrame:
    """Mean and sample standard deviation over seeds; one seed has no deviation."""
    values = ["n", "coverage", "abstention", "accuracy", "clean_cov_paired", "clean_acc_paired", "auroc"]
    aggs = [f(F.col(v)).alias(f"{v}_{s}") for v in values for s, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return metrics.groupBy(*group, "set").agg(*aggs, F.count_distinct(seed).alias("seeds"))


REPORT_COLUMNS = {
    "Clean cov.": ("clean", "coverage", True), "Clean acc.": ("clean", "accuracy", True),
    "Abst. marker": ("marker", "abstention", True), "Abst. strict": ("silent_strict", "abstention", True),
    "Abst. both-strict": ("silent_both_strict", "abstention", True), "Abst. implied": ("silent_implied", "abstention", True),
    "Abst. keep": ("silent_keep", "abstention", True), "Acc. strict": ("silent_strict", "accuracy", True),
    "AUROC marker": ("marker", "auroc", False), "AUROC strict": ("silent_strict", "auroc", False), "AUROC keep": ("silent_keep", "auroc", False),
}


def report_cells(summary: DataFrame, group: list[str], columns: dict = REPORT_COLUMNS) -> DataFrame:
    """One row per group with cells `mean ± sd`, `--` when missing."""
    def cell(name, metric, percent):
        pick = lambda s: F.max(F.when(F.col("set") == name, F.col(f"{metric}_{s}")))
        show = lambda x: F.format_string("%.1f" if percent else "%.3f", x * (100 if percent else 1))
        mean, sd = pick("mean"), pick("sd")
        return F.when(mean.isNull(), "--").otherwise(F.concat(show(mean), F.when(sd.isNull(), "").otherwise(F.concat(F.lit(" ± "), show(sd)))))
    return summary.groupBy(*group).agg(F.max("seeds").alias("Seeds"), *[cell(*spec).alias(title) for title, spec in columns.items()])


def rule_agreement(runs: DataFrame, run_keys: list[str]) -> DataFrame:
    """Agreement of a gate with "abstain when no day is mentioned" per run and set.

    `runs` has text, set and abstained.
    """
    work = runs.withColumns({"_nd": day_mentions("text") == 0, "_ng": ~has_digit("text")})
    gate, rule, bare = F.col("abstained"), F.col("_nd"), F.col("_ng")
    every = F.lit(True)
    return work.groupBy(*run_keys, "set").agg(
        F.count("*").alias("n"), rate(rule, every).alias("share_no_day"), rate(gate, every).alias("gate_abst"),
        rate(gate == rule, every).alias("agree_with_rule"), rate(gate, rule).alias("gate_abst_if_no_day"),
        rate(gate, ~rule).alias("gate_abst_if_day"), rate(bare, every).alias("share_no_digit"), rate(gate == bare, every).alias("agree_with_no_digit"))


def rule_agreement_means(per_run: DataFrame, group: list[str]) -> DataFrame:
    """Mean over seeds per group and set."""
    values = [c for c in per_run.columns if c not in (*group, "set", "seed")]
    return per_run.groupBy(*group, "set").agg(*[F.avg(v).alias(v) for v in values])


def rule_agreement_overall(per_run: DataFrame, group: list[str]) -> DataFrame:
    """Agreement weighted by set size."""
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    return per_run.groupBy(*group).agg(weighted("agree_with_rule").alias("agree_with_rule"), weighted("agree_with_no_digit").alias("agree_with_no_digit"))


# ---------------------------------------------------------------- spans, classes, checks

def score_spans(predictions: DataFrame, gold_spans: DataFrame) -> DataFrame:
    """Add overlap measures of cited and accepted gold spans; NULL where no gold span was accepted."""
    gold = accepted_spans(gold_spans).select(
        F.col("note_id").alias("example_id"), "text", "gold_evidence_span_v2", F.col("validity_tier").alias("span_tier"))
    out = predictions.drop("text").join(gold, "example_id", "left").withColumn(
        "_o", char_overlap("text", "predicted_evidence_span", "gold_evidence_span_v2"))
    frac = F.try_divide(F.col("_o.predicted_len").cast("double"), F.char_length("text"))
    return out.select("*", F.col("_o.recall").alias("recall"), F.col("_o.precision").alias("precision"), F.col("_o.f1").alias("f1"),
                      frac.alias("span_len_frac")).drop("_o")


def span_recall_report(scored: DataFrame) -> DataFrame:
    """Recall and precision over all scorable rows, over answered ones and by span tier, in long form."""
    groups = F.array_compact(F.array(
        F.lit("all"), F.when(answered(), F.lit("answered_only")), F.when(F.col("span_tier").isNotNull(), F.concat(F.lit("tier:"), F.col("span_tier")))))
    numbers = ["recall", "precision", "f1", "span_len_frac"]
    # The overlap of the texts is worked out once; from here on there are numbers alone.
    rows = cut_lineage(scored.where(F.col("gold_evidence_span_v2").isNotNull()).select(*numbers, F.explode(groups).alias("rows")))
    share = lambda c, col: ratio(n_of(c), F.count(col))
    out = rows.groupBy("rows").agg(
        F.count("*").alias("n_scorable"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
        F.avg("f1").alias("mean_f1"), share(F.col("recall") == 0, "recall").alias("frac_zero_recall"),
        share(F.col("recall") >= 0.999, "recall").alias("frac_full_recall"), F.avg("span_len_frac").alias("mean_span_len_frac"),
        share(F.col("span_len_frac") >= 0.8, "span_len_frac").alias("frac_span_over_80pct"))
    return out.join(ranking.exact_quantiles(rows, ["rows"], ["recall", "precision", "span_len_frac"], {"median": 0.5}), "rows", "left")


def extraction_metrics(results: DataFrame, by: str = "template") -> DataFrame:
    """Accuracy, abstention, evidence recall and coverage, with a flag when abstention depends on the template."""
    per = results.groupBy(by).agg(
        F.count("*").alias("n"), n_of(F.col("abstained")).alias("abst"), n_of(correct()).alias("ok"),
        *[f(F.when(answered(), F.col("recall"))).alias(f"{n}_recall") for n, f in (("s", F.sum), ("c", F.count))],
        F.sum("coverage").alias("s_cov"), F.count("coverage").alias("c_cov"))
    spread = F.max(F.col("abst") / F.col("n")) - F.min(F.col("abst") / F.col("n"))
    n, abst, ok = F.sum("n"), F.sum("abst"), F.sum("ok")
    return per.agg(
        n.alias("n"), (ok / F.greatest(F.lit(1), n - abst)).alias("accuracy_on_answered"), (abst / n).alias("abstain_rate"),
        F.coalesce(ratio(F.sum("s_recall"), F.sum("c_recall")), F.lit(0.0)).alias("mean_evidence_recall"),
        F.coalesce(ratio(F.sum("s_cov"), F.sum("c_cov")), F.lit(0.0)).alias("mean_coverage"),
        spread.alias("abstention_spread"), (spread > 0.5).alias("shortcut_flag"))


def decision_stability(run_a: DataFrame, run_b: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of inputs of the first run on which the second makes the same abstain decision."""
    keys = list(keys)
    b = run_b.select(*keys, "example_id", F.col("abstained").alias("_b"))
    same = F.coalesce(F.col("abstained") == F.col("_b"), F.lit(False))
    return run_a.join(b, [*keys, "example_id"], "left").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(same.cast("int")).alias("identical_decisions"))


def check_numbers(expected: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Status of every expected number: expected has section, quantity, printed, digits, pct."""
    keys = ["section", "quantity"]
    joined = expected.join(recomputed.select(*keys, F.col("value").cast("double").alias("value")), keys, "full_outer")
    status = F.when(F.col("printed").isNull(), "INFO").otherwise(printed_status("printed", "value", F.col("digits"), F.col("pct")))
    return joined.withColumn("status", status)


def class_confusion(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Answers by gold class; `answer` is NULL for abstentions."""
    return predictions.groupBy(*keys, "gold_relation", F.when(answered(), F.col("answer")).alias("answer")).agg(F.count("*").alias("n"))


def class_scores(predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys, "gold_relation").agg(
        F.count("*").alias("n"), rate(answered(), F.lit(True)).alias("coverage"), rate(correct(), answered()).alias("accuracy"))


def marker_totals(control: DataFrame) -> DataFrame:
    """Abstentions on marker controls, and the share on inputs that say in words that evidence is gone."""
    v = F.col("variant")
    worded = (v == "remove_evidence") | notice_flag(v, F.col("masked_cue"))
    marker = control.where(v.isin("remove_evidence", "mask_temporal_cue"))
    abst = F.col("abstained")
    return marker.groupBy("model").agg(
        F.count("*").alias("n"), n_of(abst).alias("n_abstained"), n_of(abst & worded).alias("n_abstained_worded"),
        rate(worded, abst).alias("worded_share"))


def corpus_stats(notes: DataFrame) -> DataFrame:
    """Notes with a relation and span, share of the largest class, located spans, median words, cues."""
    rel = notes.where(F.col("gold_relation").isNotNull() & F.col("gold_evidence_span").isNotNull()).select(
        "gold_relation", F.contains(F.col("text"), F.col("gold_evidence_span")).alias("_in"), word_count("text").alias("words"),
        find_cue("text").alias("_cue"))
    classes = rel.groupBy("gold_relation").agg(F.count("*").alias("_n"), n_of(F.col("_in")).alias("_in"), n_of(F.col("_cue").isNull()).alias("_no"))
    total = classes.agg(F.sum("_n").alias("n_relation_notes"), (F.max("_n") / F.sum("_n")).alias("majority_rate"),
                        F.sum("_in").alias("n_spans_in_text"), F.sum("_no").alias("n_without_cue"))
    return on_keys(total, ranking.exact_quantiles(rel, [], ["words"], {"median": 0.5}), [])


def relation_counts(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("gold_relation").isNotNull()).groupBy("gold_relation", "style").agg(F.count("*").alias("n"))


def notice_survival(tokens: DataFrame, max_len: int = 128) -> DataFrame:
    """Crosstab of how much of an appended notice is visible and whether the gate answered.

    `tokens` has n_clean, n_notice and abstained.
    """
    visible = tokens.withColumn("visibility", notice_visibility("n_clean", "n_notice", max_len))
    return visible.groupBy("visibility").agg(
        F.count("*").alias("n"), n_of(answered()).alias("n_answered"),
        F.avg(notice_visible_tokens("n_clean", "n_notice", max_len)).alias("mean_visible_tokens"))
