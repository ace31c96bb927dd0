"""Judged notes: effective verdicts, tiers, agreement between judges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import norm_relation, norm_tier, norm_ws, strip
from tracewell.functions.stats import ratio


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def effective_verdict(verdict, relation, evidence, text) -> Column:
    """Struct(verdict, relation, evidence_ok): a determination without verbatim evidence is unsupported."""
    v = F.lower(strip(_c(verdict).cast("string")))
    raw = F.when(v.isin("explicit", "implied", "none"), v).otherwise(F.lit("parse_error"))
    rel = norm_relation(relation)
    quote = F.when(~_c(evidence).isin("null", ""), _c(evidence))
    # An evidence of blanks normalises to '' and is contained in every text.
    ok = F.coalesce(F.contains(F.lower(norm_ws(text)), F.lower(norm_ws(quote))) & quote.isNotNull(), F.lit(False))
    determined = raw.isin("explicit", "implied")
    supported = rel.isNotNull() & ok
    return F.struct(
        F.when(determined & ~supported, "unsupported").otherwise(raw).alias("verdict"),
        F.when((determined & supported) | (raw == "parse_error"), rel).alias("relation"), ok.alias("evidence_ok"))


def judge_tier(verdict, relation) -> Column:
    """Tier of a judged removal; `missing` without a usable judgment."""
    v = _c(verdict)
    return (F.when(v.isNull() | v.isin("parse_error", "unsupported"), "missing")
            .when((v == "none") | _c(relation).isNull(), "strict")
            .when(v == "implied", "implied_only").otherwise("rejected"))


def rejudge_tier(determinable) -> Column:
    d = _c(determinable)
    return F.when(d.isNull(), "judge_error").when(d, "implied_only").otherwise("strict")


def cohen_kappa(pairs: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """n, percent agreement and kappa of two ratings; kappa is NULL when chance agreement is 1."""
    keys = list(keys)
    cells = pairs.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    side = lambda c, name: cells.groupBy(*keys, F.col(c).alias("_cat")).agg(F.sum("_n").alias(name))
    expected = side("_a", "_na").join(side("_b", "_nb"), [*keys, "_cat"]).groupBy(*keys).agg(
        F.sum(F.col("_na") * F.col("_nb")).alias("_chance"))
    observed = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("n_agree"))
    joined = observed.join(expected, keys, "left") if keys else observed.crossJoin(expected)
    po, pe = F.col("n_agree") / F.col("n"), F.coalesce("_chance", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return joined.select(*keys, "n", "n_agree", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def tier_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of tiers with margins (`All`)."""
    named = df.select(F.col(a).alias(a), F.col(b).alias(b)).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return named.cube(a, b).agg(F.count("*").alias("n")).withColumns(
        {c: F.coalesce(F.col(c), F.lit("All")) for c in (a, b)})


def judged_sets(notes: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row per note with its normalised tiers, `clean_ok` and the names of the sets it belongs to.

    `notes`: note_id, gold, orig_tier, rerun_tier. `judgments`: note_id, condition, verdict,
    relation; one per note and condition.
    """
    per_note = judgments.groupBy("note_id").agg(*[
        F.max(F.when(F.col("condition") == c, F.struct(F.lit(True).alias("seen"), "verdict", "relation"))).alias(f"_{c}")
        for c in ("clean", "silent_removal", "silent_keep")])
    gold = norm_relation("gold")
    removal_seen = F.col("_silent_removal.seen").isNotNull()
    clean_ok = F.col("_clean.seen").isNotNull() & F.col("_clean.relation").eqNullSafe(gold)
    out = notes.join(per_note, "note_id", "left").withColumns({
        "clean_judged": F.col("_clean.seen").isNotNull(), "clean_ok": clean_ok,
        "orig": norm_tier("orig_tier"),
        "judge": F.when(removal_seen, judge_tier("_silent_removal.verdict", "_silent_removal.relation")),
        "rerun": F.when(F.col("rerun_tier").isNotNull() & (F.col("rerun_tier") != ""), norm_tier("rerun_tier")),
    })
    ok, judge, orig = F.col("clean_ok"), F.coalesce(F.col("judge"), F.lit("")), F.col("orig")
    keep = F.col("_silent_keep.seen").isNotNull() & F.col("_silent_keep.relation").eqNullSafe(gold)
    member = {
        "prefilter_clean_ok": ok,
        "removal_strict": ok & (judge == "strict"),
        "removal_strict_both_judges": ok & (judge == "strict") & (orig == "strict"),
        "removal_implied": ok & (judge == "implied_only"),
        "removal_implied_both_judges": ok & (judge == "implied_only") & (orig == "implied_only"),
        "removal_all": ok & judge.isin("strict", "implied_only"),
        "keep_valid": ok & keep,
    }
    sets = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in member.items()]))
    return out.withColumn("sets", sets).drop("_clean", "_silent_removal", "_silent_keep")


def set_members(judged: DataFrame) -> DataFrame:
    """Long table of id sets."""
    return judged.select(F.explode("sets").alias("set"), "note_id")


def judge_agreement(judged: DataFrame) -> DataFrame:
    """Agreement and kappa of the original tier, the judge and the re-run, where both assign a tier."""
    tiers, judged_tiers = ["strict", "implied_only"], ["strict", "implied_only", "rejected"]
    orig_ok = F.col("orig").isin(tiers)
    judge_ok, rerun_ok = F.coalesce(F.col("judge").isin(judged_tiers), F.lit(False)), F.col("rerun").isNotNull()
    pairs = F.array_compact(F.array(
        F.when(orig_ok & judge_ok, F.struct(F.lit("original_vs_judge").alias("pair"), F.col("orig").alias("a"), F.col("judge").alias("b"))),
        F.when(orig_ok & rerun_ok, F.struct(F.lit("original_vs_rerun").alias("pair"), F.col("orig").alias("a"), F.col("rerun").alias("b"))),
        F.when(orig_ok & rerun_ok & judge_ok, F.struct(F.lit("rerun_vs_judge").alias("pair"), F.col("rerun").alias("a"), F.col("judge").alias("b")))))
    return cohen_kappa(judged.select(F.explode(pairs).alias("_p")).select("_p.*"), "a", "b", ["pair"])


def judge_confusion(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("judge").isNotNull()).groupBy(F.col("orig"), F.col("judge")).agg(F.count("*").alias("n"))


def judge_report(judged: DataFrame) -> DataFrame:
    """Sizes of the id sets and of the judged and recovered clean notes, as (name, n)."""
    sizes = set_members(judged).groupBy(F.col("set").alias("name")).agg(F.count("*").alias("n"))
    flags = judged.agg(F.count(F.when(F.col("clean_judged"), 1)).alias("clean_notes_judged"),
                       F.count(F.when(F.col("clean_judged") & F.col("clean_ok"), 1)).alias("clean_recovered"))
    return sizes.unionByName(flags.unpivot([], ["clean_notes_judged", "clean_recovered"], "name", "n"))


def span_entailment_rate(judged_spans: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of judged spans whose relation is the gold one."""
    hit = norm_relation("relation").eqNullSafe(norm_relation("gold")).cast("int")
    return judged_spans.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit).alias("n_entailed"),
                                           ratio(F.sum(hit), F.count("*")).alias("entailment_rate"))
