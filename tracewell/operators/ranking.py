"""Rank statistics over scores: AUROC, thresholds, risk-coverage curves, exact quantiles.

None of them sorts all rows in one place. Rows are reduced to distinct scores where possible and
cumulated in score blocks (`operators.running`).
"""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tracewell.functions.hashing import draw_key
from tracewell.functions.stats import ratio
from tracewell.operators.running import Along, drawn_blocks, on_keys, prefix_sums
from tracewell.session import cut_lineage

# Ship the Python code with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING = float("-inf")


def ranked_score(has_prediction: Column, score: Column) -> Column:
    """Score used for ranking; rows without a prediction or a score rank below all others."""
    return F.when(has_prediction & score.isNotNull(), score).otherwise(F.lit(MISSING))


def score_cells(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg"))


def auroc_of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """P(score of a positive > score of a negative), ties half; NULL when one side is empty. Scores of any scale."""
    ranked = prefix_sums(cells, keys, Along("score"), ["score"], {"neg_below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def auroc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    return auroc_of_cells(score_cells(df, keys, score, positive), keys)


def auroc_against(clean: DataFrame, control: DataFrame, run_keys: list[str], set_key: str, score: str) -> DataFrame:
    """AUROC of the clean rows of a run against each control set of the same run: n_pos, n_neg, auroc.

    Both sides are reduced to distinct scores and laid on one line per run. Running sums of the clean counts just
    before and just after a control score tell how many clean rows it loses against, so the clean side is not
    repeated per set.
    """
    count = lambda df, keys: df.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"))
    clean_cells = count(clean, run_keys).select(*run_keys, "score", F.lit(None).cast(control.schema[set_key].dataType).alias(set_key), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("n"), F.col("n").alias("_clean"))
    control_cells = count(control, [*run_keys, set_key]).select(*run_keys, "score", set_key, F.explode(F.array(F.lit(0), F.lit(2))).alias("_side"), "n", F.lit(0).cast("long").alias("_clean"))
    line = prefix_sums(clean_cells.unionByName(control_cells), run_keys, Along("score"), ["score", "_side", set_key], {"_below": F.col("_clean")}, totals=True)
    sets = line.where(F.col("_side") != 1).groupBy(*run_keys, set_key).agg(
        F.max("_below_total").alias("n_pos"), F.sum(F.when(F.col("_side") == 0, F.col("n"))).alias("n_neg"),
        (F.sum(F.col("n") * (F.col("_below_total") - F.col("_below"))) / 2).alias("_wins"))
    return sets.select(*run_keys, set_key, "n_pos", "n_neg", ratio("_wins", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def bootstrap_auroc(cells: DataFrame, keys: list[str], n_boot: int = 1000, seed: int = 7,
                    low: float = 0.025, high: float = 0.975, blocks: int = 1024) -> DataFrame:
    """Percentile interval of the AUROC over resampled positives and negatives.

    Every distinct score draws Poisson weights for all replicates inside its score block; a block
    hands on one row per replicate, and replicates are put together from block totals. Rows are
    never multiplied by the number of replicates.
    """
    schema = StructType([*[cells.schema[k] for k in keys], StructField("block", LongType()),
                         *[StructField(c, t) for c, t in (
                             ("replicate", LongType()), ("pos", DoubleType()), ("neg", DoubleType()), ("within", DoubleType()))]])
    names = list(keys)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        head = pdf.iloc[0]
        salt = [seed, int(head["block"]) & 0xFFFFFFFF, *[hash_text(str(head[k])) for k in names]]
        rng = np.random.default_rng(salt)
        out = {c: np.empty(n_boot) for c in ("pos", "neg", "within")}
        pos, neg = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
        for r in range(n_boot):
            p, q = rng.poisson(pos), rng.poisson(neg)
            below = np.cumsum(q) - q
            out["pos"][r], out["neg"][r] = p.sum(), q.sum()
            out["within"][r] = (p * (below + q / 2)).sum()
        frame = pd.DataFrame(out)
        frame.insert(0, "replicate", np.arange(n_boot))
        frame.insert(0, "block", int(head["block"]))
        for k in reversed(names):
            frame.insert(0, k, head[k])
        return frame

    blocked = drawn_blocks(cut_lineage(cells), list(keys), Along("score", blocks=blocks), "block").withColumn("block", F.col("block").cast("long"))
    drawn = blocked.groupBy(*names, "block").applyInPandas(draw, schema)
    before = Window.partitionBy(*names, "replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = drawn.withColumn("_below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    replicates = joined.groupBy(*names, "replicate").agg(
        ratio(F.sum(F.col("within") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg")).alias("auroc"))
    # n_boot values per key, so an exact percentile is bounded.
    return replicates.groupBy(*names).agg(
        F.percentile("auroc", F.lit(low)).alias("auroc_lo"), F.percentile("auroc", F.lit(high)).alias("auroc_hi"))


def hash_text(text: str) -> int:
    import zlib
    return zlib.crc32(text.encode())


def threshold_for_coverage(df: DataFrame, keys: list[str], score: str, target: float) -> DataFrame:
    """Score whose coverage (share of rows at or above it) is closest to the target.

    Equal gaps (to 1e-12) keep the smallest score. Rows without a score, or with one that is no
    number, rank below all others; only finite scores are candidates.
    """
    cells = df.groupBy(*keys, F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias("score")).agg(F.count("*").alias("_n"))
    ranked = prefix_sums(cells, keys, Along("score"), ["score"], {"_below": F.col("_n")}, totals=True)
    coverage = (F.col("_below_total") - F.col("_below")) / F.col("_below_total")
    gap = F.round(F.abs(coverage - F.lit(target)), 12)
    finite = ranked.where((F.col("score") > MISSING) & (F.col("score") < float("inf")))
    return finite.groupBy(*keys).agg(F.min_by(
        F.struct(F.col("score").alias("threshold"), coverage.alias("coverage")), F.struct(gap, F.col("score"))).alias("_b")
    ).select(*keys, "_b.*")


def aurc_rank(df: DataFrame, keys: list[str], score: str, correct: Column, id_cols: list[str], seed: int = 0) -> DataFrame:
    """Mean cumulative risk in descending score order; equal scores are ordered by a seeded digest."""
    rows = df.select(*keys, *[c for c in id_cols if c not in keys],
                     F.coalesce(F.col(score), F.lit(MISSING)).alias("score"),
                     (1 - correct.cast("int")).alias("_err")).withColumn("_tie", draw_key(seed, *id_cols))
    cells = rows.groupBy(*keys, "score").agg(F.count("*").alias("_n"), F.sum("_err").alias("_e"))
    above = prefix_sums(cells, keys, Along("score", descending=True), [F.col("score").desc()],
                        {"_n_above": F.col("_n"), "_e_above": F.col("_e")}).select(*keys, "score", "_n_above", "_e_above")
    # Many rows may share one score: they are cut by the leading digits of the digest.
    inside = prefix_sums(rows, [*keys, "score"], F.substring("_tie", 1, 3), ["_tie"],
                         {"_n_in": F.lit(1), "_e_in": F.col("_err")}, inclusive=True)
    risk = (F.col("_e_above") + F.col("_e_in")) / (F.col("_n_above") + F.col("_n_in"))
    return inside.join(above, [*keys, "score"]).groupBy(*keys).agg(F.avg(risk).alias("aurc"))


def risk_coverage_curve(df: DataFrame, keys: list[str], score: str, answered: Column, correct: Column, grid: int = 101) -> DataFrame:
    """Answered rows, coverage, selective accuracy and risk at evenly spaced thresholds in [0, 1].

    Each row is counted once, at the highest threshold it reaches; the table per key has at most
    `grid` rows before it is cumulated.
    """
    step = 1.0 / (grid - 1)
    near = F.floor(F.col(score) / step).cast("int")
    # Correct the division by one step, so that thresholds compare exactly as i * step.
    index = (F.when((near + 1) * F.lit(step) <= F.col(score), near + 1)
             .when(near * F.lit(step) > F.col(score), near - 1).otherwise(near))
    index = F.when(F.col(score).isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(-1), F.least(F.lit(grid - 1), index)))
    tallied = df.groupBy(*keys, index.alias("_i")).agg(
        F.count("*").alias("_all"), F.sum(answered.cast("int")).alias("_ans"), F.sum(correct.cast("int")).alias("_ok"))
    totals = tallied.groupBy(*keys).agg(F.sum("_all").alias("n_total"))
    full = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i")).join(
        tallied, [*keys, "_i"], "left")
    above = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_i").desc())
    upto = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(above)
    out = full.select(*keys, "n_total", (F.col("_i") * F.lit(step)).alias("threshold"),
                      upto("_ans").alias("n_answered"), upto("_ok").alias("_correct"))
    return out.select(*keys, "threshold", "n_answered", ratio("n_answered", "n_total").alias("coverage"),
                      ratio("_correct", "n_answered").alias("selective_accuracy"),
                      (1 - ratio("_correct", "n_answered")).alias("selective_risk"))


def aurc_trapezoid(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under risk over coverage; NULL with fewer than two points."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("coverage", F.col("threshold").desc())
    step = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("selective_risk") + F.lag("selective_risk").over(w)) / 2
    valid = curve.where(F.col("coverage").isNotNull() & F.col("selective_risk").isNotNull())
    return valid.withColumn("_a", step).groupBy(*keys).agg(F.sum("_a").alias("aurc"))


def choose_threshold(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Threshold with the lowest risk among those reaching the target coverage.

    If none does, the one of the highest coverage (smallest threshold on a tie) with a status
    saying so.
    """
    valid = curve.where(F.col("coverage").isNotNull() & F.col("selective_risk").isNotNull())
    eligible = F.col("coverage") >= target
    best = F.min(F.when(eligible, F.struct("selective_risk", "threshold")))
    widest = F.max(F.struct(F.col("coverage"), (-F.col("threshold")).alias("_neg")))
    out = valid.groupBy(*keys).agg(best.alias("_b"), widest.alias("_w"))
    return out.select(
        *keys, F.coalesce(F.col("_b.threshold"), -F.col("_w._neg")).alias("threshold"),
        F.when(F.col("_b").isNotNull(), "dev_min_risk_at_target_coverage")
        .otherwise("target_unattainable_maximum_coverage_used").alias("status"),
        F.lit(float(target)).alias("requested_coverage"), F.col("_w.coverage").alias("maximum_available_coverage"))


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], q: dict[str, float], max_rounds: int = 64) -> DataFrame:
    """Linearly interpolated quantiles of several columns at once: the keys and `<name>_<column>` for every share in `q`.

    Selection by histograms: the values that are still open are cut at their approximate quantiles and
    counted by cell, a cell that holds a wanted rank stays open, and the next round looks inside it.
    A round divides the open values of every key and column by about the number of cells, so two or
    three rounds do for any number of rows, and no value list is sorted. NULL and NaN values do
    not count; keys without values are left out.
    """
    own = [*keys, "_column"]
    columns = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in values])).alias("_c")
    open_ = cut_lineage(df.select(*keys, columns).select(*keys, "_c.*").where(F.col("_value").isNotNull() & ~F.isnan("_value")))
    rank = lambda share: F.lit(float(share)) * (F.col("_n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(s)), F.ceil(rank(s))) for s in q.values()])))
    totals = cut_lineage(open_.groupBy(*own).agg(F.count("_value").alias("_n")).select("*", F.transform(wanted, lambda r: r.cast("long")).alias("_ranks")))
    # Open cells: key and column, place of the cell, its first rank and the wanted ranks inside.
    open_ = open_.withColumn("_cell", F.lit(0))
    inside = totals.select(*own, F.lit(0).alias("_cell"), F.lit(0).cast("long").alias("_first"), "_ranks")
    found = None
    for _ in range(max_rounds):
        counted = drawn_blocks(open_, [*own, "_cell"], Along("_value", blocks=256), "_block")
        cells = counted.groupBy(*own, "_cell", "_block").agg(F.count("_value").alias("_rows"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        before = Window.partitionBy(*own, "_cell").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        cells = on_keys(cells, inside, [*own, "_cell"]).withColumn("_from", F.col("_first") + F.col("_before"))
        held = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_rows")))
        hit = cut_lineage(cells.withColumn("_held", held).where(F.size("_held") > 0))
        done = hit.where("_low = _high").select(*own, F.explode("_held").alias("_rank"), F.col("_low").alias("_value"))
        found = done if found is None else found.unionByName(done)
        left = hit.where("_low < _high")
        if left.isEmpty():
            break
        number = F.dense_rank().over(Window.partitionBy(*own).orderBy("_cell", "_block"))
        left = cut_lineage(left.select(*own, "_low", "_high", F.col("_from").alias("_first"), F.col("_held").alias("_ranks"), number.alias("_next")))
        spans = left.groupBy(*own).agg(F.collect_list(F.struct("_low", "_high", "_next")).alias("_spans"))
        at = F.get(F.filter("_spans", lambda s: (s["_low"] <= F.col("_value")) & (F.col("_value") <= s["_high"])), F.lit(0))["_next"]
        open_ = on_keys(open_.drop("_cell"), spans, own).withColumn("_cell", at).drop("_spans").where(F.col("_cell").isNotNull())
        inside = left.select(*own, F.col("_next").alias("_cell"), "_first", "_ranks")
    else:
        raise RuntimeError(f"quantiles not found in {max_rounds} rounds")
    ranks = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    ends = on_keys(totals.drop("_ranks"), ranks, own)
    pick = lambda r: F.element_at("_at", r.cast("long"))
    picks = [(pick(F.floor(rank(s))) + (rank(s) - F.floor(rank(s))) * (pick(F.ceil(rank(s))) - pick(F.floor(rank(s))))).alias(n) for n, s in q.items()]
    each = ends.select(*own, *picks)
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == c, F.col(n))).alias(f"{n}_{c}") for c in values for n in q])


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sizes: np.ndarray) -> np.ndarray:
    """Good ones among `sizes` drawn without replacement; for counts of any size.

    Ratio of uniforms over the logarithm of the probability: a box around the hat of the law is hit
    until the point lies below it. The box has half-width 1.716 sd + 0.899, which covers every
    hypergeometric law.
    """
    log_factorial = np.vectorize(lambda x: math.lgamma(x + 1.0), otypes=[float])

    def log_weight(k, size):
        return -(log_factorial(k) + log_factorial(good - k) + log_factorial(size - k) + log_factorial(bad - size + k))

    low, high = np.maximum(0, sizes - bad), np.minimum(good, sizes)
    out, open_ = low.astype(np.int64), np.flatnonzero(low < high)
    share = good / max(1, good + bad)
    while len(open_):
        size, lo, hi = sizes[open_].astype(float), low[open_], high[open_]
        spread = np.sqrt(size * share * (1 - share) * (good + bad - size) / max(1, good + bad - 1) + 0.5)
        mode = np.clip(np.floor((size + 1) * (good + 1) / (good + bad + 2)), lo, hi)
        u, v = 1 - rng.random(len(open_)), rng.random(len(open_))
        k = np.floor(size * share + 0.5 + (1.7155277699214135 * spread + 0.8989161620588988) * (v - 0.5) / u)
        inside = (k >= lo) & (k <= hi)
        k = np.clip(k, lo, hi)
        taken = inside & (2 * np.log(u) <= log_weight(k, size) - log_weight(mode, size))
        out[open_[taken]] = k[taken].astype(np.int64)
        open_ = open_[~taken]
    return out


def random_matched_coverage(df: DataFrame, keys: list[str], answered: Column, correct: Column, target: float,
                            repeats: int = 1000, seed: int = 7) -> DataFrame:
    """Accuracy of random subsets of the target size.

    A random subset only matters through how many correct, wrong and unanswered rows it holds, and
    these follow a multivariate hypergeometric law. So repeats are drawn from three counts per key.
    """
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.sum(answered.cast("int")).alias("_ans"), F.sum((answered & correct).cast("int")).alias("_ok"))
    schema = StructType([*[counts.schema[k] for k in keys], StructField("n_selected", LongType()),
                         StructField("mean_accuracy", DoubleType()), StructField("accuracy_lo", DoubleType()),
                         StructField("accuracy_hi", DoubleType()), StructField("mean_answered", DoubleType())])
    names = list(keys)

    def draw(frames):
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                n, ans, ok = int(row["n_total"]), int(row["_ans"]), int(row["_ok"])
                size = min(max(1, round(target * n)), n)
                rng = np.random.default_rng([seed, *[hash_text(str(row[k])) for k in names]])
                total = draw_hypergeometric(rng, ans, n - ans, np.full(repeats, size))
                right = draw_hypergeometric(rng, ok, ans - ok, total)
                acc = np.where(total > 0, right / np.maximum(total, 1), 0.0)
                rows.append({**{k: row[k] for k in names}, "n_selected": size, "mean_accuracy": acc.mean(),
                             "accuracy_lo": np.percentile(acc, 2.5), "accuracy_hi": np.percentile(acc, 97.5),
                             "mean_answered": total.mean()})
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return counts.mapInPandas(draw, schema)
