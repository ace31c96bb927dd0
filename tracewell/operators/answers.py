"""Answers from a compressed representation, and how they compare with the facts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.stats import ratio
from tracewell.operators import graph
from tracewell.operators.facts import active_state, query_subsets
from tracewell.operators.graph import KEY, Representation
from tracewell.session import cut_lineage

ENTRY = [*KEY, "value", "day", "approx_relation", "approx_anchor_day", "ord_group", "ord", "pos"]


def entries(rep: Representation) -> DataFrame:
    """Dated or approximated values a representation offers, one row each."""
    nodes = rep.nodes.where("kind IN ('state', 'mention')").withColumn("pos", F.lit(0))
    parts = [nodes] if rep.history is None else [nodes, rep.history]
    approx = {"approx_relation": "string", "approx_anchor_day": "int"}
    padded = [p.withColumns({c: F.lit(None).cast(t) for c, t in approx.items() if c not in p.columns}) for p in parts]
    out = padded[0].select(*ENTRY)
    for p in padded[1:]:
        out = out.unionByName(p.select(*ENTRY))
    return out


def query_active_value(offered: DataFrame, points: DataFrame, extra_keys: list[str] = ()) -> DataFrame:
    """Value of a concept as of a day, from entries alone: adds `answer` and `status`.

    Exact entries count from their day on. Approximate ones count from the anchor on when the true
    day is at or before it, and leave the question open on the ambiguous side. The latest candidate
    wins (the later listed one on equal days); without one the status is `abstain` when something
    is open, else `none`.

    Entries are reduced to one per day before the as-of window, so its partitions hold distinct days.
    """
    keys = [*extra_keys, *KEY]
    relation, anchor = F.col("approx_relation"), F.col("approx_anchor_day")
    exact = F.col("day").isNotNull()
    since = F.when(exact, F.col("day")).when(relation.isin("BEFORE", "OVERLAP"), anchor)
    candidates = (
        offered.withColumn("_since", since).where(F.col("_since").isNotNull())
        .groupBy(*keys, F.col("_since").alias("day"))
        .agg(F.max_by("value", F.struct("ord_group", "ord", "pos")).alias("value")))
    known = F.coalesce(relation.isin("BEFORE", "AFTER", "OVERLAP"), F.lit(False))
    opened = offered.where(~exact).groupBy(*keys).agg(
        F.max(F.when(relation == "BEFORE", anchor)).alias("_before"),
        F.min(F.when(relation == "AFTER", anchor)).alias("_after"),
        F.bool_or(anchor.isNull() | ~known).alias("_always"))
    timeline = candidates.select(*keys, "day", F.struct("day", "value").alias("_v"), F.lit(False).alias("_is_point")).unionByName(
        points.select(*keys, "day").withColumn("_is_point", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("day")
    asked = timeline.withColumn("_v", F.max("_v").over(so_far)).where("_is_point").drop("_is_point")
    still_open = F.coalesce(F.col("_before") > F.col("day"), F.lit(False)) | F.coalesce(
        F.col("_after") < F.col("day"), F.lit(False)) | F.coalesce("_always", F.lit(False))
    return asked.join(opened, keys, "left").select(
        *keys, "day", F.col("_v.value").alias("answer"),
        F.when(F.col("_v").isNotNull(), "value").when(still_open, "abstain").otherwise("none").alias("status"))


def compress(base: Representation, threshold: float, window: int) -> dict[str, Representation]:
    """The representations that are compared, by name."""
    aggregated = graph.aggregate_mentions(base)
    # States and chains feed several representations each; they are written once.
    aggregated = aggregated._replace(nodes=cut_lineage(aggregated.nodes))
    collapsed = graph.collapse_revisions(aggregated)
    collapsed = collapsed._replace(nodes=cut_lineage(collapsed.nodes), history=cut_lineage(collapsed.history))
    return {
        "uncompressed_baseline": base,
        "aggregation": aggregated,
        "revision_representation": collapsed,
        "temporal_approximation": graph.approximate_time(collapsed, threshold),
        "fixed_window_baseline": graph.fixed_window(base, window),
    }


def score_answers(reps: dict[str, Representation], facts: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """One row per representation and point: outcome and the subsets the point belongs to."""
    offered = None
    for name, rep in reps.items():
        part = entries(rep).withColumn("representation", F.lit(name))
        offered = part if offered is None else offered.unionByName(part)
    names = F.array(*[F.lit(n) for n in reps])
    asked = points.select("*", F.explode(names).alias("representation"))
    answers = query_active_value(offered, asked, ["representation"])
    truth = query_subsets(active_state(facts, points), facts, edges).withColumnRenamed("value", "truth")
    # Two missing values agree.
    outcome = (F.when(F.col("status") == "abstain", "abstain").when(F.col("answer").eqNullSafe(F.col("truth")), "correct")
               .when(F.col("answer").isNull(), "no_value").otherwise("wrong_value"))
    return answers.join(truth, [*KEY, "day"]).withColumn("outcome", outcome)


def evaluate_representations(reps: dict[str, Representation], facts: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """Outcome counts, coverage and accuracy per representation and subset of query points."""
    scored = score_answers(reps, facts, edges, points)
    subsets = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("revision_patient"), F.lit("revision_patients")),
        F.when(F.col("post_revision"), F.lit("post_revision"))))
    tally = scored.select("representation", "outcome", F.explode(subsets).alias("subset")).groupBy(
        "representation", "subset").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col("outcome") == o, F.lit(1))).alias(o) for o in ("correct", "wrong_value", "no_value", "abstain")])
    resolved = F.col("n") - F.col("abstain")
    return tally.withColumns({
        "coverage": resolved / F.greatest(F.lit(1), F.col("n")),
        "accuracy_on_resolved": F.col("correct") / F.greatest(F.lit(1), resolved)})


def representation_report(reps: dict[str, Representation], base: str = "uncompressed_baseline") -> DataFrame:
    """Size, bytes relative to the base and provenance recall per representation."""
    rows = None
    for name, rep in reps.items():
        row = graph.representation_size(rep).crossJoin(graph.provenance_recall(rep, reps[base])).withColumn(
            "representation", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    # One row for each representation; a join with the base's row would measure the base again.
    reference = F.max(F.when(F.col("representation") == base, F.col("bytes"))).over(Window.partitionBy())
    return rows.withColumn("_base_bytes", reference).withColumn("bytes_ratio", ratio("bytes", "_base_bytes")).drop("_base_bytes")


def reversibility_check(evaluation: DataFrame, report: DataFrame, limit: float = 0.999) -> DataFrame:
    """Exact operators whose accuracy or provenance recall falls below the limit."""
    exact = evaluation.where(F.col("subset") == "all").join(report, "representation").where(
        F.col("representation").isin("aggregation", "revision_representation"))
    return exact.where((F.col("accuracy_on_resolved") < limit) | (F.col("provenance_recall") < limit)).select(
        "representation", "accuracy_on_resolved", "provenance_recall")
