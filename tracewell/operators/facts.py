"""Facts that are revised over time: which one holds at a given day."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.hashing import draw_index, draw_key

KEY = ["patient_id", "concept_type"]


def revision_edges(facts: DataFrame) -> DataFrame:
    """Edge table of the `revises` pointers, from the old to the new fact."""
    return facts.where(F.col("revises").isNotNull()).select(
        "patient_id", F.col("revises").alias("from_fact_id"), F.col("fact_id").alias("to_fact_id"),
        F.lit("revises").alias("relation"), "day")


def revision_fraction(facts: DataFrame) -> DataFrame:
    """Share of patients with at least one revised fact."""
    per_patient = facts.groupBy("patient_id").agg(F.bool_or(F.col("revises").isNotNull()).alias("revised"))
    return per_patient.agg(F.avg(F.col("revised").cast("int")).alias("revision_fraction"),
                           F.count("*").alias("n_patients"))


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def aligned_blocks(start: Column, end: Column, bits: int) -> Column:
    """Smallest set of aligned power-of-two blocks that tile [start, end). Levels whose blocks are longer than the range have none."""
    def level(i):
        unit = _power(i)
        low = F.call_function("shiftright", start + unit - 1, i)      # blocks of this size start here
        high = F.call_function("shiftright", end, i)
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), low)
        low_after = F.when(left.isNotNull(), low + 1).otherwise(low)
        right = F.when((low_after < high) & (F.pmod(high, F.lit(2)) == 1), high - 1)
        # A range aligned at both ends of the top level is closed off there.
        return F.filter(
            F.array(F.struct(i.alias("level"), left.alias("block")), F.struct(i.alias("level"), right.alias("block"))),
            lambda b: b["block"].isNotNull())
    longest = F.coalesce(F.length(F.bin(F.greatest(end - start, F.lit(1)))) - 1, F.lit(bits))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.least(longest, F.lit(bits))), level))


#: Any INT day, moved to 0 and up, lies below 2**DAY_BITS.
DAY_BITS = 32


def active_state(facts: DataFrame, points: DataFrame) -> DataFrame:
    """Active fact per query point: `fact_id` and `value`, NULL when none is active.

    A fact is active from its day until the first day on which a fact revising it is known; among
    the active facts of a concept the one with the highest `ord` counts. `points` holds distinct
    patient_id, concept_type, day; any INT day will do.

    No pair of fact and point is formed beyond the answers. Facts never revised are reduced to one
    row per day and carried forward by a window over days. Revised facts hold for a closed interval;
    intervals are cut into aligned blocks, reduced to one row per block. A point looks up the blocks
    that contain it on those levels that its key has blocks on; keys without revised facts have none.
    """
    offset = 1 << (DAY_BITS - 1)
    revisers = (facts.where(F.col("revises").isNotNull())
                .groupBy(F.col("revises").alias("fact_id")).agg(F.min("day").alias("_until")))
    known = facts.select(*KEY, "day", "fact_id", F.struct("ord", "fact_id", "value").alias("_f"))
    dated = known.join(revisers, "fact_id", "left")

    lasting = dated.where(F.col("_until").isNull()).groupBy(*KEY, "day").agg(F.max("_f").alias("_f"))
    timeline = lasting.withColumn("_is_point", F.lit(False)).unionByName(
        points.select(*KEY, "day").withColumn("_is_point", F.lit(True)), allowMissingColumns=True)
    # One row per distinct day and key on either side, so the window stays small for any key.
    so_far = Window.partitionBy(*KEY).orderBy("day")
    carried = timeline.withColumn("_f", F.max("_f").over(so_far)).where("_is_point").drop("_is_point")

    closed = dated.where(F.col("_until") > F.col("day"))
    start, end = F.col("day").cast("long") + offset, F.col("_until").cast("long") + offset
    nodes = (
        closed.groupBy(*KEY, "day", "_until").agg(F.max("_f").alias("_f"))
        .select(*KEY, "_f", F.explode(aligned_blocks(start, end, DAY_BITS)).alias("_b"))
        .groupBy(*KEY, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
        .agg(F.max("_f").alias("_f"))
    )
    levels = nodes.select(*KEY, "_level").distinct()
    probes = points.select(*KEY, "day").join(levels, KEY).withColumn(
        "_block", F.floor((F.col("day").cast("long") + offset) / _power(F.col("_level"))))
    stabbed = probes.join(nodes, KEY + ["_level", "_block"]).select(*KEY, "day", "_f")

    best = carried.unionByName(stabbed).groupBy(*KEY, "day").agg(F.max("_f").alias("_f"))
    return best.select(*KEY, "day", F.col("_f.fact_id").alias("fact_id"), F.col("_f.value").alias("value"))


def active_state_counts(facts: DataFrame, points: DataFrame) -> DataFrame:
    """Per concept: query points, points with an active fact, distinct active facts."""
    return active_state(facts, points).groupBy("concept_type").agg(
        F.count("*").alias("n_points"), F.count("fact_id").alias("n_active"),
        F.count_distinct("fact_id").alias("n_facts"))


def sample_query_points(facts: DataFrame, concepts: list[str], n: int, seed: int, slack: int = 3) -> DataFrame:
    """At most n distinct days per patient and concept, drawn from the patient's days plus some slack."""
    span = facts.groupBy("patient_id").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    drawn = span.select(
        "patient_id", "_lo", "_hi",
        F.explode(F.array(*[F.lit(c) for c in concepts])).alias("concept_type")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i"))
    key = draw_key(seed, "patient_id", "concept_type", "_i")
    return drawn.select(
        *KEY, (F.col("_lo") + draw_index(key, F.col("_hi") + slack - F.col("_lo") + 1)).alias("day")).distinct()


def query_subsets(points: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Flag the points of patients with a revision and the points after one of their concept."""
    patients = edges.select("patient_id").distinct().withColumn("revision_patient", F.lit(True))
    concepts = facts.select(F.col("fact_id").alias("to_fact_id"), "concept_type")
    first = (edges.join(concepts, "to_fact_id").groupBy(*KEY).agg(F.min("day").alias("_first_revision")))
    return (
        points.join(patients, "patient_id", "left").join(first, KEY, "left")
        .withColumns({
            "revision_patient": F.coalesce("revision_patient", F.lit(False)),
            "post_revision": F.coalesce(F.col("_first_revision") <= F.col("day"), F.lit(False)),
        }).drop("_first_revision")
    )
