"""Append-only store of relations between events, with transaction order and validity in time.

`edges`: edge_key, seq (insertion order), source_id, target_id, relation_type, valid_from, site_id,
model_id, coverage, ... `closures`: edge_key, close_seq, valid_to; closing never deletes a row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.stats import ratio
from tracewell.operators.running import Along, on_keys, prefix_sums, reached
from tracewell.session import cut_lineage

PAIR = ["source_id", "target_id"]

#: Asked moments in a slice of a pair's time, on average, and the fewest and most slices that a pair is cut into. The most is a power of two.
SLICE = 512
SLICES = (5, 4096)


def node_id(note, label, scale):
    """Same note, label and scale give the same node."""
    return F.sha2(F.concat_ws("|", note.cast("string"), label, scale), 256)


def resolve_event_nodes(mentions: DataFrame) -> DataFrame:
    """One node per (note_id, label, scale); the first creation wins."""
    keys = ["note_id", "label", "scale"]
    first = mentions.groupBy(*keys).agg(
        F.min(F.struct("created_at", "site_id")).alias("_f"), F.count("*").alias("n_mentions"))
    return first.select(node_id(*[F.col(k) for k in keys]).alias("node_id"), *keys, "_f.created_at", "_f.site_id", "n_mentions")


def supersede(edges: DataFrame, closures: DataFrame) -> DataFrame:
    """Add `valid_to` (the last closure overwrites) and `end_seq` (the first one ends the active time)."""
    per_edge = closures.groupBy("edge_key").agg(
        F.max_by("valid_to", "close_seq").alias("valid_to"), F.min("close_seq").alias("end_seq"))
    return edges.join(per_edge, "edge_key", "left")


def append_relations(edges: DataFrame, block_bits: int = 16) -> DataFrame:
    """Add how many active edges of the pair an edge contradicts when it is inserted
    (`n_contradicts`) and how many later edges contradict it while it is active (`n_contradicted_by`).

    `edges` carries end_seq from `supersede`. A pair of edges contradicts when both relate the same
    two events by different relation types. Counts come from running sums over the log of inserts
    and closures, so the work is linear however many versions one pair has; sequence numbers are
    unique, which bounds a block to 2 ** block_bits inserts.

    The log is written and shuffled once, by pair and block: sums over all types and over the edge's
    own type start from the same totals by pair, block and type.
    """
    opened = edges.select(*PAIR, "relation_type", "edge_key", F.col("seq").alias("_at"), F.lit(1).alias("_open"))
    closed = edges.where(F.col("end_seq").isNotNull()).select(
        *PAIR, "relation_type", "edge_key", F.col("end_seq").alias("_at"), F.lit(0).alias("_open"))
    log = opened.unionByName(closed).withColumn("_block", F.shiftright("_at", block_bits))
    log = cut_lineage(log.repartition(*PAIR, "_block"))
    sums = {"ins": F.col("_open"), "act": 2 * F.col("_open") - 1}
    totals = log.groupBy(*PAIR, "_block", "relation_type").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*PAIR).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    of_type = Window.partitionBy(*PAIR, "relation_type")
    earlier_of_type = of_type.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    other = lambda every, same: F.coalesce(every, F.lit(0)) - F.coalesce(same, F.lit(0))
    offsets = totals.select(
        *PAIR, "_block", "relation_type", *[other(F.sum(n).over(earlier), F.sum(n).over(earlier_of_type)).alias(f"_before_{n}") for n in sums],
        other(F.sum("ins").over(Window.partitionBy(*PAIR)), F.sum("ins").over(of_type)).alias("_in_all"))
    inside = Window.partitionBy(*PAIR, "_block").orderBy("_at", "_open", "edge_key").rowsBetween(Window.unboundedPreceding, -1)
    inside_of_type = Window.partitionBy(*PAIR, "_block", "relation_type").orderBy("_at", "_open", "edge_key").rowsBetween(Window.unboundedPreceding, -1)
    log = on_keys(log, offsets, [*PAIR, "_block", "relation_type"]).withColumns(
        {n: F.col(f"_before_{n}") + other(F.sum(c).over(inside), F.sum(c).over(inside_of_type)) for n, c in sums.items()})
    at_open = lambda c: F.max(F.when(F.col("_open") == 1, F.col(c)))
    until_close = F.max(F.when(F.col("_open") == 0, F.col("ins")))
    counts = log.groupBy("edge_key").agg(
        at_open("act").alias("n_contradicts"),
        (F.coalesce(until_close, F.max("_in_all")) - at_open("ins")).alias("n_contradicted_by"))
    return edges.join(counts, "edge_key")


def contradiction_links(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges that the asked edges (edge_key) contradict: edge_key, contradicts.

    The list of one edge is as long as the pair's history, so it is produced for asked edges only.
    """
    mine = edges.join(asked.select("edge_key"), "edge_key", "left_semi").select(
        *PAIR, F.col("edge_key"), F.col("seq").alias("_seq"), F.col("relation_type").alias("_type"))
    theirs = edges.select(*PAIR, F.col("edge_key").alias("contradicts"), "seq", "end_seq", "relation_type")
    return mine.join(theirs, PAIR).where(
        (F.col("seq") < F.col("_seq")) & (F.col("end_seq").isNull() | (F.col("end_seq") > F.col("_seq")))
        & (F.col("relation_type") != F.col("_type"))).select("edge_key", "contradicts")


def active_relations(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("valid_to").isNull())


def audit_trail(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """All versions of the asked pairs; `seq` gives insertion order."""
    return edges.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")


def relations_as_of(edges: DataFrame, at) -> DataFrame:
    """Edges valid at a moment: valid_from <= at < valid_to."""
    at = F.lit(at)
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def relation_counts_as_of(edges: DataFrame, moments: list) -> DataFrame:
    """Valid edges by relation type at each of a few moments, in one pass over the edges."""
    at = F.explode(F.array(*[F.lit(m) for m in moments])).alias("moment")
    valid = edges.select("relation_type", "valid_from", "valid_to", at).where(
        (F.col("valid_from") <= F.col("moment")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("moment"))))
    return valid.groupBy("moment", "relation_type").agg(F.count("*").alias("n"))


def relation_counts_at(edges: DataFrame, moments: DataFrame) -> DataFrame:
    """Valid edges by relation type at every moment of a table (column `moment`): moment, relation_type, n.

    A sweep: an edge counts 1 from its start and is taken off at its end; starts and ends are reduced
    to distinct times, moments are put between them, and running sums over blocks of time give the
    number at each moment. No edge meets a moment. Types without a valid edge at a moment have no row there.
    """
    own = edges.where(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    steps = own.select("relation_type", F.explode(F.array(
        F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("valid_to").alias("at"), F.lit(-1).alias("step")))).alias("_s"))
    steps = steps.select("relation_type", "_s.*").where(F.col("at").isNotNull()).groupBy("relation_type", "at").agg(F.sum("step").alias("step"))
    # One row with the vocabulary of relation types.
    types = edges.agg(F.collect_set("relation_type").alias("_types"))
    asked = moments.select(F.col("moment").alias("at")).where(F.col("at").isNotNull()).distinct()
    asked = on_keys(asked, types, []).select(F.explode("_types").alias("relation_type"), "at", F.lit(0).cast("long").alias("step"))
    line = steps.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)))
    # At one time the steps come before the question: an edge that starts then counts, one that ends then does not.
    swept = prefix_sums(line, ["relation_type"], Along("at"), ["at", "_asked"], {"n": F.col("step")})
    return swept.where(F.col("_asked") & (F.col("n") > 0)).select(F.col("at").alias("moment"), "relation_type", "n")


def _micros(df: DataFrame, column: str) -> Column:
    """A time in microseconds. Times without a zone are taken as they stand."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        since = f"CAST(CAST(`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6))"
        return F.expr(f"CAST({since} * 1000000 AS BIGINT)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def _moment_splits(asked: DataFrame) -> DataFrame:
    """Where the moments of a pair are cut into slices, for pairs with many moments: PAIR, _splits in microseconds and order.

    Cuts are moments drawn by their digest, one of SLICE, so the table holds about 1 / SLICE of the moments at most.
    """
    least, most = SLICES
    cut = F.struct(F.xxhash64(*PAIR, "moment").alias("draw"), _micros(asked, "moment").alias("at")).alias("_cut")
    drawn = asked.where(F.pmod(F.xxhash64(*PAIR, "moment"), F.lit(SLICE)) == 0).select(*PAIR, cut)
    cuts = drawn.groupBy(*PAIR).agg(F.collect_set("_cut").alias("_cuts")).where(F.size("_cuts") >= least - 1)
    return cuts.select(*PAIR, F.array_sort(F.slice(F.array_sort("_cuts"), 1, most - 1)["at"]).alias("_splits"))


def relations_at(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The edges of a pair that are valid at asked moments: `points` has source_id, target_id, moment.

    Result: the points' columns, edge_key, relation_type, one row for every valid edge. Times are compared in microseconds.
    Edges and moments are shuffled once, by pair. The moments of a pair with thousands of them are cut into slices of about
    SLICE, and an edge goes to the slices in which it is valid. Cuts are asked moments, so an edge is written once more for each
    SLICE moments at which it is valid, and meets others in its first and last slice only, however many versions the pair has.
    """
    # The filter that the last join asks for, told here too: cuts and moments then start from the same shuffles.
    asked = points.select(*PAIR, "moment").where(_micros(points, "moment").isNotNull())
    splits = F.broadcast(_moment_splits(asked))
    slice_of = lambda at: F.when(F.col("_splits").isNull(), 0).otherwise(reached("_splits", at, SLICES[1]))
    asked = asked.join(splits, PAIR, "left").select(*PAIR, "moment", slice_of(_micros(asked, "moment")).alias("_slice"))
    asked = asked.repartition(*PAIR, "_slice").distinct().withColumn("_at", _micros(asked, "moment"))
    end = F.coalesce(_micros(edges, "valid_to"), F.lit((1 << 63) - 1))
    held = edges.select(*PAIR, "edge_key", "relation_type", _micros(edges, "valid_from").alias("_start"), end.alias("_end")).where("_end > _start")
    covered = F.sequence(slice_of(F.col("_start")), slice_of(F.col("_end") - 1))
    held = held.join(splits, PAIR, "left").select(
        *[F.col(k).alias(f"_{k}") for k in PAIR], "edge_key", "relation_type", "_start", "_end", F.explode(covered).alias("_of"))
    same = (F.col("_source_id") == F.col("source_id")) & (F.col("_target_id") == F.col("target_id")) & (F.col("_of") == F.col("_slice"))
    # Moments are on the right, where a merge join keeps the rows of a key: a slice has few of them.
    valid = held.join(asked, same & (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
    return valid.select(*PAIR, "moment", "edge_key", "relation_type")


def site_motifs(edges: DataFrame) -> DataFrame:
    """Summary per site over its active edges; nothing below the level of a site is kept."""
    kept = F.col("relation_type") != K.ABSTAINED
    out = active_relations(edges).groupBy("site_id").agg(
        F.count("*").alias("n_total_edges"), F.count(F.when(~kept, F.lit(1))).alias("n_abstained"),
        F.avg(F.when(kept, F.col("coverage"))).alias("mean_coverage"))
    return out.withColumn("abstention_rate", F.col("n_abstained") / F.greatest(F.lit(1), F.col("n_total_edges")))


def site_relation_counts(edges: DataFrame) -> DataFrame:
    return active_relations(edges).where(F.col("relation_type") != K.ABSTAINED).groupBy(
        "site_id", "relation_type").agg(F.count("*").alias("n"))


def federate(summaries: DataFrame) -> DataFrame:
    """Population summary from site summaries alone; coverage weighted by answered edges."""
    weight = F.when(F.col("mean_coverage").isNotNull(), F.col("n_total_edges") - F.col("n_abstained"))
    out = summaries.agg(
        F.count("*").alias("n_sites"), F.coalesce(F.sum("n_total_edges"), F.lit(0)).alias("total_edges"),
        F.coalesce(F.sum("n_abstained"), F.lit(0)).alias("total_abstained"),
        ratio(F.sum(F.col("mean_coverage") * weight), F.sum(weight)).alias("population_mean_coverage"))
    return out.withColumn(
        "population_abstention_rate", F.col("total_abstained") / F.greatest(F.lit(1), F.col("total_edges")))


def federate_counts(site_counts: DataFrame) -> DataFrame:
    return site_counts.groupBy("relation_type").agg(F.sum("n").alias("n"))


def contradiction_pairs(edges: DataFrame) -> DataFrame:
    """Event pairs with more than one active edge and more than one relation type."""
    pairs = active_relations(edges).groupBy(*PAIR).agg(
        F.count("*").alias("n_active"), F.min("relation_type").alias("_a"), F.max("relation_type").alias("_b"))
    return pairs.where((F.col("n_active") > 1) & (F.col("_a") != F.col("_b"))).select(*PAIR, "n_active")


def contradiction_members(edges: DataFrame) -> DataFrame:
    """The active edges of contradicting pairs, as rows."""
    return active_relations(edges).join(contradiction_pairs(edges).select(*PAIR), PAIR, "left_semi")


def model_disagreements(baseline: DataFrame, gated: DataFrame, key: str = "note_id") -> DataFrame:
    """Notes on which two models differ; an abstention against an answer counts, two abstentions do not."""
    a = baseline.select(key, F.col("relation").alias("baseline_relation"))
    b = gated.select(key, F.col("relation").alias("gated_relation"))
    return a.join(b, key, "full_outer").where(~F.col("baseline_relation").eqNullSafe(F.col("gated_relation")))


def _edges_of(results: DataFrame, relation, extra: dict) -> DataFrame:
    abstained = F.col("abstained")
    return results.select(
        node_id(F.col("note_id"), F.col("event1"), F.lit("event")).alias("source_id"),
        node_id(F.col("note_id"), F.col("event2"), F.lit("event")).alias("target_id"),
        F.when(abstained, F.lit(K.ABSTAINED)).otherwise(relation).alias("relation_type"),
        "model_id", "site_id", "seq", F.col("seq").alias("edge_key"), "valid_from", F.col("coverage"),
        F.struct(
            abstained.alias("abstained"), F.when(abstained, F.col("reason")).alias("reason"),
            F.col("coverage").alias("coverage"), F.col("note_id").alias("source_note_id"),
            *[c.alias(n) for n, c in extra.items()]).alias("provenance"))


def ingest_token_gate(results: DataFrame, tau: float = 0.5) -> DataFrame:
    """Edges from token-gate rows: probs and ev_mask arrays, coverage, necessity_drop, abstained, reason."""
    ok = ~F.col("abstained")
    best = F.array_position("probs", F.array_max("probs")) - 1
    flagged = F.filter(F.transform("ev_mask", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    return _edges_of(results, F.concat(F.lit("REL_IDX_"), best.cast("string")), {
        "necessity_drop": F.when(ok, F.col("necessity_drop")),
        "evidence_token_indices": F.when(ok, flagged),
        "gate_tau": F.when(ok, F.lit(tau))})


def ingest_span_gate(results: DataFrame) -> DataFrame:
    """Edges from span-gate rows: relation, evidence_spans, evidence_ranges, confidence, necessity_satisfied."""
    ok = ~F.col("abstained")
    return _edges_of(results, F.col("relation"), {
        "evidence_spans": F.col("evidence_spans"),
        "evidence_char_ranges": F.when(ok, F.col("evidence_ranges")),
        "confidence": F.when(ok, F.col("confidence")),
        "necessity_satisfied": F.when(ok, F.col("necessity_satisfied"))})


def event_nodes(results: DataFrame) -> DataFrame:
    """Node mentions of gate rows, for `resolve_event_nodes`."""
    both = F.explode(F.array("event1", "event2")).alias("label")
    return results.select("note_id", both, F.lit("event").alias("scale"), F.col("valid_from").alias("created_at"), "site_id")
