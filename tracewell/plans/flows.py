"""End-to-end compositions of the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import acceptance, answers, controls, gates, graph, reports, store


def compression_study(facts: DataFrame, edges: DataFrame, notes: DataFrame, points: DataFrame, threshold: float = 0.65,
                      window: int = 2, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Evidence graph, its compressed forms, and how well each answers the query points.

    Returns the evaluation by representation and subset, and the size and recall report.
    """
    reps = answers.compress(graph.build_evidence_graph(facts, edges, notes, seed), threshold, window)
    return answers.evaluate_representations(reps, facts, edges, points), answers.representation_report(reps)


def control_study(notes: DataFrame, predict, clean: DataFrame, variants=("remove_evidence", "mask_temporal_cue")) -> DataFrame:
    """Controls, predictions on them by a user function of the control table, and the paired table."""
    made = controls.make_controls(notes, list(variants))
    labels = made.select("example_id", "variant", F.col("base_note_id").alias("base_id"), "masked_cue",
                         F.lit(None).cast("string").alias("validity_tier"))
    return reports.stratified_paired(predict(made).join(labels, "example_id"), clean)


def store_study(responses: DataFrame, probes: DataFrame) -> dict[str, DataFrame]:
    """Gated responses as edges of the store, their contradictions and the federated summary.

    `responses` also carries event1, event2, model_id, site_id, seq and valid_from.
    """
    edges = store.ingest_span_gate(gates.hard_gate(responses, probes).withColumn("evidence_ranges", F.col("ranges")))
    edges = edges.withColumns({"valid_to": F.lit(None).cast("timestamp"), "end_seq": F.lit(None).cast("long")})
    motifs = store.site_motifs(edges)
    return {"edges": store.append_relations(edges), "contradictions": store.contradiction_pairs(edges),
            "sites": motifs, "population": store.federate(motifs)}


def edit_study(candidates: DataFrame, notes: DataFrame, judged: DataFrame) -> dict[str, DataFrame]:
    """Accepted edits of the notes whose original passes the judge, with report and objections."""
    valid = acceptance.original_valid(judged)
    reasoned = acceptance.edit_reasons(candidates.join(valid.select("note_id"), "note_id", "left_semi"))
    accepted = acceptance.accept_edit(reasoned)
    return {"accepted": accepted, "notes": acceptance.edited_notes(notes, accepted),
            "report": acceptance.edit_report(accepted, notes, valid), "objections": acceptance.edit_rejections(reasoned)}
