"""Schemas of the exchanged files. CSV columns keep their text form until a reader types them."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t()) if isinstance(t, type) else StructField(n, t) for n, t in fields.items()])


NOTES = _schema(
    note_id=StringType, patient_id=StringType, day=IntegerType, style=StringType, is_admission=BooleanType,
    is_revision_note=BooleanType, text=StringType, variant=StringType, gold_relation=StringType,
    gold_evidence_span=StringType, event1=StringType, event2=StringType, base_note_id=StringType,
    injected_spans=StringType, contradiction_types=StringType, mentioned_fact_ids=StringType)
FACTS = _schema(
    patient_id=StringType, fact_id=StringType, concept_type=StringType, value=StringType, day=IntegerType,
    revises=StringType, dose=StringType, culture=StringType)
REVISION_EDGES = _schema(
    patient_id=StringType, from_fact_id=StringType, to_fact_id=StringType, relation=StringType, day=IntegerType)
PREDICTIONS = _schema(
    example_id=StringType, model=StringType, answer=StringType, abstained=StringType, correct=StringType,
    evidence_score=StringType, availability_probability=StringType, evidence_sufficient=StringType, gate_reason=StringType,
    provenance_recorded=StringType, coverage=StringType, evidence_case=StringType, raw_relation=StringType,
    llm_confidence=StringType, reask_agreement=StringType, predicted_evidence_span=StringType, argmax_relation=StringType,
    max_relation_prob=StringType)
JUDGMENTS = _schema(
    note_id=StringType, condition=StringType, verdict_raw=StringType, relation_raw=StringType, evidence=StringType,
    evidence_ok=BooleanType, verdict=StringType, relation=StringType, rationale=StringType, raw=StringType, key=StringType,
    model=StringType, prompt_version=StringType)
RANGES = ArrayType(_schema(start=IntegerType, end=IntegerType))
EDGE = _schema(edge_key=StringType, source_id=StringType, target_id=StringType, relation_type=StringType, coverage=DoubleType)
