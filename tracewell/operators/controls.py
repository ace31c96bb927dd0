"""Tables of edited notes: evidence removed, cues masked, contradictions added."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import text as T
from tracewell.functions.hashing import draw_index, draw_key
from tracewell.operators.facts import active_state
from tracewell.operators.splits import sample_fraction


def _edit(text, flag_name=None, flag=None) -> Column:
    none = F.lit(None).cast("boolean")
    return F.struct(text.alias("text"), (flag if flag_name == "removed" else none).alias("removed_gold_span"),
                    (flag if flag_name == "masked" else none).alias("masked_cue"))


def _remove(text, span):
    e = T.remove_evidence(text, span)
    return _edit(e["text"], "removed", e["removed"])


def _mask(text, span):
    e = T.mask_cue(text)
    return _edit(e["text"], "masked", e["masked"])


VARIANTS = {
    "remove_evidence": _remove,
    "mask_temporal_cue": _mask,
    "contradiction": lambda text, span: _edit(T.contradict(text)),
    "remove_and_contradict": lambda text, span: _edit(T.remove_and_contradict(text, span)["text"]),
}
CONTRADICTS = ["contradiction", "remove_and_contradict"]


def make_controls(notes: DataFrame, variants: list[str] = tuple(VARIANTS), fraction: float = 1.0, seed: int = 7,
                  registry: dict = VARIANTS) -> DataFrame:
    """Notes with a relation and a span, once per variant, with labels and provenance of the edit.

    `registry` maps a variant name to a function of the text and span columns.
    """
    unknown = sorted(set(variants) - set(registry))
    if unknown:
        raise ValueError(f"unknown variants: {unknown}")
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    rows = notes.where(F.col("gold_relation").isNotNull() & F.col("gold_evidence_span").isNotNull())
    if fraction < 1:
        rows = sample_fraction(rows, fraction, ["note_id"], seed)
    rows = rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    edit = F.coalesce(*[F.when(F.col("variant") == v, registry[v](F.col("text"), F.col("gold_evidence_span"))) for v in variants])
    case = F.coalesce(*[F.when(F.col("variant") == v, F.lit(K.EVIDENCE_CASES.get(v, v))) for v in variants])
    name = F.concat_ws("_", "note_id", "variant")
    contradicts = F.col("variant").isin(CONTRADICTS)
    return rows.withColumn("_e", edit).withColumns({
        "base_note_id": F.col("note_id"), "example_id": name, "text": F.col("_e.text"),
        "evidence_case": case, "evidence_available_oracle": F.lit(0), "contradiction_present_oracle": contradicts.cast("int"),
        "removed_gold_span": F.col("_e.removed_gold_span"), "masked_cue": F.col("_e.masked_cue"),
        "gold_evidence_span": F.lit(""), "injected_spans": F.lit("[]"),
        "contradiction_types": F.when(contradicts, F.to_json(F.array("variant"))).otherwise("[]"),
    }).withColumn("note_id", F.col("example_id")).drop("_e")


def control_diagnostics(controls: DataFrame) -> DataFrame:
    """Rows, source notes, contradiction label and edit flags per variant."""
    return controls.groupBy("variant").agg(
        F.count("*").alias("n"), F.max("contradiction_present_oracle").alias("contradiction_present"),
        F.count(F.when(F.col("removed_gold_span"), 1)).alias("n_removed"), F.count(F.when(F.col("masked_cue"), 1)).alias("n_masked"))


def _pick(options: Column, key: Column, part: int) -> Column:
    return F.element_at(options, draw_index(key, F.size(options), part) + 1)


def contradiction_clause(kind: Column, key: Column, day: Column, symptom: Column, dose: Column, diagnosis: Column,
                         symptoms=K.SYMPTOMS, doses=K.DOSES) -> Column:
    """Sentence that contradicts the note: another symptom, day or dose, or a negated diagnosis.

    Alternatives are drawn from `key` among the values that differ from the true one.
    """
    others = lambda values, true: F.filter(F.array(*[F.lit(v) for v in values]), lambda v: ~v.eqNullSafe(true))
    shifts = F.array(*[F.lit(s) for s in K.DAY_SHIFTS])
    wrong_day = F.greatest(F.lit(1), day + _pick(shifts, key, 2))
    return (
        F.when(kind == "fabricated_symptom", F.concat(
            F.lit(" Notably, the patient also mentioned "), _pick(others(symptoms, symptom), key, 2),
            F.lit(" which had resolved spontaneously and was not treated.")))
        .when(kind == "temporal_contradiction", F.concat(
            F.lit(" A separate note on file instead documents this event as occurring on day "), wrong_day.cast("string"), F.lit(".")))
        .when(kind == "dosage_contradiction", F.concat(
            F.lit(" The medication administration record instead lists a dose of "), _pick(others(doses, dose), key, 2), F.lit(".")))
        .when(kind == "negation_flip", F.concat(
            F.lit(" On further review, no definitive evidence of "), F.coalesce(diagnosis, F.lit("this diagnosis")), F.lit(" was found.")))
    )


def note_context(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the diagnosis and the treatment dose that are active on the day of each note."""
    known = facts.withColumn("value", F.when(F.col("concept_type") == "treatment", F.col("dose")).otherwise(F.col("value").cast("string")))
    points = notes.select("patient_id", "day").distinct().withColumn(
        "concept_type", F.explode(F.array(F.lit("diagnosis"), F.lit("treatment"))))
    state = active_state(known, points).groupBy("patient_id", "day").agg(
        F.max(F.when(F.col("concept_type") == "diagnosis", F.col("value"))).alias("active_diagnosis"),
        F.max(F.when(F.col("concept_type") == "treatment", F.col("value"))).alias("active_dose"))
    return notes.join(state, ["patient_id", "day"], "left")


def make_adversarial(notes: DataFrame, facts: DataFrame, density: tuple[int, int] = (1, 2), kinds=K.CONTRADICTION_TYPES,
                     seed: int = 7, symptom: str | None = None) -> DataFrame:
    """Notes with between density[0] and density[1] contradictions put before the last sentence.

    Spans are recorded as of their insertion. Choices follow the digest of the note id.
    """
    low, high = density
    rows = note_context(notes, facts).withColumn("_key", draw_key(seed, "note_id"))
    rows = rows.withColumn("_k", low + draw_index(F.col("_key"), high - low + 1, 0))
    names = F.array(*[F.lit(k) for k in kinds])
    true_symptom = F.col(symptom) if symptom else F.lit(None).cast("string")
    rows = rows.withColumns({"_spans": F.array().cast("array<struct<type:string,start:int,end:int,clause:string>>"),
                             "_types": F.array().cast("array<string>")})
    for i in range(high):
        key = draw_key(f"{seed}.{i}", "note_id")
        rows = rows.withColumn("_kind", _pick(names, key, 1))
        clause = contradiction_clause(F.col("_kind"), key, F.col("day"), true_symptom, F.col("active_dose"), F.col("active_diagnosis"))
        rows = rows.withColumn("_clause", clause).withColumn("_i", T.insert_clause("text", F.col("_clause")))
        more = F.col("_k") > i
        span = F.struct(F.col("_kind").alias("type"), F.col("_i.start").alias("start"), F.col("_i.end").alias("end"), F.trim("_clause").alias("clause"))
        rows = rows.withColumns({
            "_spans": F.when(more, F.array_append("_spans", span)).otherwise(F.col("_spans")),
            "_types": F.when(more, F.array_append("_types", F.col("_kind"))).otherwise(F.col("_types")),
            "text": F.when(more, F.col("_i.text")).otherwise(F.col("text"))})
    return rows.withColumns({
        "base_note_id": F.col("note_id"), "note_id": F.concat(F.col("note_id"), F.lit("_adv")), "variant": F.lit("adversarial"),
        "injected_spans": F.to_json("_spans"), "contradiction_types": F.to_json("_types"),
    }).drop("_key", "_k", "_spans", "_types", "_kind", "_clause", "_i")


def shortcut_predict(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """Rule that needs no model: one day mentioned means overlap, else the order of first mention decides.

    `notes` has note_id, text and mentioned_fact_ids; a fact is found by its value, else by its first
    word of four letters or more that occurs.
    """
    named = notes.select("note_id", "text", F.explode("mentioned_fact_ids").alias("fact_id")).join(
        facts.select("fact_id", "concept_type", "value"), "fact_id").withColumn("_at", T.locate_phrase("text", "value"))
    earliest = lambda c: F.min(F.when(F.col("concept_type") == c, F.col("_at")))
    where = named.groupBy("note_id").agg(earliest("diagnosis").alias("_dx"), earliest("treatment").alias("_tx"))
    treated_first = F.col("_tx").isNotNull() & (F.col("_dx").isNull() | (F.col("_tx") < F.col("_dx")))
    relation = (F.when(T.day_mentions("text") == 1, K.OVERLAP).when(treated_first, K.E2_BEFORE).otherwise(K.E1_BEFORE))
    return notes.join(where, "note_id", "left").withColumn("predicted", relation).drop("_dx", "_tx")
