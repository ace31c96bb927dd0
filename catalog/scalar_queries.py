"""Normalisers of single values, over dirty columns made from whole tables."""

import uuid

from pyspark.sql import functions as F

from catalog.fixtures import run, view
from catalog.registry import query
from tracewell import constants as K
from tracewell.functions import scalars
from tracewell.session import shared_folder
from tracewell.sources import readers, sinks

DIRTY = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN '1.0' WHEN 4 THEN NULL
 WHEN 5 THEN 'Abstained' WHEN 6 THEN 'no' WHEN 7 THEN '1' WHEN 8 THEN 'y' ELSE CAST(value AS VARCHAR(20)) END AS raw FROM {events}"""


def _in(words):
    return "LOWER(TRIM(raw)) IN (" + ", ".join(f"'{w}'" for w in words) + ")"


@query("b1_parse_bool", f"""
SELECT CASE WHEN TRY_CAST(raw AS DOUBLE) IS NULL OR raw IN ('0', '1', '1.0') THEN raw ELSE 'number' END AS raw, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS)}) AS words, COUNT(*) FILTER (WHERE raw IS NULL OR {_in(K.TRUE_WORDS)}) AS null_true,
  COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS_FLOAT)}) AS with_float, COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS_YES)}) AS yes,
  COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS_NUMERIC)}) AS numeric_words, COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS_SHORT)}) AS short,
  COUNT(*) FILTER (WHERE {_in(K.TRUE_WORDS)} OR TRY_CAST(raw AS DOUBLE) <> 0) AS nonzero
FROM ({DIRTY}) d GROUP BY 1""")
def b1(spark, sf):
    d = run(spark, sf, DIRTY)
    forms = {"words": {}, "null_true": {"null_as": True}, "with_float": {"accept": K.TRUE_WORDS_FLOAT}, "yes": {"accept": K.TRUE_WORDS_YES},
             "numeric_words": {"accept": K.TRUE_WORDS_NUMERIC}, "short": {"accept": K.TRUE_WORDS_SHORT}, "nonzero": {"numeric": True}}
    kind = F.when(scalars.to_double("raw").isNull() | F.col("raw").isin("0", "1", "1.0"), F.col("raw")).otherwise("number")
    return d.groupBy(kind.alias("raw")).agg(
        F.count("*").alias("n"), *[F.count(F.when(scalars.parse_bool("raw", **o), 1)).alias(n) for n, o in forms.items()])


@query("b2_base_id", "SELECT example_id, base_id FROM {f_pred}")
def b2(spark, sf):
    return view(spark, sf, "f_pred").select("example_id", scalars.base_id("example_id").alias("base_id"))


@query("b3_resolve_base_note_id", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CONCAT('n', doc_id) ELSE CONCAT('d', doc_id, '_base') END AS base FROM {documents}""")
def b3(spark, sf):
    d = view(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("n"), "doc_id")).when(F.col("doc_id") % 3 == 1, "").alias("explicit"),
        F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "_adv").otherwise("_nat")).alias("note_id"))
    return d.select("doc_id", scalars.resolve_base_note_id("explicit", "note_id").alias("base"))


@query("b4_normalise", r"""
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END END AS relation,
  CASE doc_id % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'implied_only' WHEN 2 THEN 'implied_only' ELSE 'none' END AS tier,
  MD5(TRIM(REGEXP_REPLACE(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_digest FROM {documents}""")
def b4(spark, sf):
    names = F.array(*[F.lit(f" {r.lower().replace('-', '_')} ") for r in K.RELATIONS])
    tiers = F.array(*[F.lit(t) for t in ("Strict", "implied", "IMPLIED-ONLY", "other")])
    d = view(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 4 < 3, F.get(names, (F.col("doc_id") % 3).cast("int"))).otherwise("no relation")
    return d.select("doc_id", scalars.norm_relation(raw).alias("relation"), scalars.norm_tier(F.get(tiers, (F.col("doc_id") % 4).cast("int"))).alias("tier"),
                    F.md5(scalars.norm_ws("text")).alias("text_digest"))


INJECTED = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' [] ' WHEN 3 THEN 'nan' WHEN 4 THEN '["a"]'
  WHEN 5 THEN '[1, {{"k": 2}}]' WHEN 6 THEN 'free text' ELSE props END AS raw FROM {events}"""


@query("b5_has_injected_content", f"""
SELECT event_id % 8 AS kind, COUNT(*) AS n, COUNT(*) FILTER (WHERE CASE WHEN raw IS NULL OR TRIM(raw) IN ('', '[]', 'nan', 'None') THEN FALSE
  WHEN TRY_CAST(raw AS JSON) IS NULL THEN TRUE ELSE json_type(TRY_CAST(raw AS JSON)) = 'ARRAY' AND json_array_length(TRY_CAST(raw AS JSON)) > 0 END) AS n_injected
FROM ({INJECTED}) i GROUP BY 1""")
def b5(spark, sf):
    d = run(spark, sf, INJECTED)
    return d.groupBy((F.col("event_id") % 8).alias("kind")).agg(
        F.count("*").alias("n"), F.count(F.when(scalars.has_injected_content("raw"), 1)).alias("n_injected"))


BODY = r"""NULLIF(REGEXP_EXTRACT(TRIM(REGEXP_REPLACE(TRIM(REGEXP_REPLACE(raw, '(?s)<think>.*?</think>', '', 'g'), E' \t\n\r'), '(?m)^```(?:json)?|```$', '', 'g'), E' \t\n\r'), '(?s)\{{.*\}}'), '')"""
PARSED = f"""
SELECT note_id, ord, style, text, gold_relation, gold_evidence_span, relation, evidence_span, confidence, reason FROM (
 SELECT *, CASE WHEN j IS NULL THEN 'invalid_json' ELSE '' END AS reason,
  CASE WHEN json_extract_string(j, '$.relation') IN ('EVENT1-BEFORE-EVENT2', 'EVENT2-BEFORE-EVENT1', 'EVENT1-OVERLAP-EVENT2') THEN json_extract_string(j, '$.relation') END AS relation,
  CASE WHEN TRIM(json_extract_string(j, '$.evidence_span')) <> '' THEN json_extract_string(j, '$.evidence_span') END AS evidence_span,
  CASE WHEN j IS NULL THEN 0 ELSE GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), CAST(json_extract_string(j, '$.confidence') AS DOUBLE))) END AS confidence
 FROM (SELECT *, TRY_CAST({BODY} AS JSON) AS j FROM {{f_answers}}) a) b"""


def parsed_answers(spark, sf):
    a = view(spark, sf, "f_answers").withColumn("_p", scalars.parse_answer("raw"))
    return a.select("note_id", "ord", "style", "text", "gold_relation", "gold_evidence_span", "_p.*")


@query("b6_parse_answer", f"SELECT note_id, relation, MD5(evidence_span) AS span_digest, confidence, reason FROM ({PARSED}) p")
def b6(spark, sf):
    return parsed_answers(spark, sf).select("note_id", "relation", F.md5("evidence_span").alias("span_digest"), "confidence", "reason")


# Answers that are JSON but no object, in fences and out of them, beside objects and plain text.
@query("b6_non_object_answers", """
SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'EVENT1-BEFORE-EVENT2' END AS relation, CASE doc_id % 6 WHEN 4 THEN 'invalid_json' WHEN 5 THEN '' ELSE 'non_object_json' END AS reason FROM {documents}""")
def b6_non_object(spark, sf):
    i, text = F.col("doc_id") % 6, F.to_json(F.struct(F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("evidence_span"), F.lit("EVENT1-BEFORE-EVENT2").alias("relation")))
    raw = (F.when(i == 0, F.concat(F.lit("["), text, F.lit("]"))).when(i == 1, F.lit("```json\n[1, 2]\n```")).when(i == 2, F.lit(" null ")).when(i == 3, F.concat(F.lit('"'), F.col("lang"), F.lit('"')))
           .when(i == 4, F.lit("no json at all")).otherwise(text))
    parsed = view(spark, sf, "documents").select("doc_id", scalars.parse_answer(raw).alias("p"))
    return parsed.select("doc_id", "p.relation", "p.reason")


@query("b7_to_double", f"SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number FROM ({DIRTY}) d")
def b7(spark, sf):
    return run(spark, sf, DIRTY).select("event_id", scalars.to_double("raw").alias("number"))


@query("b8_content_key", "SELECT doc_id, SHA256(CONCAT('judge|v1|clean|', text)) AS key FROM {documents}")
def b8(spark, sf):
    return sinks.with_content_key(view(spark, sf, "documents").withColumn("condition", F.lit("clean")), "judge", "v1").select("doc_id", "key")


@query("b9_allen_relation", """
SELECT event_id, CASE WHEN day < 15 THEN 'BEFORE' WHEN day > 15 THEN 'AFTER' ELSE 'OVERLAP' END AS relation FROM {f_events}""")
def b9(spark, sf):
    return view(spark, sf, "f_events").select("event_id", scalars.allen_relation(F.col("day"), F.lit(15)).alias("relation"))


PRINTED = """SELECT event_id, value / 1000 AS shown, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 1000 + (event_id % 3) * CAST(0.0004 AS DOUBLE) END AS recomputed FROM {events}"""


@query("b10_printed_status", f"""
SELECT event_id, CASE WHEN recomputed IS NULL THEN 'MISSING' WHEN ROUND(CAST(CAST(shown AS VARCHAR) AS DECIMAL(30, 15)), 3) = ROUND(CAST(CAST(recomputed AS VARCHAR) AS DECIMAL(30, 15)), 3)
  THEN 'OK' ELSE 'MISMATCH' END AS status FROM ({PRINTED}) p""")
def b10(spark, sf):
    return run(spark, sf, PRINTED).select("event_id", scalars.printed_status("shown", "recomputed", 3).alias("status"))


@query("b11_answered_flags", """
SELECT example_id, abstained = 'False' AS answered, abstained = 'False' AND answer = gold_relation AS correct_answered,
  abstained = 'False' AND COALESCE(answer, '') <> gold_relation AS unsafe FROM {f_pred}""")
def b11(spark, sf):
    p = view(spark, sf, "f_pred").withColumns({"abstained": scalars.parse_bool("abstained"), "correct": (F.col("answer") == F.col("gold_relation")).cast("int")})
    return p.select("example_id", scalars.answered("abstained").alias("answered"), scalars.correct_answered("abstained", "correct").alias("correct_answered"),
                    scalars.unsafe_answer("abstained", "correct").alias("unsafe"))


# ---------------------------------------------------------------- readers and writers that work on tables

@query("a2_relation_notes", "SELECT note_id, gold_relation, 'forward' AS mention_order FROM {f_notes} WHERE gold_evidence_span IS NOT NULL")
def a2(spark, sf):
    return readers.relation_notes(view(spark, sf, "f_notes")).select("note_id", "gold_relation", "mention_order")


@query("a3_manipulation_pairs", """
SELECT CONCAT(note_id, '_adv') AS note_id, note_id AS base_note_id FROM {f_notes} WHERE gold_evidence_span IS NOT NULL""")
def a3(spark, sf):
    n = view(spark, sf, "f_notes")
    adv = n.select(F.concat("note_id", F.lit("_adv")).alias("note_id"), F.col("note_id").alias("base_note_id"))
    return readers.manipulation_pairs(adv, n).select("note_id", "base_note_id")


def predictions(spark, sf):
    """Normalised predictions with the columns the reports need."""
    p = view(spark, sf, "f_pred").withColumn("correct", F.when(F.col("answer").isNotNull(), (F.col("answer") == F.col("gold_relation")).cast("int")))
    p = readers.normalise_predictions(p, score="score")
    return p.withColumn("masked_cue", F.when(F.col("masked_cue").isNotNull(), scalars.parse_bool("masked_cue")))


@query("a4_read_predictions", """
SELECT example_id, model, abstained = 'True' AS abstained, score, base_id, CAST(CASE WHEN answer IS NOT NULL THEN CASE WHEN answer = gold_relation THEN 1 ELSE 0 END END AS DOUBLE) AS correct,
  abstained <> 'True' AND COALESCE(answer = gold_relation, FALSE) AS correct_answered FROM {f_pred}""")
def a4(spark, sf):
    return predictions(spark, sf).select("example_id", "model", "abstained", "score", "base_id", "correct", "correct_answered")


@query("a4_with_gold", """
SELECT example_id, gold_relation, CAST(CASE WHEN abstained = 'False' THEN CASE WHEN answer = gold_relation THEN 1 ELSE 0 END END AS DOUBLE) AS correct FROM {f_pred}""")
def a4_gold(spark, sf):
    gold = view(spark, sf, "f_notes").select("note_id", "gold_relation")
    return readers.with_gold(predictions(spark, sf), gold).select("example_id", "gold_relation", "correct")


@query("a5_control_labels", """
SELECT example_id, CASE WHEN variant IN ('silent_keep') THEN 1 ELSE 0 END AS evidence_available_oracle, variant AS evidence_case, 0 AS contradiction_present_oracle
FROM {f_pred} WHERE variant <> 'clean'""")
def a5(spark, sf):
    c = view(spark, sf, "f_pred").where("variant <> 'clean'").select(
        F.col("example_id").alias("note_id"), (F.col("variant") == "silent_keep").cast("int").alias("evidence_available_oracle"),
        F.col("variant").alias("evidence_case"), F.lit(0).alias("ord"))
    return readers.control_labels(c.unionByName(c.withColumns({"evidence_case": F.lit("later row"), "ord": F.lit(1)})))


@query("a6_last_record", """
SELECT user_id AS note_id, event_type AS condition, MAX(event_id) AS event_id, ARG_MAX(value, event_id) AS value FROM {events} GROUP BY 1, 2""")
def a6(spark, sf):
    e = view(spark, sf, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("condition"), "event_id", "value")
    return readers.last_per_key(e, ["note_id", "condition"], ["event_id"])


@query("a8_require_columns", "SELECT COUNT(*) AS n FROM {documents}")
def a8(spark, sf):
    return readers.require_columns(view(spark, sf, "documents"), ["doc_id", "text"], "documents").agg(F.count("*").alias("n"))


@query("a9_id_lists", "SELECT CONCAT('q', quality, '_t', toxic) AS \"set\", COUNT(*) AS n FROM {labels} GROUP BY 1")
def a9(spark, sf):
    members = view(spark, sf, "labels").select(F.concat(F.lit("q"), "quality", F.lit("_t"), "toxic").alias("set"), F.col("doc_id").cast("string").alias("note_id"))
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    for name in [r["set"] for r in members.select("set").distinct().collect()]:
        ids = members.where(F.col("set") == name).agg(F.to_json(F.collect_list("note_id")).alias("value"))
        ids.coalesce(1).write.text(f"{folder}/{name}.json")
    return readers.read_id_lists(spark, f"{folder}/*.json").groupBy("set").agg(F.count("*").alias("n"))


@query("a11_judge_input", """
SELECT n.note_id, n.gold_relation AS gold, MD5(n.text) AS clean, r.note_id IS NOT NULL AS has_removal, r.tier AS orig_removal_tier, k.note_id IS NOT NULL AS has_keep
FROM {f_notes} n LEFT JOIN (SELECT base_id AS note_id, validity_tier AS tier FROM {f_pred} WHERE variant = 'silent_removal') r ON r.note_id = n.note_id
LEFT JOIN (SELECT base_id AS note_id FROM {f_pred} WHERE variant = 'silent_keep') k ON k.note_id = n.note_id WHERE n.style = 'verbose_discharge'""")
def a11(spark, sf):
    p = view(spark, sf, "f_pred").select(F.col("base_id").alias("note_id"), F.col("example_id").alias("text"), "validity_tier", F.lit(0).alias("ord"), "variant")
    out = sinks.build_judge_input(view(spark, sf, "f_notes"), p.where("variant = 'silent_removal'"), p.where("variant = 'silent_keep'"),
                                  where=["style=Verbose_Discharge"])
    return out.select("note_id", "gold", F.md5("clean").alias("clean"), F.col("silent_removal").isNotNull().alias("has_removal"),
                      "orig_removal_tier", F.col("silent_keep").isNotNull().alias("has_keep"))


@query("a12_nan_as_text", "SELECT doc_id, COALESCE(CAST(quality AS VARCHAR), 'NaN') AS quality FROM (SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) x")
def a12(spark, sf):
    d = view(spark, sf, "documents").select("doc_id").join(view(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sinks.nan_as_text(d).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("a13_cache_misses", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def a13(spark, sf):
    keyed = lambda d: sinks.with_content_key(d.withColumn("condition", F.lit("clean")), "judge", "v1", text="t")
    tasks = keyed(view(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("t")))
    cache = keyed(view(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("t")))
    return sinks.cache_misses(tasks, cache).select("doc_id")


# The texts come in two rounds that overlap, every text twice; a text is processed once in all.
@query("a13_cached_results", """
SELECT MD5(CONCAT('judge|v1|clean|', text)) AS text_key, COUNT(*) AS n_tasks, 1 AS n_results, MAX(LENGTH(text)) AS n_chars FROM {documents} WHERE text IS NOT NULL GROUP BY 1""")
def a13_cached(spark, sf):
    docs = view(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.concat(F.lit("judge|v1|clean|"), "text").cast("binary")).alias("key"), "text")
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    judge = lambda todo: todo.select("key", F.length("text").alias("n_chars"))
    results = None
    for part in (docs.where(F.col("doc_id") % 3 < 2), docs.where(F.col("doc_id") % 3 > 0)):
        found = sinks.cached_results(spark, part.unionAll(part), path, "key string, n_chars int", judge)
        results = found if results is None else results.unionAll(found).distinct()
    n = sinks.open_cache(spark, path, "key string, n_chars int")
    stored = spark.table(n).groupBy("key").agg(F.count("*").cast("int").alias("n_results"))
    return docs.groupBy("key").agg(F.count("*").alias("n_tasks")).join(results, "key").join(stored, "key").select(
        F.col("key").alias("text_key"), "n_tasks", "n_results", "n_chars")
