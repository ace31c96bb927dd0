"""Text edits, text features and spans, over whole note texts."""

from pyspark.sql import functions as F

from catalog.fixtures import texts, view
from catalog.registry import query
from tracewell import constants as K
from tracewell.functions import spans, text as T
from tracewell.operators import controls, reports, robustness


def _q(s: str) -> str:
    return s.replace("'", "''")


def notes(spark, sf):
    return view(spark, sf, "f_notes")


def _lexical(style, table):
    out = "text"
    for phrase, short in table.items():
        out = f"REGEXP_REPLACE({out}, '(?i){phrase}', '{_q(short)}', 'g')"
    return f"WHEN style = '{style}' THEN {out}"


STRUCTURED = r"""CONCAT(ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(TRIM(text, E' \t\n\r'), '([.;])[ \t\n\f\r]+', '\1' || CHR(1), 'g'), CHR(1)),
 lambda p: TRIM(p, E' \t\n\r') <> ''), lambda p: RTRIM(p, '.;')), '; '), '.')"""


@query("c1_lexical_style", "SELECT note_id, MD5(CASE " + " ".join(_lexical(s, t) for s, t in K.LEXICAL_STYLES.items()) + f" WHEN style = 'structured_admission' THEN {STRUCTURED} ELSE text END) AS digest FROM {{f_notes}}")
def c1(spark, sf):
    return notes(spark, sf).select("note_id", F.md5(T.lexical_style("text", "style")).alias("digest"))


@query("c2_structured_style", f"SELECT note_id, MD5({STRUCTURED}) AS digest FROM {{f_notes}}")
def c2(spark, sf):
    return notes(spark, sf).select("note_id", F.md5(T.structured_style("text")).alias("digest"))


REMOVED = f"""CASE WHEN COALESCE(gold_evidence_span, '') <> '' AND STRPOS(text, gold_evidence_span) > 0 THEN
  CONCAT(SUBSTR(text, 1, STRPOS(text, gold_evidence_span) - 1), '{K.REMOVED_SENTENCE}', SUBSTR(text, STRPOS(text, gold_evidence_span) + LENGTH(gold_evidence_span)))
  ELSE '{K.REMOVED_NOTE}' END"""


@query("c3_remove_evidence", f"SELECT note_id, MD5({REMOVED}) AS digest, COALESCE(STRPOS(text, gold_evidence_span) > 0, FALSE) AS removed FROM {{f_notes}}")
def c3(spark, sf):
    e = T.remove_evidence("text", "gold_evidence_span")
    return notes(spark, sf).select("note_id", F.md5(e["text"]).alias("digest"), e["removed"].alias("removed"))


CUE = "CASE " + " ".join(f"WHEN STRPOS(LOWER(text), '{c}') > 0 THEN '{c}'" for c in K.TEMPORAL_CUES) + " END"
MASKED = f"""CASE WHEN cue IS NULL THEN CONCAT(text, '{K.MASK_NOTICE}') ELSE
  CONCAT(SUBSTR(text, 1, STRPOS(LOWER(text), cue) - 1), '{K.MASK_TOKEN}', SUBSTR(text, STRPOS(LOWER(text), cue) + LENGTH(cue))) END"""


@query("c4_mask_cue", f"SELECT note_id, MD5({MASKED}) AS digest, cue IS NOT NULL AS masked FROM (SELECT *, {CUE} AS cue FROM {{f_notes}}) n")
def c4(spark, sf):
    e = T.mask_cue("text")
    return notes(spark, sf).select("note_id", F.md5(e["text"]).alias("digest"), e["masked"].alias("masked"))


@query("c5_contradict", f"SELECT note_id, MD5(CONCAT(text, '{K.CONTRADICTION_CLAUSE}')) AS digest FROM {{f_notes}}")
def c5(spark, sf):
    return notes(spark, sf).select("note_id", F.md5(T.contradict("text")).alias("digest"))


@query("c6_remove_and_contradict", f"SELECT note_id, MD5(CONCAT({REMOVED}, '{K.REMOVED_CONTRADICTION_CLAUSE}')) AS digest FROM {{f_notes}}")
def c6(spark, sf):
    return notes(spark, sf).select("note_id", F.md5(T.remove_and_contradict("text", "gold_evidence_span")["text"]).alias("digest"))


@query("c7_make_controls", f"""
SELECT CONCAT(n.note_id, '_', v.variant) AS note_id, n.note_id AS base_note_id, v.variant,
  MD5(CASE v.variant WHEN 'remove_evidence' THEN {REMOVED} WHEN 'mask_temporal_cue' THEN {MASKED} WHEN 'contradiction' THEN CONCAT(text, '{K.CONTRADICTION_CLAUSE}')
      ELSE CONCAT({REMOVED}, '{K.REMOVED_CONTRADICTION_CLAUSE}') END) AS digest,
  CASE WHEN v.variant IN ('contradiction', 'remove_and_contradict') THEN 1 ELSE 0 END AS contradiction_present_oracle,
  CASE WHEN v.variant = 'mask_temporal_cue' THEN cue IS NOT NULL END AS masked_cue,
  CASE WHEN v.variant IN ('contradiction', 'remove_and_contradict') THEN CONCAT('["', v.variant, '"]') ELSE '[]' END AS contradiction_types
FROM (SELECT *, {CUE} AS cue FROM {{f_notes}} WHERE gold_evidence_span IS NOT NULL) n
CROSS JOIN (VALUES ('remove_evidence'), ('mask_temporal_cue'), ('contradiction'), ('remove_and_contradict')) AS v(variant)""")
def c7(spark, sf):
    c = controls.make_controls(notes(spark, sf))
    return c.select("note_id", "base_note_id", "variant", F.md5("text").alias("digest"), "contradiction_present_oracle", "masked_cue", "contradiction_types")


@query("c7_control_diagnostics", f"""
SELECT v.variant, COUNT(*) AS n, CASE WHEN v.variant IN ('contradiction', 'remove_and_contradict') THEN 1 ELSE 0 END AS contradiction_present,
  CASE WHEN v.variant = 'remove_evidence' THEN COUNT(*) FILTER (WHERE STRPOS(text, gold_evidence_span) > 0) ELSE 0 END AS n_removed,
  CASE WHEN v.variant = 'mask_temporal_cue' THEN COUNT(*) FILTER (WHERE cue IS NOT NULL) ELSE 0 END AS n_masked
FROM (SELECT *, {CUE} AS cue FROM {{f_notes}} WHERE gold_evidence_span IS NOT NULL) n
CROSS JOIN (VALUES ('remove_evidence'), ('mask_temporal_cue'), ('contradiction'), ('remove_and_contradict')) AS v(variant) GROUP BY v.variant""")
def c7_diagnostics(spark, sf):
    return controls.control_diagnostics(controls.make_controls(notes(spark, sf)))


CLAUSE = " A later entry disagrees."
CUT = "CASE WHEN STRPOS(REVERSE(SUBSTR(text, 1, LENGTH(text) - 1)), '.') > 0 THEN LENGTH(text) - 1 - STRPOS(REVERSE(SUBSTR(text, 1, LENGTH(text) - 1)), '.') ELSE LENGTH(text) - 1 END"


@query("c8_insert_clause", f"""
SELECT note_id, MD5(CONCAT(SUBSTR(text, 1, cut), '.', '{CLAUSE}', SUBSTR(text, cut + 2))) AS digest, cut + 1 AS "start", cut + 1 + {len(CLAUSE)} AS "end"
FROM (SELECT note_id, text, {CUT} AS cut FROM {{f_notes}}) n""")
def c8(spark, sf):
    i = T.insert_clause("text", CLAUSE)
    return notes(spark, sf).select("note_id", F.md5(i["text"]).alias("digest"), i["start"].alias("start"), i["end"].alias("end"))


def dosed_facts(spark, sf):
    """Facts with a dose per treatment."""
    doses = F.array(*[F.lit(d) for d in K.DOSES])
    return view(spark, sf, "f_facts").withColumn("dose", F.get(doses, (F.col("fact_id") % 5).cast("int"))).withColumn(
        "value", F.concat(F.lit("finding "), F.col("value").cast("string")))


@query("c9_note_context", """
SELECT n.note_id, MAX(CASE WHEN a.concept_type = 'diagnosis' THEN a.fact_id END) AS diagnosis_fact, MAX(CASE WHEN a.concept_type = 'treatment' THEN a.fact_id % 5 END) AS dose_index
FROM {f_notes} n LEFT JOIN (
  SELECT p.patient_id, p.day, f.concept_type, MAX(f.fact_id) AS fact_id FROM (SELECT DISTINCT patient_id, day FROM {f_notes}) p
  JOIN {f_facts} f ON f.patient_id = p.patient_id AND f.day <= p.day
  WHERE NOT EXISTS (SELECT 1 FROM {f_facts} g WHERE g.revises = f.fact_id AND g.day <= p.day) GROUP BY p.patient_id, p.day, f.concept_type) a
 ON a.patient_id = n.patient_id AND a.day = n.day GROUP BY n.note_id""")
def c9(spark, sf):
    f = view(spark, sf, "f_facts").withColumns({"dose": (F.col("fact_id") % 5).cast("string"), "value": F.col("fact_id").cast("string")})
    c = controls.note_context(notes(spark, sf), f)
    return c.select("note_id", F.col("active_diagnosis").cast("long").alias("diagnosis_fact"), F.col("active_dose").cast("long").alias("dose_index"))


_HALF = "CAST(CAST(CONCAT('0x', SUBSTR(MD5(CONCAT('7|', note_id)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296 >= 0.5"


@query("c10_make_adversarial", f"""
SELECT CONCAT(note_id, '_adv') AS note_id, 1 + CASE WHEN {_HALF} THEN 1 ELSE 0 END AS n_injected, TRUE AS reads_back, TRUE AS longer FROM {{f_notes}}""")
def c10(spark, sf):
    n = notes(spark, sf)
    a = controls.make_adversarial(n, dosed_facts(spark, sf))
    found = F.from_json("injected_spans", "array<struct<type:string,start:int,end:int,clause:string>>")
    a = a.withColumn("_s", found).withColumn("_last", F.element_at("_s", -1))
    inside = F.substr("text", F.col("_last.start") + 1, F.col("_last.end") - F.col("_last.start"))
    before = n.select(F.col("note_id").alias("base_note_id"), F.char_length("text").alias("_n"))
    return a.join(before, "base_note_id").select(
        "note_id", F.size("_s").alias("n_injected"), (F.trim(inside) == F.col("_last.clause")).alias("reads_back"),
        (F.char_length("text") > F.col("_n")).alias("longer"))


@query("c11_perturb", """
SELECT note_id, TRUE AS swap_keeps_words, TRUE AS noise_keeps_length, TRUE AS insertion_grows FROM {f_notes}""")
def c11(spark, sf):
    n = notes(spark, sf)
    seed = F.xxhash64("note_id")
    made = {k: T.perturb("text", F.lit(k), 2, seed) for k in K.PERTURBATIONS}
    words = lambda c: T.word_count(c)
    p = n.withColumns({f"_{k}": c for k, c in made.items()}).withColumns({"_n": words("text"), "_n_inserted": words("_token_insertion")})
    return p.select(
        "note_id", ((words("_synonym_substitution") == F.col("_n")) & (F.col("_abbreviation_swap") != "")).alias("swap_keeps_words"),
        (F.char_length("_ocr_noise") == F.char_length("text")).alias("noise_keeps_length"),
        F.col("_n_inserted").between(F.col("_n") + 2, F.col("_n") + 4).alias("insertion_grows"))


@query("c11_perturbed_samples")
def c11_samples(spark, sf):
    return robustness.perturbed_notes(notes(spark, sf).select("note_id", "text"), 4).groupBy("perturbation", "k").agg(F.count("*").alias("n"))


@query("c12_mask_ranges", f"SELECT note_id, MD5(CONCAT(SUBSTR(text, 1, 5), '{K.REDACTED}', SUBSTR(text, 9, 11), '{K.REDACTED}', SUBSTR(text, 31))) AS digest FROM {{f_notes}}")
def c12(spark, sf):
    r = F.array(spans.make_range(F.lit(5), F.lit(8)), spans.make_range(F.lit(19), F.lit(30)))
    return notes(spark, sf).select("note_id", F.md5(T.mask_ranges("text", r)).alias("digest"))


@query("c13_natural_variant", "SELECT note_id, MD5(REPLACE(REPLACE(text, 'intravenous', 'IV'), 'day', 'hospital day')) AS digest FROM {f_notes}")
def c13(spark, sf):
    return notes(spark, sf).select("note_id", F.md5(T.natural_variant("text")).alias("digest"))


# ---------------------------------------------------------------- features

# Accented letters become plain ones, so that the ASCII word boundaries of the oracle agree.
PLAIN = r"REGEXP_REPLACE(text, '[\x{{00C0}}-\x{{024F}}]', 'q', 'g')"


def _brace(pattern: str) -> str:
    return _q(pattern).replace("{", "{{").replace("}", "}}")


MARKERS = "LIST_FILTER([" + ", ".join(f"CASE WHEN REGEXP_MATCHES(t, '(?i){_brace(K.MARKER_PATTERNS[m])}') THEN '{m}' END" for m in sorted(K.MARKER_PATTERNS)) + "], lambda x: x IS NOT NULL)"


@query("e1_marker_hits", f"SELECT doc_id, ARRAY_TO_STRING({MARKERS}, ',') AS markers FROM (SELECT doc_id, {PLAIN} AS t FROM {{documents}}) d")
def e1(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(T.marker_hits("text"), ",").alias("markers"))


@query("e1_new_markers", f"SELECT note_id, CASE WHEN cue IS NULL THEN 'meta_temporal,omitted' ELSE 'brackets' END AS markers FROM (SELECT note_id, {CUE} AS cue, text FROM {{f_notes}}) n")
def e1_new(spark, sf):
    return notes(spark, sf).select("note_id", F.array_join(T.new_markers("text", T.mask_cue("text")["text"]), ",").alias("markers"))


@query("e2_explicit_cues", f"""
SELECT note_id, LEN(c) AS n_cues, LOWER(c[1]) AS first_cue FROM (
  SELECT note_id, REGEXP_EXTRACT_ALL({PLAIN}, '(?i){_brace(K.EXPLICIT_CUE)}') AS c FROM {{f_notes}}) n""")
def e2(spark, sf):
    c = T.explicit_cues("text")
    return notes(spark, sf).select("note_id", F.size(c).alias("n_cues"), F.lower(F.get(c, F.lit(0))).alias("first_cue"))


@query("e3_novel_frac", f"""
SELECT note_id, ROUND(CAST(LEN(LIST_FILTER(e, lambda t: NOT LIST_CONTAINS(o, t))) AS DOUBLE) / GREATEST(1, LEN(e)), 6) AS novel FROM (
  SELECT note_id, LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+')) AS o, REGEXP_EXTRACT_ALL(LOWER({MASKED}), '[a-z0-9]+') AS e
  FROM (SELECT *, {CUE} AS cue FROM {{f_notes}}) m) n""")
def e3(spark, sf):
    return notes(spark, sf).select("note_id", F.round(T.novel_frac("text", T.mask_cue("text")["text"]), 6).alias("novel"))


@query("e4_length_ratio", f"SELECT note_id, ROUND(CAST(LENGTH({REMOVED}) AS DOUBLE) / GREATEST(1, LENGTH(text)), 6) AS ratio FROM {{f_notes}}")
def e4(spark, sf):
    return notes(spark, sf).select("note_id", F.round(T.length_ratio("text", T.remove_evidence("text", "gold_evidence_span")["text"]), 6).alias("ratio"))


@query("e5_day_mentions", rf"""
SELECT note_id, LEN(REGEXP_EXTRACT_ALL({PLAIN}, '(?i)\bday\s*(\d+)')) AS n_days, REGEXP_MATCHES(text, '[0-9]') AS has_digit FROM {{f_notes}}""")
def e5(spark, sf):
    return notes(spark, sf).select("note_id", T.day_mentions("text").alias("n_days"), T.has_digit("text").alias("has_digit"))


def worded(spark, sf):
    """Documents that mention two facts named by words of their own text."""
    d = texts(spark, sf)
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    facts = d.select((F.col("doc_id") * 2).alias("fact_id"), F.lit("diagnosis").alias("concept_type"), word(9).alias("value")).unionByName(
        d.select((F.col("doc_id") * 2 + 1).alias("fact_id"), F.lit("treatment").alias("concept_type"), F.concat(word(6), F.lit(" 1234 "), word(7)).alias("value")))
    n = d.select(F.col("doc_id").cast("string").alias("note_id"), "text", F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1).alias("mentioned_fact_ids"))
    return n, facts


_AT = "COALESCE(NULLIF(STRPOS(LOWER(text), LOWER(v)), 0), LIST_FILTER(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(LOWER(v), '[a-z]{{4,}}'), lambda w: STRPOS(LOWER(text), w)), lambda p: p > 0)[1])"


@query("e6_locate_phrase", f"""
SELECT note_id, {_AT.replace('(v)', '(dv)')} - 1 AS word_at, {_AT.replace('(v)', '(tv)')} - 1 AS words_at, LEAST({_AT.replace('(v)', '(dv)')}, {_AT.replace('(v)', '(tv)')}) - 1 AS first_at
FROM (SELECT CAST(doc_id AS VARCHAR) AS note_id, text, SPLIT_PART(text, ' ', 9) AS dv, CONCAT(SPLIT_PART(text, ' ', 6), ' 1234 ', SPLIT_PART(text, ' ', 7)) AS tv FROM {{documents}}) a""")
def e6(spark, sf):
    n, facts = worded(spark, sf)
    value = lambda kind, name: facts.where(F.col("concept_type") == kind).select(F.floor(F.col("fact_id") / 2).cast("string").alias("note_id"), F.col("value").alias(name))
    rows = n.join(value("diagnosis", "dv"), "note_id").join(value("treatment", "tv"), "note_id")
    return rows.select("note_id", T.locate_phrase("text", "dv").alias("word_at"), T.locate_phrase("text", "tv").alias("words_at"), T.first_phrase("text", F.array("dv", "tv")).alias("first_at"))


@query("e7_shortcut_predict", rf"""
SELECT note_id, CASE WHEN LEN(REGEXP_EXTRACT_ALL({PLAIN}, '(?i)\bday\s*(\d+)')) = 1 THEN 'EVENT1-OVERLAP-EVENT2'
  WHEN tx IS NOT NULL AND (dx IS NULL OR tx < dx) THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-BEFORE-EVENT2' END AS predicted
FROM (SELECT note_id, text, {_AT.replace('(v)', '(dv)')} AS dx, {_AT.replace('(v)', '(tv)')} AS tx FROM (
  SELECT CAST(doc_id AS VARCHAR) AS note_id, text, SPLIT_PART(text, ' ', 9) AS dv, CONCAT(SPLIT_PART(text, ' ', 6), ' 1234 ', SPLIT_PART(text, ' ', 7)) AS tv FROM {{documents}}) a) b""")
def e7(spark, sf):
    n, facts = worded(spark, sf)
    return controls.shortcut_predict(n, facts).select("note_id", "predicted")


# ---------------------------------------------------------------- spans

@query("e8_locate_span", """
SELECT note_id, CASE WHEN gold_evidence_span IS NULL THEN 'no_generator_evidence_label' WHEN STRPOS(text, gold_evidence_span) > 0 THEN 'exact' ELSE 'not_exactly_located' END AS status,
  COALESCE(STRPOS(text, gold_evidence_span), 0) - 1 AS start FROM {f_notes}""")
def e8(spark, sf):
    return notes(spark, sf).select("note_id", spans.alignment_status("text", "gold_evidence_span", F.col("gold_evidence_span").isNotNull()).alias("status"),
                                   spans.find_span("text", "gold_evidence_span").alias("start"))


@query("e9_locate_spans_exact", """
SELECT note_id, CASE WHEN LENGTH(s) >= 8 AND STRPOS(text, s) > 0 THEN LENGTH(s) ELSE 0 END AS coverage_chars
FROM (SELECT note_id, text, TRIM(SUBSTR(text, 8, 30), E' \\t\\n\\r') AS s FROM {f_notes}) n""")
def e9(spark, sf):
    n = notes(spark, sf).withColumn("cited", F.array(F.substring("text", 8, 30)))
    return spans.locate_spans_fuzzy(n, "text", "cited").select("note_id", "coverage_chars")


@query("e9_locate_spans_fuzzy", """
SELECT note_id, CASE WHEN ok THEN 1 ELSE 0 END AS n_ranges, CASE WHEN ok THEN STRPOS(text, s) - 1 END AS start, CASE WHEN ok THEN STRPOS(text, s) - 1 + LENGTH(s) END AS stop,
  CASE WHEN ok THEN LENGTH(s) ELSE 0 END AS coverage_chars
FROM (SELECT *, LENGTH(s) >= 8 AND LENGTH(s) >= 0.85 * (LENGTH(s) + 1) AS ok FROM (
  SELECT note_id, text, LTRIM(SUBSTR(text, GREATEST(1, CAST(LENGTH(text) // 2 AS INT)), 30), E' \\t\\n\\r') AS s FROM {f_notes}) m) n""")
def e9_fuzzy(spark, sf):
    # The cited span, from the middle of the text, has one foreign character at its end, so it never occurs verbatim.
    cited = F.concat(F.substr("text", F.greatest(F.lit(1), F.floor(F.char_length("text") / 2).cast("int")), F.lit(30)), F.lit("§"))
    found = spans.locate_spans_fuzzy(notes(spark, sf).withColumn("cited", F.array(cited)), "text", "cited")
    first = F.get("ranges", F.lit(0))
    return found.select("note_id", F.size("ranges").alias("n_ranges"), first["start"].alias("start"), first["end"].alias("stop"), "coverage_chars")


@query("e9_repeated_ids", """
SELECT note_id, COUNT(*) AS n_rows, SUM(CASE WHEN LENGTH(s) >= 8 AND STRPOS(text, s) > 0 THEN LENGTH(s) ELSE 0 END) AS coverage_chars
FROM (SELECT SUBSTR(note_id, 1, LENGTH(note_id) - 1) AS note_id, text, TRIM(SUBSTR(text, 8, 30), E' \\t\\n\\r') AS s FROM {f_notes}) n GROUP BY 1""")
def e9_repeated(spark, sf):
    n = notes(spark, sf).withColumn("cited", F.array(F.substring("text", 8, 30)))
    found = spans.locate_spans_fuzzy(n.withColumn("note_id", F.expr("substr(note_id, 1, length(note_id) - 1)")), "text", "cited")
    return found.groupBy("note_id").agg(F.count("*").alias("n_rows"), F.sum("coverage_chars").alias("coverage_chars"))


@query("e10_char_overlap", """
SELECT note_id, ROUND(CASE WHEN g > 0 THEN CAST(i AS DOUBLE) / gn END, 6) AS recall, ROUND(CASE WHEN g > 0 AND p > 0 THEN CAST(i AS DOUBLE) / pn END, 6) AS precision
FROM (SELECT *, CASE WHEN p = 0 THEN 0 ELSE GREATEST(0, LEAST(p + pn, g + gn) - GREATEST(p, g)) END AS i FROM (
  SELECT note_id, COALESCE(STRPOS(text, gold_evidence_span), 0) AS g, LENGTH(gold_evidence_span) AS gn, STRPOS(text, s) AS p, LENGTH(s) AS pn
  FROM (SELECT *, SUBSTR(text, GREATEST(1, LENGTH(text) - 40), 25) AS s FROM {f_notes}) a) b) c""")
def e10(spark, sf):
    n = notes(spark, sf).withColumn("s", F.substr("text", F.greatest(F.lit(1), F.char_length("text") - 40), F.lit(25)))
    o = spans.char_overlap("text", "s", "gold_evidence_span")
    return n.select("note_id", F.round(o["recall"], 6).alias("recall"), F.round(o["precision"], 6).alias("precision"))


def _two_ranges():
    """Two ranges per event that may overlap, from the value and the number of the event."""
    a = (F.col("event_id") % 50).cast("int")
    b = F.floor(F.col("value")).cast("int") % 60
    return F.array(spans.make_range(a, a + 12), spans.make_range(b, b + 9))


_R = "(SELECT event_id, CAST(event_id % 50 AS INT) AS a, CAST(FLOOR(value) AS INT) % 60 AS b FROM {events}) r"
_CLIP = lambda s, n: f"GREATEST(0, LEAST({s} + {n}, 45) - GREATEST({s}, 10))"
_BOTH = "GREATEST(0, LEAST(a + 12, b + 9, 45) - GREATEST(a, b, 10))"


@query("e11_range_recall", f"SELECT event_id, ROUND(CAST({_CLIP('a', 12)} + {_CLIP('b', 9)} - {_BOTH} AS DOUBLE) / 35, 6) AS recall FROM {_R}")
def e11(spark, sf):
    return view(spark, sf, "events").select("event_id", F.round(spans.range_recall(F.lit(10), F.lit(45), _two_ranges()), 6).alias("recall"))


@query("e12_range_jaccard", f"""
SELECT event_id, ROUND(CAST(shared AS DOUBLE) / (35 + total - shared), 6) AS jaccard FROM (SELECT event_id, {_CLIP('a', 12)} + {_CLIP('b', 9)} - {_BOTH} AS shared,
  12 + 9 - GREATEST(0, LEAST(a + 12, b + 9) - GREATEST(a, b)) AS total FROM {_R}) x""")
def e12(spark, sf):
    gold = F.array(spans.make_range(F.lit(10), F.lit(45)))
    return view(spark, sf, "events").select("event_id", F.round(spans.range_jaccard(_two_ranges(), gold, 1000), 6).alias("jaccard"))


@query("e12_index_jaccard", """
SELECT event_id, ROUND(CASE WHEN LEN(LIST_DISTINCT(LIST_CONCAT(x, y))) = 0 THEN 1.0 ELSE CAST(LEN(LIST_INTERSECT(x, y)) AS DOUBLE) / LEN(LIST_DISTINCT(LIST_CONCAT(x, y))) END, 6) AS jaccard
FROM (SELECT event_id, RANGE(0, event_id % 6) AS x, RANGE(2, event_id % 9) AS y FROM {events}) e""")
def e12_index(spark, sf):
    upto = lambda low, n: F.when(n > low, F.sequence(F.lit(low).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return view(spark, sf, "events").select("event_id", F.round(spans.index_jaccard(upto(0, F.col("event_id") % 6), upto(2, F.col("event_id") % 9)), 6).alias("jaccard"))


@query("e13_ranges_overlap", f"SELECT event_id, LEAST(a + 12, 45) > GREATEST(a, 40) OR LEAST(b + 9, 45) > GREATEST(b, 40) AS overlaps FROM {_R}")
def e13(spark, sf):
    return view(spark, sf, "events").select("event_id", spans.ranges_overlap_any(_two_ranges(), F.array(spans.make_range(F.lit(40), F.lit(45)))).alias("overlaps"))


@query("e14_injected_spans", """
SELECT note_id, CASE ord % 3 WHEN 0 THEN 3 WHEN 1 THEN LENGTH(text) + 1 ELSE NULL END AS start, CASE ord % 3 WHEN 0 THEN 9 WHEN 1 THEN LENGTH(text) + 27 ELSE NULL END AS stop FROM {f_notes}""")
def e14(spark, sf):
    kind = F.col("ord") % 3
    n = notes(spark, sf).withColumns({
        "raw": F.when(kind == 0, '[{"type": "t", "start": 3, "end": 9, "clause": "c"}]').when(kind == 1, "not json").otherwise("[]"),
        "body": F.when(kind == 1, F.concat("text", F.lit(" Notably, it was not treated."))).otherwise(F.col("text"))})
    r = F.get(spans.injected_spans("raw", "body"), F.lit(0))
    return n.select("note_id", r["start"].alias("start"), (r["end"] - F.when(kind == 1, 2).otherwise(0)).alias("stop"))


def tokenised(spark, sf):
    """Notes with word offsets, gold token labels and flags set on two regions of the text."""
    n = notes(spark, sf).withColumn("offsets", spans.token_offsets("text"))
    gold = F.when(spans.find_span("text", "gold_evidence_span") >= 0, F.array(spans.span_range("text", "gold_evidence_span"))).otherwise(spans.no_ranges())
    end = F.char_length("text")
    marked = F.array(spans.make_range(F.lit(5), F.lit(30)), spans.make_range(end - 50, end - 14))
    return n.withColumns({"gold": spans.token_labels("offsets", gold), "flags": spans.token_labels("offsets", marked)})


_TOK = r"""
words AS (SELECT note_id, text, gold_evidence_span, UNNEST(STRING_SPLIT_REGEX(text, '[ \t\n\x0B\f\r]')) AS w, GENERATE_SUBSCRIPTS(STRING_SPLIT_REGEX(text, '[ \t\n\x0B\f\r]'), 1) AS i FROM {f_notes}),
placed AS (SELECT note_id, w, i, SUM(LENGTH(w) + 1) OVER (PARTITION BY note_id ORDER BY i) - LENGTH(w) - 1 AS s, LENGTH(text) AS n, COALESCE(STRPOS(text, gold_evidence_span), 0) - 1 AS g, LENGTH(gold_evidence_span) AS gn FROM words),
tok AS (SELECT note_id, i, s, s + LENGTH(w) AS e, CASE WHEN g >= 0 AND s >= g AND s + LENGTH(w) <= g + gn THEN 1 ELSE 0 END AS gold,
  CASE WHEN (s >= 5 AND s + LENGTH(w) <= 30) OR (s >= n - 50 AND s + LENGTH(w) <= n - 14) THEN 1 ELSE 0 END AS flag FROM placed WHERE w <> '')
"""


@query("e15_token_labels", "WITH " + _TOK + "SELECT note_id, COUNT(*) AS n_tokens, CAST(SUM(gold) AS BIGINT) AS n_gold, CAST(SUM(flag) AS BIGINT) AS n_flags FROM tok GROUP BY note_id")
def e15(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return tokenised(spark, sf).select("note_id", F.size("offsets").alias("n_tokens"), total("gold").alias("n_gold"), total("flags").alias("n_flags"))


@query("e16_longest_flag_run", "WITH " + _TOK + """,
seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY note_id ORDER BY i) - ROW_NUMBER() OVER (PARTITION BY note_id, flag ORDER BY i) AS grp FROM tok),
runs AS (SELECT note_id, MIN(s) AS s, MAX(e) AS e FROM seq WHERE flag = 1 GROUP BY note_id, grp)
SELECT n.note_id, r.s AS start, r.e - r.s AS width FROM {f_notes} n LEFT JOIN (
  SELECT * FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY note_id ORDER BY e - s DESC, s) = 1) r ON r.note_id = n.note_id""")
def e16(spark, sf):
    run = spans.longest_flag_run("text", "offsets", "flags")
    t = tokenised(spark, sf).withColumn("run", run)
    # The run's place is read off the flags: the first flagged word whose text starts the run.
    first = F.element_at(F.filter(F.zip_with("offsets", "flags", lambda o, f: F.struct(o.alias("o"), f.alias("f"))),
                                  lambda p: (p["f"] == 1) & (F.substr("text", p["o"]["start"] + 1, F.char_length("run")) == F.col("run"))), 1)
    return t.select("note_id", F.when(F.col("run").isNotNull(), first["o"]["start"]).alias("start"), F.char_length("run").alias("width"))


@query("e17_token_recall", "WITH " + _TOK + """
SELECT note_id, ROUND(CASE WHEN SUM(gold) > 0 THEN CAST(SUM(gold * flag) AS DOUBLE) / SUM(gold) END, 6) AS recall FROM tok GROUP BY note_id""")
def e17(spark, sf):
    return tokenised(spark, sf).select("note_id", F.round(spans.token_recall("flags", "gold"), 6).alias("recall"))


@query("e18_notice_survival", """
SELECT CASE WHEN share > -0.01 AND share <= 0 THEN 'none' WHEN share > 0 AND share <= 0.999 THEN 'partial' WHEN share > 0.999 AND share <= 1 THEN 'full' END AS visibility,
  COUNT(*) AS n, COUNT(*) FILTER (WHERE abstained = 'False') AS n_answered, ROUND(AVG(seen), 6) AS mean_visible_tokens
FROM (SELECT abstained, CAST(seen AS DOUBLE) / 12 AS share, seen FROM (SELECT abstained, GREATEST(0, LEAST(126 - (n_chars // 6 - 2), 12)) AS seen FROM {f_pred} WHERE variant = 'mask_temporal_cue') a) b GROUP BY 1""")
def e18(spark, sf):
    p = view(spark, sf, "f_pred").where("variant = 'mask_temporal_cue'").select(
        F.expr("n_chars DIV 6").alias("n_clean"), F.expr("n_chars DIV 6 + 12").alias("n_notice"), (F.col("abstained") == "True").alias("abstained"))
    return reports.notice_survival(p).withColumn("mean_visible_tokens", F.round("mean_visible_tokens", 6))


@query("e19_corpus_stats", rf"""
SELECT COUNT(*) AS n_relation_notes, (SELECT ROUND(CAST(MAX(c) AS DOUBLE) / SUM(c), 6) FROM (SELECT COUNT(*) AS c FROM {{f_notes}} WHERE gold_evidence_span IS NOT NULL GROUP BY gold_relation) x) AS majority_rate,
  COUNT(*) FILTER (WHERE STRPOS(text, gold_evidence_span) > 0) AS n_spans_in_text, COUNT(*) FILTER (WHERE {CUE} IS NULL) AS n_without_cue,
  MEDIAN(LEN(STRING_SPLIT_REGEX(TRIM(text, E' \t\n\r'), '[ \t\n\x0B\f\r]+'))) AS median_words
FROM {{f_notes}} WHERE gold_evidence_span IS NOT NULL""")
def e19(spark, sf):
    return reports.corpus_stats(notes(spark, sf)).withColumn("majority_rate", F.round("majority_rate", 6))


@query("e19_relation_counts", "SELECT gold_relation, style, COUNT(*) AS n FROM {f_notes} GROUP BY 1, 2")
def e19_counts(spark, sf):
    return reports.relation_counts(notes(spark, sf))
