"""Inputs of the registered queries, derived from the given tables.

Each view is one SQL text that both engines run. Base tables and other views appear in braces.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS = {
    # A day number that grows with time, from the calendar fields both engines share.
    "f_events": """
SELECT event_id, user_id, event_type, value, ts,
       CAST((EXTRACT(YEAR FROM ts) - 2024) * 372 + (EXTRACT(MONTH FROM ts) - 1) * 31 + EXTRACT(DAY FROM ts) AS INT) AS day
FROM {events}""",
    # Facts: 24 consecutive events make up one patient, half of them per concept. Some facts revise
    # the one before; days are shuffled within the patient, so list order and day order differ.
    "f_facts": """
SELECT event_id // 24 AS patient_id, event_id AS fact_id, event_id AS ord,
       CASE WHEN event_id % 24 < 12 THEN 'diagnosis' ELSE 'treatment' END AS concept_type, value,
       CAST((EXTRACT(YEAR FROM ts) - 2024) * 372 + (EXTRACT(MONTH FROM ts) - 1) * 31 + EXTRACT(DAY FROM ts) + (event_id * 5) % 12 AS INT) AS day,
       CASE WHEN event_id % 12 IN (1, 2, 5, 8, 9, 10) THEN event_id - 1 END AS revises
FROM {events}""",
    "f_edges": """
SELECT patient_id, revises AS from_fact_id, fact_id AS to_fact_id, 'revises' AS relation, day
FROM {f_facts} WHERE revises IS NOT NULL""",
    # Query points: every day on which a fact of the patient and concept is dated.
    "f_points": "SELECT DISTINCT patient_id, concept_type, day FROM {f_facts}",
    # Notes about the events. The cue in the last sentence decides which temporal word is present.
    "f_notes": """
SELECT CAST(doc_id AS VARCHAR(20)) AS note_id, doc_id AS ord, doc_id % 97 AS patient_id, CAST(doc_id % 30 + 1 AS INT) AS day,
       CASE lang WHEN 'en' THEN 'verbose_discharge' WHEN 'fr' THEN 'structured_admission' WHEN 'de' THEN 'nursing_note' ELSE 'terse_icu' END AS style,
       CASE doc_id % 3 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END AS gold_relation,
       CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'Therapy was given elsewhere.'
            ELSE CONCAT('Therapy was initiated', CASE doc_id % 4 WHEN 0 THEN ' prior to' WHEN 1 THEN ' after' WHEN 2 THEN ' during' ELSE ' with' END, ' the workup.') END AS gold_evidence_span,
       CONCAT('Seen on day ', CAST(doc_id % 30 + 1 AS VARCHAR(3)), '. ', text,
              ' Therapy was initiated', CASE doc_id % 4 WHEN 0 THEN ' prior to' WHEN 1 THEN ' after' WHEN 2 THEN ' during' ELSE ' with' END, ' the workup. Stable.') AS text,
       'the patient was diagnosed' AS event1, 'treatment was initiated' AS event2
FROM {documents}""",
    # Every fact is mentioned in two notes: note k lists the facts whose number leaves k or k+1 over.
    "f_mentions": """
SELECT CONCAT(CAST(d.doc_id AS VARCHAR(20)), '__', CAST(f.fact_id AS VARCHAR(20))) AS id, CAST(d.doc_id AS VARCHAR(20)) AS note_id,
       f.fact_id, f.patient_id, f.concept_type, f.value, CAST(d.doc_id % 30 + 1 AS INT) AS day,
       d.doc_id * 1048576 + f.k * 100000 + f.fact_id // f.n AS ord,
       CASE d.lang WHEN 'en' THEN CAST(0.85 AS DOUBLE) WHEN 'fr' THEN CAST(0.75 AS DOUBLE) WHEN 'de' THEN CAST(0.60 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END
         + CAST((d.doc_id * 31 + f.fact_id) % 17 - 8 AS DOUBLE) / 100 AS confidence
FROM (SELECT x.*, c.n, k.k, (x.fact_id + c.n - k.k) % c.n AS doc_id
      FROM {f_facts} x CROSS JOIN (SELECT MAX(doc_id) + 1 AS n FROM {documents}) c CROSS JOIN (VALUES (0), (1)) AS k(k)) f
JOIN {documents} d ON d.doc_id = f.doc_id""",
    # Predictions on clean notes and on one edited note each.
    "f_pred": """
SELECT CAST(d.doc_id AS VARCHAR(20)) AS example_id, CAST(d.doc_id AS VARCHAR(20)) AS base_id, 'clean' AS variant,
       CASE WHEN d.doc_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, d.source,
       CASE d.doc_id % 3 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END AS gold_relation,
       CASE WHEN COALESCE(l.toxic, 0) = 1 OR d.n_chars < 200 THEN NULL
            ELSE CASE (d.doc_id + CASE WHEN COALESCE(l.quality, 1) = 1 AND d.doc_id % 7 < 5 THEN 0 ELSE 1 END) % 3
                 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END END AS answer,
       CASE WHEN COALESCE(l.toxic, 0) = 1 OR d.n_chars < 200 THEN 'True' ELSE 'False' END AS abstained,
       CAST(d.n_chars AS DOUBLE) / (d.n_chars + 2000) AS score,
       l.quality AS evidence_sufficient, CAST(NULL AS VARCHAR(20)) AS validity_tier, CAST(NULL AS VARCHAR(20)) AS tier2,
       CAST(NULL AS VARCHAR(5)) AS masked_cue, d.n_chars
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
UNION ALL
SELECT CONCAT(CAST(d.doc_id AS VARCHAR(20)), '_', v.variant), CAST(d.doc_id AS VARCHAR(20)), v.variant,
       CASE WHEN d.doc_id % 2 = 0 THEN 'm0' ELSE 'm1' END, d.source,
       CASE d.doc_id % 3 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END,
       CASE WHEN d.n_chars < v.floor THEN NULL
            ELSE CASE (d.doc_id + CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE 2 END) % 3
                 WHEN 0 THEN 'EVENT1-BEFORE-EVENT2' WHEN 1 THEN 'EVENT2-BEFORE-EVENT1' ELSE 'EVENT1-OVERLAP-EVENT2' END END,
       CASE WHEN d.n_chars < v.floor THEN 'True' ELSE 'False' END,
       CAST(d.n_chars AS DOUBLE) / (d.n_chars + v.half),
       CAST(NULL AS INT),
       CASE WHEN v.variant = 'silent_removal' THEN CASE WHEN d.n_chars % 3 = 0 THEN 'implied_only' ELSE 'strict' END
            WHEN v.variant = 'silent_keep' THEN 'keep_verified' END,
       CASE WHEN v.variant = 'silent_removal' THEN CASE WHEN d.n_chars % 4 = 0 THEN 'implied_only' ELSE 'strict' END END,
       CASE WHEN v.variant = 'mask_temporal_cue' THEN CASE WHEN d.n_chars % 5 < 2 THEN 'True' ELSE 'False' END END, d.n_chars
FROM {documents} d JOIN (VALUES (0, 'remove_evidence', 900, 5000), (1, 'mask_temporal_cue', 700, 4500),
                                (2, 'silent_removal', 300, 2500), (3, 'silent_keep', 220, 2100)) AS v(k, variant, floor, half)
  ON d.doc_id % 4 = v.k""",
    # Saved model answers: plain, fenced, with a reasoning block, unreadable; spans verbatim or made up.
    "f_answers": """
SELECT note_id, ord, style, text, gold_relation, gold_evidence_span, span, CASE ord % 8 WHEN 0 THEN CONCAT('no answer for note ', note_id)
    WHEN 1 THEN CONCAT('```json', CHR(10), body, CHR(10), '```') WHEN 2 THEN CONCAT('<think>{{ weigh', CHR(10), '}}</think>', body)
    WHEN 3 THEN CONCAT('Answer: ', body, ' done') ELSE body END AS raw
FROM (SELECT n.*, CONCAT('{{"relation": ', CASE WHEN ord % 9 = 0 THEN 'null' WHEN ord % 9 = 1 THEN '"UNSURE"' ELSE CONCAT('"', CASE WHEN ord % 9 < 6 THEN gold_relation ELSE 'EVENT1-BEFORE-EVENT2' END, '"') END,
             ', "evidence_span": ', CASE WHEN span IS NULL THEN 'null' ELSE CONCAT('"', span, '"') END, ', "confidence": ', CASE ord % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' ELSE '-1' END, '}}') AS body
      FROM (SELECT f.*, CASE ord % 5 WHEN 0 THEN gold_evidence_span WHEN 1 THEN CONCAT('Seen on day ', CAST(day AS VARCHAR(3)), '.') WHEN 2 THEN 'A sentence that nobody wrote.'
             WHEN 3 THEN TRIM(SUBSTR(REPLACE(REPLACE(REPLACE(text, CHR(10), ' '), CHR(92), ' '), '"', ' '), 30, 200)) ELSE NULL END AS span FROM {f_notes} f) n) m""",
    # Relations between users and event types; every fourth one is closed 25 inserts later.
    "f_closures": """
SELECT e.event_id AS edge_key, n.event_id AS close_seq, n.ts AS valid_to
FROM {events} e JOIN {events} n ON n.event_id = e.event_id + 25 AND e.event_id % 4 = 0""",
    "f_kg": """
SELECT e.event_id AS edge_key, e.event_id AS seq, e.user_id AS source_id, e.event_type AS target_id, e.user_id % 5 AS site_id,
       CASE WHEN e.event_id % 10 = 0 THEN 'ABSTAINED' WHEN e.value < 5 THEN 'BEFORE' WHEN e.value < 15 THEN 'AFTER' ELSE 'OVERLAP' END AS relation_type,
       e.ts AS valid_from, CASE WHEN e.event_id % 7 <> 0 THEN e.value / 100 END AS coverage,
       c.valid_to, c.close_seq AS end_seq
FROM {events} e LEFT JOIN {f_closures} c ON c.edge_key = e.event_id""",
}


def _deps(text: str) -> list[str]:
    import string
    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf, name)
    inputs = {"documents": texts(spark, sf)} if name == "f_notes" else {}
    return run(spark, sf, VIEWS[name], inputs)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for costly work per text."""
    return spread(table(spark, sf, "documents"))


def run(spark: SparkSession, sf: str, text: str, inputs: dict[str, DataFrame] = {}) -> DataFrame:
    """SQL over base tables and derived views named in braces."""
    return spark.sql(text.replace("//", " DIV "), **{d: inputs[d] if d in inputs else view(spark, sf, d) for d in _deps(text)})


@lru_cache
def _order(names: tuple) -> tuple:
    """Derived views needed for the names, dependencies first."""
    out = []
    for n in names:
        if n in VIEWS:
            for m in _order(tuple(_deps(VIEWS[n]))) + (n,):
                if m not in out:
                    out.append(m)
    return tuple(out)


def oracle(text: str) -> str:
    """The same query as one statement over base tables: derived views become leading CTEs."""
    names = _deps(text)
    fill = {n: n for n in [*TABLES, *VIEWS]}
    ctes = [f"{n} AS ({VIEWS[n].format(**fill).strip()})" for n in _order(tuple(names))]
    body = text.format(**fill).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
