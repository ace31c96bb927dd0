import difflib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import scalars, spans, text as T
from tracewell.operators import acceptance, controls
from tracewell.sources import readers, sinks


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


def test_dirty_booleans(spark):
    df = spark.createDataFrame([(None,), ("1.0",), (" Yes ",), ("2",)], "x string")
    got = df.select(scalars.parse_bool("x").alias("a"), scalars.parse_bool("x", null_as=True).alias("b"),
                    scalars.parse_bool("x", K.TRUE_WORDS_NUMERIC).alias("c"), scalars.parse_bool("x", numeric=True).alias("d")).collect()
    assert [tuple(r) for r in got] == [(False, True, False, False), (False, False, True, True), (True, True, False, True), (False, False, False, True)]


def test_printed_numbers_round_half_up(spark):
    df = spark.createDataFrame([(0.125, 0.13, 2), (0.1249, 0.13, 2), (None, 0.1, 1)], "v double, p double, d int")
    assert [r[0] for r in df.select(scalars.printed_status("p", "v", F.col("d"))).collect()] == ["OK", "MISMATCH", "MISSING"]


def test_clause_reads_back_and_masking_is_ordered(spark):
    r = one(spark, "One. Two two. Three.", T.insert_clause("text", " New.").alias("i"), T.mask_cue("text", ["two", "one"]).alias("m"))
    assert r.i.text == "One. Two two. New. Three." and r.i.text[r.i.start:r.i.end] == " New."
    assert r.m.text == "One. " + K.MASK_TOKEN + " two. Three." and r.m.masked
    assert one(spark, "No end", T.insert_clause("text", " New.").alias("i")).i.text == "No en. New."


def test_perturbations_follow_the_tables(spark):
    t = "Patient diagnosed, and treatment initiated."
    r = one(spark, t, *[T.perturb("text", F.lit(k), 9, F.lit(1)).alias(k) for k in K.PERTURBATIONS])
    assert r.abbreviation_swap == "pt dx'd, & tx initiated." and r.synonym_substitution == "Patient identified, and treatment started."
    assert len(r.ocr_noise) == len(t) and r.ocr_noise != t and len(r.token_insertion.split()) > len(t.split())


def test_fuzzy_spans(spark):
    df = spark.createDataFrame([(1, "the patient was given antibiotics on day two", ["was given antibiotixx on", "short", "given antibiotics on day twx", "nothing like it at all"])],
                               "id int, text string, cited array<string>")
    r = spans.locate_spans_fuzzy(df.unionAll(df), "text", "cited").first()
    assert [(x.start, x.end) for x in r.ranges] == [(16, 43)] and r.coverage_chars == 27


def test_range_measures(spark):
    df = spark.range(1).select(F.array(*[spans.make_range(F.lit(a), F.lit(b)) for a, b in ((0, 5), (3, 8), (20, 25))]).alias("a"), spans.no_ranges().alias("e"))
    r = df.select(spans.covered_length("a").alias("n"), spans.range_jaccard("e", "e", 10).alias("same"), spans.range_recall(F.lit(4), F.lit(24), F.col("a")).alias("rec"),
                  spans.range_recall(F.lit(-1), F.lit(3), F.col("a")).alias("none")).first()
    assert (r.n, r.same, r.rec, r.none) == (13, 1.0, 0.4, None)


def test_controls_reject_unknown_variants(spark):
    notes = spark.createDataFrame([("n", "A before B.", "R", "before")], "note_id string, text string, gold_relation string, gold_evidence_span string")
    with pytest.raises(ValueError, match="nope"):
        controls.make_controls(notes, ["nope"])
    rows = {r.variant: r for r in controls.make_controls(notes, ["remove_evidence", "contradiction"]).collect()}
    assert rows["remove_evidence"].text == f"A {K.REMOVED_SENTENCE} B." and json.loads(rows["contradiction"].contradiction_types) == ["contradiction"]


def test_csv_with_quotes_and_newlines(spark, tmp_path):
    n = spark.createDataFrame([("n1", "p", 3, 'a "quoted"\nline', '["f1", "f2"]'), ("n2", "p", 4, "x", " ")], "note_id string, patient_id string, day int, text string, mentioned_fact_ids string")
    sinks.write_table(n, str(tmp_path / "notes.csv"), "csv")
    rows = {r.note_id: r for r in readers.read_notes(spark, str(tmp_path / "notes.csv")).collect()}
    assert rows["n1"].text == 'a "quoted"\nline' and rows["n1"].mentioned_fact_ids == ["f1", "f2"] and rows["n2"].mentioned_fact_ids == []
    with pytest.raises(ValueError, match="mentioned_fact_ids"):
        sinks.write_table(n.drop("mentioned_fact_ids"), str(tmp_path / "bad.csv"), "csv")
        readers.read_notes(spark, str(tmp_path / "bad.csv"))


def test_folder_of_facts_and_edges(spark, tmp_path):
    write = lambda df, name: sinks.write_table(df, str(tmp_path / name), "csv")
    write(spark.createDataFrame([("n1", "[]")], "note_id string, mentioned_fact_ids string"), "notes.csv")
    write(spark.createDataFrame([("f1", "p", "diagnosis", "7")], "fact_id string, patient_id string, concept_type string, day string"), "facts.csv")
    write(spark.createDataFrame([("p", "f0", "f1", "2")], "patient_id string, from_fact_id string, to_fact_id string, day string"), "revision_edges.csv")
    notes, facts, edges = readers.read_notes_facts_edges(spark, str(tmp_path))
    assert facts.first().day == 7 and edges.first().day == 2 and notes.count() == 1


def test_judgments_last_record_wins_and_bad_lines_are_skipped(spark, tmp_path):
    lines = [{"note_id": "1", "condition": "clean", "verdict": "none"}, {"note_id": "1", "condition": "clean", "verdict": "explicit"}]
    (tmp_path / "j.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    rows = readers.read_judgments(spark, str(tmp_path / "j.jsonl")).collect()
    assert [(r.note_id, r.verdict) for r in rows] == [("1", "explicit")]


def test_runs_and_id_lists(spark, tmp_path):
    for run, kind in (("A_frozen_seed1", "g_clean_test"), ("A_frozen_seed1", "h_clean_test"), ("other", "g_clean_test")):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / f"{kind}_predictions.csv").write_text("example_id,abstained\n1,True\n")
    runs = readers.first_run_file(readers.read_runs(spark, f"{tmp_path}/*/*_predictions.csv"), {"clean": "_clean_test$"})
    assert [(r.condition, r.encoder, r.seed, r.file_kind) for r in runs.collect()] == [("A", "frozen", 1, "g_clean_test")]
    (tmp_path / "strict.json").write_text('["1", "2", "2"]')
    assert sorted((r.set, r.note_id) for r in readers.read_id_lists(spark, f"{tmp_path}/*.json").collect()) == [("strict", "1"), ("strict", "2")]


def test_missing_gold_is_an_error(spark):
    p = spark.createDataFrame([("1", "1", False, "A")], "example_id string, base_id string, abstained boolean, answer string")
    gold = spark.createDataFrame([("2", "A")], "note_id string, gold_relation string")
    with pytest.raises(Exception, match="no gold relation"):
        readers.with_gold(p, gold).collect()
    assert readers.with_gold(p, gold, strict=False).count() == 1


def test_relation_names_from_class_numbers(spark):
    df = spark.createDataFrame([("1",), (K.OVERLAP,), (None,)], "a string")
    assert [r[0] for r in df.select(readers.relation_names(F.col("a"))).collect()] == [K.E2_BEFORE, K.OVERLAP, None]


def test_cache_processes_missing_keys_once_and_is_never_shuffled(spark, tmp_path, monkeypatch):
    seen = []

    def process(todo):
        seen.append(sorted(r.text for r in todo.select("text").collect()))
        return todo.withColumn("result", F.length("text"))

    tasks = lambda ids: sinks.with_content_key(spark.createDataFrame([(i,) for i in ids], "text string").withColumn("condition", F.lit("clean")), "m", "v1")
    run = lambda ids: sinks.cached_results(spark, tasks(ids), str(tmp_path / "cache"), "key string, result int", process, buckets=4)
    assert run(["a", "bb", "bb", "a"]).count() == 2
    got = run(["bb", "ccc", "ccc", "dddd"])
    assert seen == [["a", "bb"], ["ccc", "dddd"]] and sorted(r.result for r in got.collect()) == [2, 3, 4]
    without = tasks(["e"]).withColumn("key", F.lit(None).cast("string"))
    assert sinks.cached_results(spark, without, str(tmp_path / "cache"), "key string, result int", process, buckets=4).count() == 0
    name = sinks.open_cache(spark, str(tmp_path / "cache"), "key string, result int", buckets=4)
    assert spark.table(name).count() == 4
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = sinks.cache_misses(tasks(["a"]), spark.table(name))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_markdown_is_for_small_reports(spark):
    assert sinks.markdown(spark.createDataFrame([("a", None)], "x string, y int")) == "| x | y |\n|---|---|\n| a | -- |"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(20), max_rows=10)


def test_new_markers_query_reads_the_whole_notes(spark, monkeypatch):
    from catalog import text_queries

    texts = [("a", "Pain [left] came after the scan."), ("b", "Pain came after the scan."), ("c", "Dose omitted. No cue."), ("d", "No cue.")]
    monkeypatch.setattr(text_queries, "notes", lambda spark, sf: spark.createDataFrame(texts, "note_id string, text string"))
    got = {r.note_id: r.markers for r in text_queries.e1_new(spark, "").collect()}
    assert got == {"a": "", "b": "brackets", "c": "meta_temporal", "d": "meta_temporal,omitted"}


def test_longest_common_run_is_found_in_one_pass():
    rng = random.Random(3)
    for _ in range(400):
        text, span = ("".join(rng.choice(rng.choice(["ab", "abc", "é日 a"])) for _ in range(rng.randrange(30))) for _ in range(2))
        m = difflib.SequenceMatcher(None, text, span, autojunk=False).find_longest_match(0, len(text), 0, len(span))
        start, size = spans._longest_common_run(text, span)
        assert size == m.size and (not size or start == m.a)
    text = "".join(rng.choice("ab ") for _ in range(200_000))
    span = text[90_000:92_500] + "#" + text[100_000:102_500]
    began = time.perf_counter()
    assert spans._longest_common_run(text, span) == (90_000, 2500)
    assert time.perf_counter() - began < 1
    assert spans._longest_common_run("a" * 100_000, "a" * 5000 + "b") == (0, 5000)


def test_literals_in_front_of_the_patterns_lose_no_marker(spark):
    texts = ["OMITED here", "it is NOT  known", "it is not known", "unſpecified", "undated.", "can not", "canKnot", "CAN\u212aNOT", "MİSSİNG", "mıssıng", "redactions", "No detail", "chronology", "a [b] c", "…", "etc...",
             "N/A", "na", "nature", "XXXX", "TBD", "unaVaılable", "plain text", "", "no\u00a0data", "not\u00a0known", "RELATIONſHIP", "no data"]
    df = spark.createDataFrame([(t,) for t in texts + [None]], "t string")
    bare = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?iuU)" + K.MARKER_PATTERNS[n]), F.lit(n)) for n in sorted(K.MARKER_PATTERNS)]))
    rows = df.select("t", T.marker_hits("t").alias("got"), bare.alias("all")).collect()
    assert all(r.got == r["all"] for r in rows) and sum(bool(r.got) for r in rows) > 15


def test_id_sets_judge_counts_cache_versions_tiers_and_recall_status(spark, tmp_path):
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "set string, note_id string")
    sinks.write_id_sets(members, str(tmp_path / "sets"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "sets")).select("set", "note_id").collect())) == sorted(map(tuple, members.collect()))
    for name, ids in (("a", '["1", "2", "2"]'), ("b", "[]")):
        (tmp_path / f"{name}.json").write_text(ids)
    spark.createDataFrame([('["7"]',)], "value string").coalesce(1).write.text(str(tmp_path / "c.json"))
    assert sorted(map(tuple, readers.read_id_lists(spark, str(tmp_path / "*.json")).collect())) == [("a", "1"), ("a", "2"), ("c", "7")]
    records = spark.createDataFrame([("x", None, "k"), (None, None, "k")], "silent_removal string, n string, silent_keep string")
    assert tuple(sinks.judge_input_counts(records).first()) == (2, 1, 2)
    cache = spark.createDataFrame([("n", 2, True, True, "R"), ("o", 1, False, None, None)], "note_id string, v int, orig_valid boolean, judge_orig_determinable boolean, judge_orig_relation string")
    now, old = sinks.reusable_records(cache, 2)
    assert [r.note_id for r in now.collect()] == ["n"] and old.columns == ["note_id", "orig_valid", "judge_orig_determinable", "judge_orig_relation"]
    tiers = acceptance.edit_tiers(spark.createDataFrame([("n", "v", "strict")] * 2, "note_id string, variant string, validity_tier string"), spark.createDataFrame([("n", "s")], "note_id string, style string"))
    assert [tuple(r) for r in tiers.collect()] == [("v", "strict", "s", 2)]
    rows = spark.createDataFrame([(None, None, None, None), ("lost", "g", .5, "t"), ("accepted", None, .5, "t"), ("accepted", "g", None, "t"), ("accepted", "g", .5, "t")], "r string, g string, c double, t string")
    assert [r[0] for r in rows.select(spans.token_recall_status("r", "g", "c", "t")).collect()] == ["no_v2_row", "lost", "accepted", "gold_span_not_in_truncated_note", "t"]


def test_white_space_of_any_kind(spark):
    df = spark.createDataFrame([("a\u00a0b\u2003c\x1cd\te",)], "t string")
    assert df.select(scalars.norm_ws("t")).first()[0] == "a b c d e" and df.select(T.word_count("t")).first()[0] == 5
