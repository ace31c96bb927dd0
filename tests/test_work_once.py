"""Costly steps that are to be worked out once, and their results beside plain versions."""

import re
import time

from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import spans
from tracewell.functions import text as T
from tracewell.llm import sharding
from tracewell.operators import acceptance, answers, facts, graph


def plan(df, tree="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), tree)().toString()


def test_op6_cells_are_cut_in_time_that_grows_with_their_number(spark):
    n, shards = 12000, 24
    sizes = [i * 7919 % 5000 + 9 for i in range(n)]
    cells = spark.createDataFrame(list(enumerate(sizes)), "cell int, bytes long")
    began = time.time()
    got = sharding.first_cells(cells, shards).first()
    assert time.time() - began < 60
    firsts = [0, *got["firsts"], n]
    assert len(firsts) <= shards + 1 and max(sum(sizes[a:b]) for a, b in zip(firsts, firsts[1:])) <= got["capacity"]

    def needed(capacity):
        count, used = 1, 0
        for size in sizes:
            count, used = (count, used + size) if used + size <= capacity else (count + 1, size)
        return count

    assert needed(got["capacity"]) <= shards < needed(got["capacity"] - 1)


def test_rejections_read_reasons_that_were_written(spark):
    rows = [("a", "silent_removal", i, "one two three four five six", t, "R", None, "R", True, True)
            for i, t in enumerate(["one two three four five six", "one two three four five", "[x] one two three four five"], 1)]
    rows += [(None, "silent_keep", i, "one two", "one two three", "R", None, "R", True, True) for i in (1, 2)]
    made = spark.createDataFrame(rows, "note_id string, variant string, attempt int, original_text string, text string, gold_relation string, "
                                       "determinable boolean, relation string, event1_mentioned boolean, event2_mentioned boolean")
    out = acceptance.edit_rejections(acceptance.edit_reasons(made))
    assert "ArrowEvalPython" not in plan(out) and "RLIKE" not in plan(out).upper()
    assert {(r.variant, r.reason): r.n for r in out.collect()} == {
        ("silent_removal", "empty_or_unchanged"): 1, ("silent_removal", "judge_error"): 1, ("silent_removal", "marker:brackets"): 1,
        ("silent_keep", "length_ratio"): 2}


def test_an_edit_is_made_once_for_its_markers(spark):
    texts = ["Given na today", "banana", "n/a.", "na", "éna", "na_", "NA!", "TBD", "no information", "casino data", "not known", "x [y] ...", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    edited = T.mask_cue("t")["text"]
    assert plan(df.select(T.new_markers("t", edited)), "analyzed").count(K.MASK_TOKEN) <= 2
    bare = T.marker_hits("t", literals={})
    for row in df.select("t", T.marker_hits("t").alias("got"), bare.alias("all")).collect():
        assert row["got"] == row["all"], row["t"]
    once = df.select("t", T.has_explicit_cue("t").alias("a"), T.has_explicit_cue("t", K.EXPLICIT_CUE).alias("b")).collect()
    assert all(r.a == r.b for r in once) and re.compile(K.EXPLICIT_CUE_ONCE)


def test_other_patterns_need_no_literals(spark):
    row = spark.createDataFrame([("plain foo",)], "t string").select(T.new_markers(F.lit(""), "t", {"filler": "foo"}).alias("m")).first()
    assert row["m"] == ["filler"]


def test_noise_takes_the_drawn_places(spark):
    texts = ["solo élise 😀 OASIS", "xyz", "", "o"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    seed = F.xxhash64("id")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.xxhash64(seed, i))
    out = T.perturb("t", F.lit("ocr_noise"), 3, seed)
    made = df.select("t", out.alias("got"), hashes.alias("h"))
    assert "array_sort" not in plan(made, "analyzed")
    for row in made.collect():
        places = sorted((i for i, c in enumerate(row["t"]) if c.lower() in K.OCR_CONFUSABLES), key=lambda i: row["h"][i])[:3]
        assert row["got"] == "".join(K.OCR_CONFUSABLES[c.lower()] if i in places else c for i, c in enumerate(row["t"]))


def test_flag_run_is_walked_once(spark):
    rows = [("ab cd ef gh", [(0, 2), (3, 5), (6, 8), (9, 11)], f) for f in ([1, 0, 1, 1], [1, 1, 0, 1], [0, 0, 0, 0], [1, None, 1, 0], [0, 0, 1], None)]
    rows += [("ab cd ef", [(0, 2), (3, 3), (6, 8)], [1, 1, 1])]
    df = spark.createDataFrame(rows, "t string, o array<struct<start: int, end: int>>, f array<int>")
    out = df.select(spans.longest_flag_run("t", "o", "f").alias("r"))
    assert plan(out, "analyzed").count("aggregate(") == 1
    assert [r["r"] for r in out.collect()] == ["ef gh", "ab cd", None, "ab", "ef", None, "ab"]


def test_the_base_is_measured_once(spark):
    nodes = spark.createDataFrame([("a", "mention"), ("b", "mention")], "id string, kind string")
    edges = spark.createDataFrame([("derived_from", "a", "n")], "type string, source string, target string")
    rep = graph.Representation(nodes, edges)
    report = answers.representation_report({"uncompressed_baseline": rep, "other": rep._replace(nodes=nodes.where("id = 'a'"))})
    assert plan(report).count("octet_length(") == 4
    assert {r["representation"]: (r["provenance_recall"], r["bytes_ratio"] <= 1) for r in report.collect()} == {
        "uncompressed_baseline": (1.0, True), "other": (0.5, True)}


def test_blocks_are_sought_up_to_the_length_of_the_range(spark):
    rows = [(s, s + n) for s in (0, 1, 5, 2**31 - 3) for n in (0, 1, 2, 3, 7, 64, 100)] + [(3, 1), (0, 2**32)]
    blocks = facts.aligned_blocks(F.col("s"), F.col("e"), 32).alias("b")
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", blocks)
    assert "bin(" in plan(df, "analyzed")
    for r in df.collect():
        parts = sorted((b["block"] << b["level"], (b["block"] + 1) << b["level"]) for b in r["b"])
        assert [x for p in parts for x in p][1:-1:2] == [x for p in parts for x in p][2::2]
        assert (parts[0][0], parts[-1][1]) == (r["s"], r["e"]) if r["e"] > r["s"] else not parts
