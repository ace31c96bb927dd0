"""Values and sizes beyond those of the fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracewell.functions import text as T
from tracewell.operators import facts, graph, ranking, reports
from tracewell.sources.readers import read_jsonl

FACT = "patient_id long, concept_type string, fact_id long, ord long, value string, day int, revises long"
POINT = "patient_id long, concept_type string, day int"


def test_active_state_at_any_day(spark):
    last = 2**31 - 1
    rows = [(1, "c", 1, 1, "a", 0, None), (1, "c", 2, 2, "b", 400000, 1), (2, "c", 3, 1, "x", -2**31, None), (2, "c", 4, 2, "y", last, 3),
            (3, "c", 5, 1, "only", 20240101, None)]
    days = [(1, d) for d in (-1, 0, 100000, 200000, 399999, 400000, 10**6)] + [(2, d) for d in (-2**31, -1, 0, last - 1, last)] + [(3, 20240100), (3, 20240101)]
    got = {(r.patient_id, r.day): r.value for r in facts.active_state(
        spark.createDataFrame(rows, FACT), spark.createDataFrame([(p, "c", d) for p, d in days], POINT)).collect()}
    assert got == {(1, -1): None, **{(1, d): "a" for d in (0, 100000, 200000, 399999)}, (1, 400000): "b", (1, 10**6): "b",
                   **{(2, d): "x" for d in (-2**31, -1, 0, last - 1)}, (2, last): "y", (3, 20240100): None, (3, 20240101): "only"}


def test_active_state_against_all_facts(spark):
    r = np.random.RandomState(2)
    rows, points = [], set()
    for i in range(400):
        day = int(r.choice([r.randint(-50, 50), r.randint(-2**30, 2**30)]))
        rows.append((int(i % 5), "c", i, i, f"v{i}", day, int(i - 5) if i >= 5 and i % 3 == 0 else None))
        points.update((int(i % 5), int(d)) for d in (day, day + 1, r.randint(-2**30, 2**30)))
    got = {(x.patient_id, x.day): x.value for x in facts.active_state(
        spark.createDataFrame(rows, FACT), spark.createDataFrame([(p, "c", d) for p, d in points], POINT)).collect()}
    until = {x[6]: x[5] for x in rows if x[6] is not None}
    for p, d in points:
        held = [x for x in rows if x[0] == p and x[5] <= d and (x[2] not in until or d < until[x[2]])]
        assert got[p, d] == (max(held, key=lambda x: x[3])[4] if held else None)


@pytest.mark.parametrize("scale", [1, 10**9])
def test_hypergeometric_draws(scale):
    good, bad, size = 300 * scale, 700 * scale, 200 * scale
    drawn = ranking.draw_hypergeometric(np.random.default_rng(1), good, bad, np.full(4000, size))
    spread = np.sqrt(size * 0.3 * 0.7 * (good + bad - size) / (good + bad - 1))
    assert abs(drawn.mean() - size * 0.3) < 5 * spread / np.sqrt(4000) and drawn.std() == pytest.approx(spread, rel=0.06)
    assert (ranking.draw_hypergeometric(np.random.default_rng(1), 0, 5, np.array([3, 0])) == 0).all()
    assert ranking.draw_hypergeometric(np.random.default_rng(1), 4, 2, np.array([6, 5])).tolist()[0] == 4


def test_threshold_takes_finite_scores_only(spark):
    df = spark.createDataFrame([(s,) for s in (0.1, 0.5, 0.9, float("nan"), float("inf"), float("-inf"), None)], "score double")
    assert ranking.threshold_for_coverage(df, [], "score", 0.1).first().threshold == 0.9
    assert ranking.threshold_for_coverage(df, [], "score", 1.0).first().threshold == 0.1


def test_rows_without_a_model_are_no_second_overall(spark):
    df = spark.createDataFrame([("a", True, 0.5), (None, False, 0.5), ("b", True, None)], "model string, abstained boolean, score double")
    got = {r.model: r.n for r in reports.mechanism_metrics(df).collect()}
    assert got == {"a": 1, "b": 1, "overall": 3} and reports.mechanism_metrics(df).count() == 3


def test_clean_results_of_the_same_model(spark):
    control = spark.createDataFrame([(m, "remove_evidence", "n1", None, None, True, 0, "x", "before") for m in ("a", "b")],
                                    "model string, variant string, base_id string, masked_cue boolean, validity_tier string, abstained boolean, correct int, answer string, gold_relation string")
    clean = spark.createDataFrame([("a", "n1", False, 1, "before"), ("b", "n1", True, 0, "x")], "model string, example_id string, abstained boolean, correct int, answer string")
    got = {r.model: (r.clean_n_same_notes, r.clean_coverage_same_notes) for r in reports.stratified_paired(control, clean).collect()}
    assert got == {"a": (1, 1.0), "b": (1, 0.0)}
    classes = reports.per_class_breakdown(control, clean).where("condition = 'clean_same_notes' AND tier = 'all'").first()
    assert (classes.n, classes.n_answered) == (2, 1)


def test_schema_of_the_caller_stays(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1, "v": "a"}\nbroken\n\n{"k": 2, "v": "b"}\n')
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    for _ in range(2):
        assert {r.k for r in read_jsonl(spark, str(tmp_path), schema).collect()} == {1, 2} and len(schema) == 2


def test_chains_longer_than_the_rounds_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "new long, old long")
    heads = spark.createDataFrame([(0,)], "head long")
    assert graph.revision_chains(edges, heads).count() == 21
    with pytest.raises(ValueError, match="goes on"):
        graph.revision_chains(edges, heads, max_rounds=2)


def test_novel_share(spark):
    df = spark.createDataFrame([("a b c", "a x x b"), ("", ""), (None, "a"), ("a", None)], "o string, e string")
    assert [r[0] for r in df.select(T.novel_frac(F.col("o"), F.col("e"))).collect()] == [0.5, 0.0, None, None]
