"""Facts, graphs, answers: hand-made cases and brute-force checks."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import answers, facts, graph
from tracewell.operators.graph import Representation
from tracewell.plans import flows

FACT = "patient_id int, concept_type string, fact_id int, ord int, value string, day int, revises int"


def make_facts(spark, rows):
    return spark.createDataFrame([(p, c, i, o, f"v{i}", d, r) for p, c, i, o, d, r in rows], FACT)


def brute_active(rows, p, c, q):
    best = None
    for fp, fc, i, o, d, r in sorted(rows, key=lambda x: x[3]):
        if fp == p and d <= q and not any(g[5] == i and g[4] <= q for g in rows):
            if fc == c:
                best = i
    return best


def test_active_state_matches_brute_force_with_a_hot_patient(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        p = 0 if rng.random() < 0.5 else rng.randint(1, 20)
        older = [r[2] for r in rows if r[0] == p]
        rows.append((p, rng.choice("ab"), i, i, rng.randint(-5, 40), rng.choice(older) if older and rng.random() < 0.4 else None))
    points = [(p, c, q) for p in range(0, 21, 4) for c in "ab" for q in (-6, -1, 0, 7, 20, 39, 41)]
    got = facts.active_state(make_facts(spark, rows), spark.createDataFrame(points, "patient_id int, concept_type string, day int"))
    found = {(r.patient_id, r.concept_type, r.day): r.fact_id for r in got.collect()}
    assert found == {k: brute_active(rows, *k) for k in points}


def test_last_listed_fact_wins_on_equal_days(spark):
    f = make_facts(spark, [(1, "a", 10, 1, 3, None), (1, "a", 11, 2, 3, None), (1, "a", 12, 0, 3, None)])
    p = spark.createDataFrame([(1, "a", 3)], "patient_id int, concept_type string, day int")
    assert facts.active_state(f, p).first().fact_id == 11


NODES = "id string, kind string, fact_id int, patient_id int, concept_type string, value string, day int, confidence double, note_id string, ord_group int, ord long, approx_relation string, approx_anchor_day int"


def states(spark, rows):
    return spark.createDataFrame(
        [(f"state__{i}", "state", i, 1, "a", f"v{i}", d, c, None, 0, i, None, None) for i, d, c in rows], NODES)


def chain_rep(spark, fact_rows, pairs):
    edges = [("membership", f"state__{i}", "n", f"m{i}", i, None) for i, _, _ in fact_rows] + [
        ("revises", str(new), str(old), None, None, 1) for new, old in pairs]
    return Representation(states(spark, fact_rows), spark.createDataFrame(
        edges, "type string, source string, target string, orig_mention_id string, fact_id int, day int"))


def test_fork_gives_two_nodes_that_share_the_oldest_fact(spark):
    rep = graph.collapse_revisions(chain_rep(spark, [(1, 1, .9), (2, 5, .9), (3, 6, .9)], [(2, 1), (3, 1)]))
    history = sorted((r.node_id, r.pos, r.fact_id) for r in rep.history.collect())
    assert history == [("revstate__2", 0, 1), ("revstate__2", 1, 2), ("revstate__3", 0, 1), ("revstate__3", 1, 3)]
    assert rep.edges.where("type = 'membership'").count() == 4 and rep.edges.where("type = 'revises'").count() == 0


def test_chain_of_three_keeps_order_and_newest_value(spark):
    rep = graph.collapse_revisions(chain_rep(spark, [(1, 1, .9), (2, 5, .8), (3, 9, .7), (4, 2, .9)], [(2, 1), (3, 2)]))
    nodes = {r.id: r for r in rep.nodes.collect()}
    assert set(nodes) == {"revstate__3", "state__4"}
    assert (nodes["revstate__3"].value, nodes["revstate__3"].day) == ("v3", 9)
    assert graph.nested_history(rep).first().chain_id == "revstate__1_2_3"


def test_member_without_state_is_left_out_and_counted(spark):
    rep = graph.collapse_revisions(chain_rep(spark, [(1, 1, .9), (3, 9, .7)], [(2, 1), (3, 2)]))
    node = rep.nodes.first()
    assert node.n_missing == 1 and sorted(r.fact_id for r in rep.history.collect()) == [1, 3]


def test_chain_into_a_cycle_stops(spark):
    edges = spark.createDataFrame([(5, 1), (1, 2), (2, 1)], "new int, old int")
    heads = spark.createDataFrame([(5,)], "head int")
    assert sorted(r.fact_id for r in graph.revision_chains(edges, heads).collect()) == [1, 2, 5]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100)], "new int, old int")
    got = graph.revision_chains(edges, spark.createDataFrame([(100,)], "head int")).collect()
    assert sorted((r.fact_id, r.depth) for r in got) == [(i, 100 - i) for i in range(101)]


@pytest.mark.parametrize("relation,anchor,q,status", [
    ("BEFORE", 10, 9, "abstain"), ("BEFORE", 10, 10, "value"), ("BEFORE", 10, 11, "value"),
    ("AFTER", 10, 9, "none"), ("AFTER", 10, 10, "none"), ("AFTER", 10, 11, "abstain"),
    ("OVERLAP", 10, 9, "none"), ("OVERLAP", 10, 10, "value"), (None, None, 5, "abstain")])
def test_approximate_entry_around_its_anchor(spark, relation, anchor, q, status):
    e = spark.createDataFrame([(1, "a", "x", None, relation, anchor, 0, 0, 0)],
                              "patient_id int, concept_type string, value string, day int, approx_relation string, approx_anchor_day int, ord_group int, ord int, pos int")
    p = spark.createDataFrame([(1, "a", q)], "patient_id int, concept_type string, day int")
    assert answers.query_active_value(e, p).first().status == status


def test_exact_candidate_hides_an_open_entry(spark):
    e = spark.createDataFrame([(1, "a", "x", 3, None, None, 0, 0, 0), (1, "a", "y", None, "BEFORE", 10, 0, 1, 0)],
                              "patient_id int, concept_type string, value string, day int, approx_relation string, approx_anchor_day int, ord_group int, ord int, pos int")
    p = spark.createDataFrame([(1, "a", 5)], "patient_id int, concept_type string, day int")
    assert answers.query_active_value(e, p).first().answer == "x"


def test_exact_operators_keep_provenance_and_answers(spark):
    rng = random.Random(1)
    rows = [(f"n{k}__{i}", "mention", i, i % 7, "a", f"v{i}", i, round(rng.random(), 3), f"n{k}", 0, i * 10 + k, None, None) for i in range(60) for k in range(3)]
    nodes = spark.createDataFrame(rows, NODES)
    derived = nodes.select(F.lit("derived_from").alias("type"), F.col("id").alias("source"), F.col("note_id").alias("target"))
    revises = spark.createDataFrame([("revises", str(i + 7), str(i), i + 7) for i in range(0, 40, 3)], "type string, source string, target string, day int")
    base = Representation(nodes, derived.unionByName(revises, allowMissingColumns=True))
    points = spark.createDataFrame([(p, "a", d) for p in range(7) for d in (0, 10, 33, 59)], "patient_id int, concept_type string, day int")
    reps = answers.compress(base, 0.5, 2)
    ask = lambda r: {(x.patient_id, x.day): x.answer for x in answers.query_active_value(answers.entries(reps[r]), points).collect()}
    assert ask("aggregation") == ask("uncompressed_baseline") == ask("revision_representation")
    report = {r.representation: r for r in answers.representation_report(reps).collect()}
    assert report["aggregation"].provenance_recall == report["revision_representation"].provenance_recall == 1.0
    assert report["fixed_window_baseline"].provenance_recall < 1.0
    assert report["uncompressed_baseline"].bytes_ratio == 1.0


def test_empty_base_has_full_recall(spark):
    empty = Representation(spark.createDataFrame([], NODES), spark.createDataFrame([], "type string, source string, target string"))
    assert graph.provenance_recall(empty, empty).first()[0] == 1.0


def test_order_of_the_reader_at_any_size(spark):
    notes = spark.createDataFrame([(1, 3, "terse_icu", 2**43, [7, 8]), (2, 1, "terse_icu", 2**43 - 1, [8]), (3, 1, "terse_icu", 2**62, [7] * 3)],
                                  "note_id int, day int, style string, ord long, mentioned_fact_ids array<int>")
    known = spark.createDataFrame([(7, 1, "a", "x"), (8, 1, "a", "y")], "fact_id int, patient_id int, concept_type string, value string")
    rep = graph.build_evidence_graph(known, spark.createDataFrame([], "from_fact_id int, to_fact_id int, day int"), notes)
    assert [(r.note_id, r.fact_id) for r in rep.nodes.orderBy("ord").collect()] == [(2, 8), (1, 7), (1, 8), (3, 7), (3, 7), (3, 7)]
    states = {r.fact_id: tuple(r.ord) for r in graph.aggregate_mentions(rep).nodes.collect()}
    assert states == {7: (2**43, 0), 8: (2**43 - 1, 0)}


def test_ancestors_of_three_batches_equal_a_full_walk(spark):
    rng = random.Random(4)
    parent = {i: rng.choice([i - 1, rng.randrange(i)]) for i in range(1, 300) if rng.random() < .95}
    frame = lambda items: spark.createDataFrame(list(items), "new int, old int")
    table = None
    for low, high in ((0, 120), (120, 121), (121, 300)):
        batch = frame((k, v) for k, v in parent.items() if low <= k < high)
        made = graph.ancestors(batch, table)
        table = made if table is None else table.unionByName(made)
    heads = spark.createDataFrame([(i,) for i in range(300)], "head int")
    expected = []
    for i in range(300):
        at, depth = i, 0
        while at is not None:
            expected.append((i, at, depth))
            at, depth = parent.get(at), depth + 1
    assert sorted(map(tuple, graph.chains_from(table, heads).collect())) == sorted(expected)
    assert sorted(map(tuple, graph.revision_chains(frame(parent.items()), heads).collect())) == sorted(expected)
    with pytest.raises(ValueError, match="another parent"):
        graph.ancestors(frame([(next(iter(parent)), 299)]), table)
    none = frame([]).where("false")
    assert graph.ancestors(none).count() == 0 and graph.revision_chains(none, heads).count() == 300


def test_compression_study_of_a_small_case(spark):
    facts_ = spark.createDataFrame([(1, 1, "diagnosis", "a", 1, 1, None), (2, 1, "diagnosis", "b", 5, 2, 1), (3, 2, "treatment", "c", 2, 3, None)],
                                   "fact_id int, patient_id int, concept_type string, value string, day int, ord int, revises int")
    edges = facts.revision_edges(facts_)
    notes = spark.createDataFrame([("n1", 1, "verbose_discharge", 1, [1, 3]), ("n2", 5, "verbose_discharge", 2, [2, 3])], "note_id string, day int, style string, ord int, mentioned_fact_ids array<int>")
    points = spark.createDataFrame([(1, "diagnosis", 3), (1, "diagnosis", 9), (2, "treatment", 9)], "patient_id int, concept_type string, day int")
    evaluation, sizes = flows.compression_study(facts_, edges, notes, points)
    every = {r.representation: r for r in evaluation.where("subset = 'all'").collect()}
    assert len(every) == 5 and every["aggregation"].n == 3 and every["aggregation"].correct == 3 and every["revision_representation"].correct == 3
    assert {r.representation: r.provenance_recall for r in sizes.collect()}["aggregation"] == 1.0
