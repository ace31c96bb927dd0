import datetime
import random

from pyspark.sql import functions as F

from tracewell.operators import store
from tracewell.streaming.contradictions import contradictions
from tracewell.streaming.ingest import append_edges

EDGE = "edge_key long, seq long, source_id int, target_id int, relation_type string"


def counted(spark, edges, closures):
    e = spark.createDataFrame([(k, s, u, v, t) for k, s, u, v, t in edges], EDGE)
    c = spark.createDataFrame(closures, "edge_key long, close_seq long, valid_to timestamp")
    return {r.edge_key: (r.n_contradicts, r.n_contradicted_by) for r in store.append_relations(store.supersede(e, c), block_bits=3).collect()}


def test_closed_edge_contradicts_nothing_later(spark):
    when = datetime.datetime(2024, 1, 1)
    assert counted(spark, [(1, 1, 0, 1, "BEFORE"), (2, 3, 0, 1, "AFTER")], [(1, 2, when)]) == {1: (0, 0), 2: (0, 0)}
    assert counted(spark, [(1, 1, 0, 1, "BEFORE"), (2, 3, 0, 1, "AFTER")], [(1, 9, when)]) == {1: (0, 1), 2: (1, 0)}
    assert counted(spark, [(1, 1, 0, 1, "BEFORE"), (2, 3, 0, 1, "BEFORE")], [(1, 9, when)]) == {1: (0, 0), 2: (0, 0)}


def test_counts_match_brute_force_with_a_hot_pair(spark):
    rng = random.Random(5)
    edges = [(i, i, 0 if i % 2 else rng.randint(1, 4), 0, rng.choice("ABC")) for i in range(300)]
    ends = {i: i + rng.randint(1, 80) for i in range(300) if rng.random() < 0.5}
    closures = [(k, s, datetime.datetime(2024, 1, 1)) for k, s in ends.items()]
    expected = {}
    for k, s, u, v, t in edges:
        others = [e for e in edges if (e[2], e[3]) == (u, v) and e[4] != t]
        expected[k] = (sum(o[1] < s and ends.get(o[0], 10**9) > s for o in others), sum(o[1] > s and ends.get(k, 10**9) > o[1] for o in others))
    assert counted(spark, edges, closures) == expected


def test_last_closure_sets_the_end_and_first_one_the_active_time(spark):
    e = spark.createDataFrame([(1, 1, 0, 1, "A")], EDGE)
    c = spark.createDataFrame([(1, 5, datetime.datetime(2024, 1, 5)), (1, 9, datetime.datetime(2024, 1, 9))], "edge_key long, close_seq long, valid_to timestamp")
    row = store.supersede(e, c).first()
    assert row.end_seq == 5 and row.valid_to == datetime.datetime(2024, 1, 9)


def test_federating_one_site_gives_the_site(spark):
    e = spark.createDataFrame([(1, "A", 0.5, None), (1, "ABSTAINED", 0.9, None), (1, "B", None, None)],
                              "site_id int, relation_type string, coverage double, valid_to timestamp")
    site, pop = store.site_motifs(e).first(), store.federate(store.site_motifs(e)).first()
    assert (pop.total_edges, pop.total_abstained, pop.population_mean_coverage) == (site.n_total_edges, site.n_abstained, site.mean_coverage) == (3, 1, 0.5)


def test_disagreement_counts_one_missing_answer_but_not_two(spark):
    a = spark.createDataFrame([(1, "X"), (2, None), (3, None), (4, "X")], "note_id int, relation string")
    b = spark.createDataFrame([(1, "X"), (2, "X"), (3, None), (4, "Y")], "note_id int, relation string")
    assert sorted(r.note_id for r in store.model_disagreements(a, b).collect()) == [2, 4]


def test_stream_appends_every_edge_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    batch = lambda lo: spark.range(lo, lo + 50).select(F.col("id").alias("edge_key"), (F.col("id") % 3).alias("site_id"))
    batch(0).write.parquet(src)
    stream = lambda: spark.readStream.schema("edge_key long, site_id long").parquet(src)
    append_edges(stream(), out, ck).awaitTermination(60)
    batch(50).write.mode("append").parquet(src)
    append_edges(stream(), out, ck).awaitTermination(60)
    assert sorted(r.edge_key for r in spark.read.parquet(out).collect()) == list(range(100))


def test_relations_at_a_table_of_moments_match_brute_force(spark):
    rng = random.Random(8)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=s)
    rows = []
    for k in range(400):
        start = rng.choice([None, rng.randrange(50), rng.randrange(10**12), -10**16])
        end = None if rng.random() < .3 or start is None else start + rng.choice([0, -5, 1, 2, rng.randrange(10**12)])
        rows.append((k, 0 if k % 3 else rng.randrange(3), 0, rng.choice("ABC"), start, end))
    moments = sorted({rng.randrange(60) for _ in range(30)} | {rng.randrange(2 * 10**12) for _ in range(40)} | {-2 * 10**16, -10**16})
    valid = lambda r, m: r[4] is not None and r[4] <= m and (r[5] is None or r[5] > m)
    for kind in ("timestamp", "timestamp_ntz"):
        edges = spark.createDataFrame([(*r[:4], *(None if x is None else at(x) for x in r[4:])) for r in rows],
                                      f"edge_key long, source_id int, target_id int, relation_type string, valid_from {kind}, valid_to {kind}")
        asked = spark.createDataFrame([(at(m),) for m in moments * 2] + [(None,)], f"moment {kind}")
        got = {(r.moment.replace(tzinfo=None), r.relation_type): r.n for r in store.relation_counts_at(edges, asked).collect()}
        expected = {(at(m), t): n for m in moments for t in "ABC" if (n := sum(valid(r, m) for r in rows if r[3] == t))}
        assert got == expected
        points = asked.withColumns({"source_id": F.lit(0), "target_id": F.lit(0)})
        links = sorted((r.moment.replace(tzinfo=None), r.edge_key) for r in store.relations_at(edges, points).collect())
        assert links == sorted((at(m), r[0]) for m in moments for r in rows if r[1] == 0 and valid(r, m))
    assert store.relation_counts_at(edges.where("false"), asked).count() == store.relations_at(edges, points.where("false")).count() == 0


def shuffled_rows(df):
    """Rows that the shuffles of a query wrote."""
    df.collect()
    nodes, rows = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            rows += node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows


MOMENT_EDGE = "source_id int, target_id string, edge_key long, relation_type string, valid_from timestamp, valid_to timestamp"
MOMENT_POINT = "source_id long, target_id string, moment timestamp"


def edges_and_points(n, pairs, seed):
    rng = random.Random(seed)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**12))
    pair = lambda: rng.choice(pairs)
    edges = [(*pair(), k, rng.choice("AB"), at(), at() if k % 3 else None) for k in range(n)]
    return edges, [(*pair(), at()) for _ in range(n)]


def test_an_edge_is_written_once_for_the_moments_of_a_small_pair(spark):
    edges, points = edges_and_points(600, [(u, v) for u in range(30) for v in "xy"], 3)
    out = store.relations_at(spark.createDataFrame(edges, MOMENT_EDGE), spark.createDataFrame(points, MOMENT_POINT))
    assert shuffled_rows(out) <= 2 * (len(edges) + len(points))


def test_slices_of_long_histories_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(store, "SLICE", 6, raising=False)
    monkeypatch.setattr(store, "SLICES", (3, 16), raising=False)
    edges, points = edges_and_points(500, [(1, "x")] * 6 + [(2, "x"), (3, "y"), (None, "x"), (1, None)], 4)
    edges += [(1, "x", 900 + i, "A", p[2], points[i + 1][2]) for i, p in enumerate(points[:99])] + edges[:5]
    points += points[:50] + [(1, "x", None)]
    out = store.relations_at(spark.createDataFrame(edges, MOMENT_EDGE), spark.createDataFrame(points, MOMENT_POINT))
    expected = sorted((*p, *e[2:4]) for p in {p for p in points if None not in p} for e in edges
                      if e[:2] == p[:2] and e[4] <= p[2] and (e[5] is None or e[5] > p[2]))
    assert sorted(map(tuple, out.collect())) == expected and len(expected) > 20000
    assert out.dtypes[:3] == [("source_id", "bigint"), ("target_id", "string"), ("moment", "timestamp")]
    # An edge is written once more for some moments at which it is valid, not for each of them.
    assert shuffled_rows(out) < len(edges) * 16


def test_links_of_a_stream_in_three_batches_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(12)
    edges = [(i, 2 * i, 0 if i % 2 else rng.randrange(3), 0, rng.choice("ABC")) for i in range(60)]
    ends = {i: rng.choice([2 * i + rng.randrange(1, 60), 2 * i + 2 * rng.randrange(1, 9)]) for i in range(60) if rng.random() < .6}
    log = [(u, v, k, t, s, True) for k, s, u, v, t in edges] + [(edges[k][2], 0, k, None, s, False) for k, s in ends.items()]
    schema = "source_id int, target_id int, edge_key long, relation_type string, at long, opens boolean"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for low, high in ((0, 40), (40, 41), (41, 1000)):
        part = [r for r in log if low <= r[4] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = contradictions(spark.readStream.schema(schema).parquet(src), salts=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.edge_key, r.contradicts) for r in spark.read.parquet(out).collect())
    expected = sorted((a[0], b[0]) for a in edges for b in edges if a[2:4] == b[2:4] and b[1] < a[1] and ends.get(b[0], 10**9) > a[1] and a[4] != b[4])
    assert got == expected and len(got) > 50


def test_stream_state_has_few_entries_and_keeps_its_links(spark, tmp_path):
    rng = random.Random(21)
    pair = {i: (rng.choice([None, *range(30)]), rng.choice([None, "x", "y"])) for i in range(600)}
    edges = {i: (3 * i, rng.choice([None, "A", "B"])) for i in range(600)}
    ends = {i: 3 * i + rng.randrange(1, 900) for i in range(600) if rng.random() < .6}
    log = [(*pair[i], i, kind, at, True) for i, (at, kind) in edges.items()] + [(*pair[i], i, None, at, False) for i, at in ends.items()]
    schema = "source_id long, target_id string, edge_key long, relation_type string, at long, opens boolean"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for low in range(0, 2700, 900):
        spark.createDataFrame([r for r in log if low <= r[4] < low + 900], schema).coalesce(2).write.mode("append").parquet(src)
        links = contradictions(spark.readStream.schema(schema).parquet(src), salts=2, buckets=2, part_edges=40)
        query = links.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 2 * (1 + 600 // 20)
    got = sorted((r.edge_key, r.contradicts) for r in spark.read.parquet(out).collect())
    expected = sorted((a, b) for a in edges for b in edges if pair[a] == pair[b] and edges[b][0] < edges[a][0] and ends.get(b, 10**9) > edges[a][0] and edges[a][1] != edges[b][1])
    assert got == expected and len(got) > 500
