"""Packing, shards, neighbours, near copies and the pipeline against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cases import SCHEMA, rows
from tracewell.llm import near, neighbours, nnpu, packing, sharding
from tracewell.llm.components import components
from tracewell.llm.ranks import numbered

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_numbers_have_no_gaps(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(0)))
    got = defaultdict(list)
    for r in numbered(df, ["g"], ["id"], "n", parts=16).collect():
        got[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 5000


def greedy(sizes, capacity):
    n, used = 1, 0
    for s in sizes:
        n, used = (n + 1, s) if used + s > capacity else (n, used + s)
    return n


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards_are_minimax(odd, none, shards):
    got = sharding.shard(odd, shards).collect()
    assert len(got) == len(rows()) and sharding.shard(none, shards).count() == 0
    cells = Counter()
    for r in rows():
        cells[hashlib.md5((r[1] or "").encode()).hexdigest()[:4]] += len((r[1] or "").encode()) + 8
    sizes = [cells[c] for c in sorted(cells)]
    least = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
    total, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert max(total.values()) <= least and set(total) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32((r[1] or "").encode()) for r in rows())


def test_shards_are_even_beside_a_hot_text_and_at_the_end(spark):
    r = random.Random(2)
    docs = [(i, "h" * 92 if i % 3 == 0 else f"text {i} " + "x" * r.randrange(60, 120)) for i in range(6000)]
    sizes = Counter()
    for x in sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 24).collect():
        sizes[x.shard] += x["size"]
    hot = sum(len(t) + 8 for _, t in docs if t[0] == "h")
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 24 and max(sizes.values()) == hot
    assert max(rest) < 1.25 * sum(rest) / 23 and min(rest) > 0.75 * sum(rest) / 23
    plain = Counter()
    for x in sharding.shard(spark.createDataFrame([d for d in docs if d[1][0] != "h"], "doc_id long, text string"), 24).collect():
        plain[x.shard] += x["size"]
    assert len(plain) == 24 and max(plain.values()) < 1.03 * sum(plain.values()) / 24 and min(plain.values()) > 0.95 * sum(plain.values()) / 24


def test_shortest_pack_first_is_the_sequential_rule():
    r = np.random.RandomState(3)
    for _ in range(50):
        lengths = r.choice([1, 3, 5, 8, 20, 33, 64], size=r.randint(0, 60)).tolist()
        packs: list[list[int]] = []
        for x in sorted(lengths, reverse=True):
            open_ = [p for p in packs if sum(p) + x <= 64]
            if open_:
                min(open_, key=sum).append(x)
            else:
                packs.append([x])
        patterns = packing.shortest_pack_first(Counter(lengths), 64)
        assert sum(n for _, n in patterns) == len(packs)
        assert Counter(x for p, n in patterns for x in p for _ in range(n)) == Counter(lengths)
        assert all(sum(p) <= 64 for p, _ in patterns)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(odd, none, capacity):
    got = packing.pack(odd, WORDS, capacity).collect()
    assert packing.pack(none, WORDS, capacity).count() == 0
    library, expected = Tokenizer.from_file(WORDS), Counter()
    for r in rows():
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), capacity):
            expected[r[0], s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 100)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 64)
    r = np.random.RandomState(5)
    vectors = r.normal(size=(1500, 12)).astype(np.float32) * r.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    vectors[200:300] = vectors[200]
    data = [(i, v.tolist(), 0, 0.5) for i, v in enumerate(vectors)]
    odd_ones = [(5000, None, 0, 0.0), (5001, [0.0] * 12, 0, 0.0), (5002, [float("nan")] + [1.0] * 11, 0, 0.0), (5003, [None] + [1.0] * 11, 0, 0.0),
                (5004, [1.0, 2.0], 0, 0.0), (5005, [], 0, 0.0), (None, [1.0] * 12, 0, 0.0), data[7]]
    df = spark.createDataFrame(data + odd_ones, "vec_id long, embedding array<float>, rank int, score double")
    got = defaultdict(list)
    for x in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    hits = 0
    for q in range(0, 1500, 20):
        score = (vectors.astype(np.float64) * vectors[q].astype(np.float64)).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert [x[0] for x in got[q]] == list(range(1, 21)) and q not in [x[1] for x in got[q]]
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in got[q])
        hits += len({x[1] for x in got[q]} & set(best))
    assert hits >= 0.9 * 75 * 20 and not {5000, 5001, 5002, 5003, 5005, None} & set(got)
    few = neighbours.nearest(df.where("vec_id < 5 OR vec_id IN (5004, 5001)"), F.lit(True)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in few} == dict.fromkeys(range(5), 4)
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_probes_come_in_falling_order():
    found = neighbours.probes(np.array([0.3, -1.2]), np.array([0.5, 1.1]), 0.4, mass=0.9)
    assert len(found) == len(set(found)) > 3 and neighbours.probes(np.zeros(0), np.zeros(0), 0.4) == [()]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 30), (40, 35), (50, 50), (40, 30)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 1), 30: 30, 35: 30, 40: 30}
    assert components(edges.where("false")).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    r = np.random.RandomState(1)
    code = np.sort(r.randint(0, 2**62, 3000).astype(np.uint64))
    weight = r.randint(1, 200, 3000).astype(np.float64)
    a, b = np.arange(0, 2200), np.arange(800, 3000)
    like = weight[800:2200].sum() / weight.sum()
    other = weight.copy()
    signs = near.signature(np.concatenate([code[a], code[b]]), np.concatenate([weight[a], other[b]]), np.array([2200, 2200]))
    assert (signs[0] == signs[1]).mean() == pytest.approx(like, abs=0.17)
    assert (near.signature(code, weight, np.array([3000])) == near.signature(code, weight, np.array([3000]))).all()


def plain_groups(texts, similarity=0.8):
    """Group of each text, by comparing all pairs."""
    bags = []
    for t in texts:
        w = (t or "").encode().lower().split()
        bags.append(Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if w else []))
    df, n = Counter(s for b in bags for s in b), len(texts)
    weight = lambda s: int(near.idf(np.array([df[s]]), n)[0])
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            both = sum(min(bags[i][s], bags[j][s]) * weight(s) for s in bags[i].keys() & bags[j].keys())
            total = sum(c * weight(s) for b in (bags[i], bags[j]) for s, c in b.items()) - both
            if bags[i] and both >= similarity * total:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_copies(spark, odd, none):
    r = np.random.RandomState(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        own = r.choice(vocabulary, size=r.randint(20, 150)).tolist()
        for _ in range(r.randint(1, 5)):
            new = list(own)
            for at in r.randint(0, len(new), size=r.randint(0, 3)):
                new[at] = "new" + str(r.randint(1000))
            texts.append(" ".join(new))
    texts += [None, "", "  ", "two words", "Two  words", "four words are here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(near.near_copies(docs, block_bytes=3000).collect(), key=lambda r: r.doc_id)
    expected = plain_groups(texts)
    least = {g: expected.index(g) for g in set(expected)}
    assert [r.group_id for r in got] == [least[g] for g in expected]
    assert [r.kept for r in got] == [r.doc_id == r.group_id for r in got]
    found = near.near_copies(odd).collect()
    assert len(found) == len(rows()) and near.near_copies(none).count() == 0
    assert {r.doc_id for r in found if r.doc_id in (0, 1, 2, 3, 8) and r.kept} == {0, 1, 2, 3, 8}
    copies = [r for r in found if r.group_id is None and r.doc_id in (4, 5, 6, None)]
    assert len(copies) >= 6 and sum(r.kept for r in copies) in (1, 2)


@pytest.mark.parametrize(("chunk", "chunk_bytes"), [(1024, 4 << 20), (3, 4 << 20), (1024, 300)])
def test_all_documents_that_share_a_band_are_compared(spark, monkeypatch, chunk, chunk_bytes):
    monkeypatch.setattr(near, "CHUNK", chunk)
    monkeypatch.setattr(near, "CHUNK_BYTES", chunk_bytes)
    r = random.Random(chunk + chunk_bytes)
    base, bags = list(range(60)), []
    for _ in range(90):
        kept = r.sample(base, r.choice([30, 48, 52, 56]))
        bags.append({k: r.choice([1, 1, 1, 2, 70_000]) if r.random() < 0.02 else 1 for k in kept + r.sample(range(100, 10**6), r.randrange(8))})
    bands = [[1000 * k + r.randrange(6) if k < 3 else 10**6 * k + n for k in range(near.BANDS)] for n in range(90)]
    component = [0 if n < 25 else 25 if n < 40 else n for n in range(90)]
    like = lambda a, b: sum(min(a[k], b[k]) for k in a.keys() & b.keys()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    expected = list(component)
    for i in range(90):
        for j in range(i):
            if set(bands[i]) & set(bands[j]) and like(bags[i], bags[j]) >= near.SIMILARITY:
                expected = [expected[j] if g == expected[i] else g for g in expected]
    vectors = spark.createDataFrame([(n, sum(b.values()), *near.vector(np.array(list(b), np.uint64), np.array(list(b.values()))), bands[n]) for n, b in enumerate(bags)],
                                    "node long, total long, keys binary, weights binary, bands array<long>")
    members = vectors.select("node", "total", F.octet_length("keys").alias("bytes"), F.explode("bands").alias("bucket")).join(
        spark.createDataFrame(list(enumerate(component)), "node long, component long"), "node")
    links = [tuple(x) for x in near._cross_links(members, vectors, near.SIMILARITY).collect()]
    got = list(component)
    for a, b in links:
        assert component[a] != component[b] and like(bags[a], bags[b]) >= near.SIMILARITY
        got = [got[b] if g == got[a] else g for g in got]
    assert len(set(got)) == len(set(expected)) < len(set(component)) and len(set(zip(got, expected))) == len(set(got))
    dealt = near._dealt(members, near.SIMILARITY)
    assert dealt.groupBy("bucket", "i", "j").count().agg(F.max("count")).first()[0] <= (90 if chunk > 3 else 40)
    whole = members.withColumn("component", F.lit(1))
    assert near._dealt(whole, near.SIMILARITY).count() == 0


def test_a_hot_group_with_strangers_in_its_buckets(spark):
    r = np.random.RandomState(21)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for k in range(160):
        own = list(base)
        for at in r.randint(0, 80, size=r.randint(0, 2) if k < 120 else r.randint(3, 9)):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(near.near_copies(docs, block_bytes=4000).collect(), key=lambda x: x.doc_id)
    expected = plain_groups(texts)
    least = {g: expected.index(g) for g in set(expected)}
    assert [x.group_id for x in got] == [least[g] for g in expected] and 5 < len(least) < 60


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} < before | {-1}
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids) == docs.count() > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    sf = "/root/testdata/sf0.001"
    for i, docs in enumerate((odd, none)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{i}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{i}{name}"))
        assert (docs.count() > 0) == (i == 0)
    assert len(SCHEMA) > 0


def test_pipeline_keeps_one_row_of_each_group_whatever_the_ids(spark):
    r = np.random.RandomState(11)
    own = [" ".join(f"t{i}x{w}" for w in r.randint(0, 10**6, 60)) for i in range(5)]
    near_copy = own[0].rsplit(" ", 1)[0] + " changed"
    two_words = "two  " + own[4]
    data = [(7, own[0], "a"), (7, own[1], "a"), (7, own[1], "a"),  # two texts under one id, one of them twice
            (3, near_copy, "a"),  # copy of the first text under 7, of a lesser id
            (None, own[2], "a"), (None, own[3], "a"), (None, own[3], "a"), (9, own[2], "a"),  # null ids come first
            (None, None, "a"), (None, "", "a"), (None, None, "a"), (5, two_words, "a"), (5, two_words.replace("  ", " "), "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    left = corpus_pipeline.near_copies_out(spark, docs, "")
    got = Counter((x.doc_id, x.text) for x in left.collect())
    fives = [k for k in got if k[0] == 5]
    assert len(fives) == 1 and got.pop(fives[0]) == 1
    assert got == Counter({(3, near_copy): 1, (7, own[1]): 1, (None, own[2]): 1, (None, own[3]): 1, (None, None): 2, (None, ""): 1})
    assert left.columns == docs.columns


def test_near_copies_of_null_ids_weigh_like_others(spark):
    assert near.idf(np.array([1, 5000, 10**6]), 3).tolist() == [near.RARE, near.COMMON, near.COMMON]
    r = np.random.RandomState(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [common + " " + " ".join(f"v{w}" for w in r.randint(0, 10**6, 20)) for _ in range(600)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:20]]
    data = [(None if i else 1, t) for i, t in enumerate(texts)]
    kept = near.near_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).where("kept").count()
    assert kept == 600


def test_the_bound_on_examples_holds_for_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 60)] + [(None, "x")] * 50, "doc_id long, text string")
    positives = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    got = nnpu.sample(docs, positives, F.lit(True), "doc_id", "text", 10, 20).groupBy("positive").count().collect()
    assert {x.positive: x["count"] for x in got} == {True: 2, False: 20}
