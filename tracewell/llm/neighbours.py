"""Nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking inside the buckets."""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed

NEAREST = 20
TABLES = 2
#: Width of a slot, for projections of vectors of length one.
WIDTH = 2.0
#: Chance, by the estimate, that the visited buckets of a table hold a neighbour; two tables miss one in twenty.
MASS = 0.78
#: Rows that a bucket holds on average, at most, and rows that a task holds of one bucket.
BUCKET_ROWS = 2048
TASK_ROWS = 4096
#: Bound of the sample that tells how near neighbours are.
SAMPLE = 2048
_QUERIES_AT_ONCE = 256


def functions(dim: int, number: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed directions, with one component more for the completion to length one, and offsets of the slots."""
    rng = np.random.RandomState([7, dim, table])
    return rng.normal(size=(number, dim + 1)), rng.uniform(0, WIDTH, number)


def completed(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors over the greatest length, with a component that makes them of length one, so that the nearest of
    these by distance are the largest by inner product."""
    x = vectors / longest
    return np.append(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True))), axis=1)


def directed(vectors: np.ndarray) -> np.ndarray:
    """The queries at length one, with no completion."""
    return np.append(vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), np.zeros((len(vectors), 1)), axis=1)


def probes(place: np.ndarray, offsets: np.ndarray, likeness: float, mass: float = MASS) -> list[tuple[int, ...]]:
    """Buckets in falling order of the chance that they hold a neighbour, until the chances add up to `mass`.

    A neighbour whose cosine with the query is `likeness` has projections that are normal around `likeness` times the
    query's, and independent for independent directions; so a bucket's chance is the product of its slots' chances.
    """
    if not len(place):
        return [()]
    spread = math.sqrt(max(1e-6, 1 - likeness * likeness))
    normal = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    slots = []
    for p, b in zip(place.tolist(), offsets.tolist()):
        middle = likeness * p
        first, last = math.floor((middle + b - 6 * spread) / WIDTH), math.floor((middle + b + 6 * spread) / WIDTH)
        chance = [(normal(((j + 1) * WIDTH - b - middle) / spread) - normal((j * WIDTH - b - middle) / spread), j) for j in range(first, last + 1)]
        slots.append(sorted(chance, key=lambda c: (-c[0], c[1])))
    start = (0,) * len(slots)
    product = lambda at: math.prod(s[i][0] for s, i in zip(slots, at))
    queue, seen, out, total = [(-product(start), start)], {start}, [], 0.0
    while queue and total < mass:
        chance, at = heapq.heappop(queue)
        total -= chance
        out.append(tuple(s[i][1] for s, i in zip(slots, at)))
        for i in range(len(slots)):
            if at[i] + 1 < len(slots[i]):
                on = (*at[:i], at[i] + 1, *at[i + 1:])
                if on not in seen:
                    seen.add(on)
                    heapq.heappush(queue, (-product(on), on))
    return out


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    own = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of these rows: query ids, ids, inner products; rows of the query's own id excepted, and
    those whose product is below the query's bound.

    Equal vectors are looked at once, with their k + 1 least ids. A matrix product finds what comes near the k-th
    value, and the products that count are then summed one by one, so that equal vectors score equally.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    as_bytes = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, kind = np.unique(as_bytes, return_index=True, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind)
    begin = np.cumsum(sizes) - sizes
    sizes = np.minimum(sizes, k + 1)
    distinct, out = vectors[first], []
    for at in range(0, len(queries), _QUERIES_AT_ONCE):
        q, own = queries[at:at + _QUERIES_AT_ONCE], query_ids[at:at + _QUERIES_AT_ONCE]
        bound = np.full(len(q), -np.inf) if bounds is None else bounds[at:at + _QUERIES_AT_ONCE]
        rough = q @ distinct.T
        slack = 1e-9 * (np.abs(rough).max(axis=1) + 1e-300)
        least = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if rough.shape[1] > k + 1 else np.full(len(q), -np.inf)
        a, b = np.nonzero(rough >= (np.maximum(least, bound) - slack)[:, None])
        score = (q[a] * distinct[b]).sum(axis=1)
        reached = score >= bound[a]
        a, b, score = a[reached], b[reached], score[reached]
        n = sizes[b]
        place = np.repeat(begin[b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, score, found = np.repeat(a, n), np.repeat(score, n), ids[by_kind[place]]
        other = found != own[a]
        a, score, found = a[other], score[other], found[other]
        order = np.lexsort((found, -score, a))
        a, score, found = a[order], score[order], found[order]
        number = np.arange(len(a)) - np.searchsorted(a, a)
        keep = number < k
        out.append((own[a[keep]], found[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _likeness(sample: np.ndarray, longest: float, k: int) -> float:
    """Cosine, after completion, of a vector of the sample with its k-th neighbour there: the median."""
    if len(sample) <= k + 1:
        return 0.0
    near = directed(sample) @ completed(sample, longest).T
    return float(np.clip(np.median(np.partition(near, -(k + 1), axis=1)[:, -(k + 1)]), 0.0, 0.999))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for every row where `is_query` holds: query_id, rank, vec_id, score.

    Every row is put into one bucket of each table. A query visits buckets in the order of their estimated chances,
    until they hold a neighbour with the wanted chance; how alike neighbours are is estimated on a sample of
    bounded size. The number of hash functions follows the number of rows, so that buckets keep their size. A bucket
    of many rows is dealt to several tasks; copies of a vector are compared once a task. Buckets are visited
    in rounds, each of about as many rows as all before it, and a task returns only rows that reach the query's k-th score of
    the rounds before, k at most; so what it returns grows with the queries and the number of rounds. A query
    that finds fewer than k rows in its buckets goes on to the others in the same way.

    Ties go to the smaller id. Null ids, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part; vectors of other lengths are not compared. A repeated id counts once, with its best score, and is
    no neighbour of itself. Other columns are not read; no queries give no rows.
    """
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("vector", value) & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    facts = {r["dim"]: (r["n"], r["longest"]) for r in rows.groupBy("dim").agg(F.count("id").alias("n"), F.max(length).alias("longest")).collect()}
    drawn: dict = {}
    for r in rows.select("dim", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        drawn.setdefault(r["dim"], []).append(r["vector"])
    plan = {dim: (max(0, math.ceil(math.log(max(1, n / BUCKET_ROWS)) / math.log(2.5))), longest, _likeness(np.array(drawn.get(dim, [])), longest, k)) for dim, (n, longest) in facts.items()}

    def placed(asking: bool):
        @F.arrow_udf("array<struct<table: int, bucket: array<int>>>")
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                out = []
                for vector in batch:
                    x = np.array([vector.as_py()])
                    number, longest, likeness = plan[x.shape[1]]
                    x, found = directed(x) if asking else completed(x, longest), []
                    for t in range(TABLES if number else 1):
                        a, b = hashes(x.shape[1] - 1, number, t)
                        p = (a * x).sum(axis=1)
                        found += [{"table": t, "bucket": list(c)} for c in (probes(p, b, likeness) if asking else [np.floor((p + b) / WIDTH).astype(int).tolist()])]
                    out.append(found)
                yield pa.array(out, pa.list_(pa.struct([("table", pa.int32()), ("bucket", pa.list_(pa.int32()))])))

        kept: dict = {}

        def hashes(*key):
            if key not in kept:
                kept[key] = functions(*key)
            return kept[key]

        return find

    bucket = ["dim", "table", "bucket"]
    spot = F.posexplode("spots").alias("place", "spot")
    held = rows.select("dim", "id", "vector", placed(False)(F.col("vector")).alias("spots")).select("dim", "id", "vector", spot).select("dim", "spot.*", "id", "vector")
    queries = rows.where("query").dropDuplicates(["id", "vector"]).select("dim", "id", "vector")
    asked = queries.withColumn("spots", placed(True)(F.col("vector"))).select("dim", "id", "vector", spot).select("dim", "spot.*", "id", "vector", "place")
    sizes = checkpointed(held.groupBy(*bucket).agg(F.count("id").alias("size"), F.ceil(F.count("id") / TASK_ROWS).cast("int").alias("pieces")))
    dealt = held.join(sizes, bucket).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces", "size")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(left) and len(right):
            found = best_of(right["asked_id"].to_numpy(), _matrix(right["asked_vector"]), left["id"].to_numpy(), _matrix(left["vector"]), k, right["asked_bound"].to_numpy())
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    def visit(visits: DataFrame, best: DataFrame | None) -> DataFrame:
        """The k best of the rows found before and of those in the visited buckets (columns of `bucket`, id, vector, pieces)."""
        if best is None:
            bounded = visits.withColumn("bound", F.lit(float("-inf")))
        else:
            bound = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            bounded = visits.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        spread = bounded.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        keys = [*bucket, "piece"]
        renamed = spread.select(*(F.col(c).alias(f"asked_{c}") for c in (*keys, "id", "vector", "bound")))
        found = dealt.groupBy(*keys).cogroup(renamed.groupBy(*(f"asked_{c}" for c in keys))).applyInArrow(search, "query_id long, vec_id long, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return checkpointed(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", number).where(F.col("rank") <= k))

    # A round visits about as many rows as all before it, so few of them pass the bounds of the rounds before.
    before = Window.partitionBy("id", "vector").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    visits = asked.join(sizes, bucket).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    visits = checkpointed(visits.withColumn("round", F.floor(F.log2(1 + F.col("before") / TASK_ROWS)).cast("int")).drop("before", "place", "size"))
    best = None
    for r in range((visits.agg(F.max("round")).first()[0] or 0) + 1):
        best = visit(visits.where(F.col("round") == r), best)

    # Queries that have found too few go on to the other buckets of a table, again as many rows each time as before.
    others = F.create_map(*(F.lit(x) for dim, (n, _) in facts.items() for x in (dim, n - 1))) if facts else F.create_map(F.lit(0), F.lit(0))
    upto = Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    order = checkpointed(sizes.where("table = 0").withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn(
        "round", F.floor(F.log2(1 + F.col("before") / TASK_ROWS)).cast("int")).drop("before", "size"))
    for r in range((order.agg(F.max("round")).first()[0] or 0) + 1):
        counts = best.groupBy(F.col("query_id").alias("id")).agg(F.count("vec_id").alias("found"))
        short = queries.join(counts, "id", "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), others[F.col("dim")])).select("dim", "id", "vector")
        short = checkpointed(short)
        if short.isEmpty():
            break
        best = visit(short.join(order.where(F.col("round") == r), "dim").select(*bucket, "id", "vector", "pieces"), best)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
