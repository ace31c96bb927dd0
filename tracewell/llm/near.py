"""Near copies: consistent weighted sampling over shingles weighted by TF-IDF, bands, weighted Jaccard similarity."""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import block_count, checkpointed, numbering, release, starts_of, steps, word_ids
from tracewell.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
BLOCK_BYTES = 6 << 20
#: Text bytes that one numpy step works on.
STEP_BYTES = 1 << 20
#: Shingles of each part that counts documents.
PART_SHINGLES = 1_000_000
#: Members of a bucket that meet in a task with as many others, at most about, and bytes of their shingles.
CHUNK, CHUNK_BYTES = 1024, 4 << 20
#: A shingle's weight is its count times a whole number: RARE up to FEW documents, and falling with the logarithm of
#: their number to COMMON where all documents have it.
RARE, COMMON, FEW = 128, 96, 16
#: Bits of a shingle's key in its part, and draws of the sampling, which shingles share by hash.
KEY_BITS = 40
DRAWS = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def shingles(raw: list[bytes], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct 64-bit shingles of each text in a row, their counts, their number by text, and text digests.

    A-Z are lower-cased; a text of fewer than WORDS words is one shingle, one without words has none. The digest is
    that of the words, and empty where there are none. `known` keeps the hashes of the block's words.
    """
    words = [t.lower().split() for t in raw]
    ids, counts = word_ids(words, known["ids"])
    fresh = list(known["ids"])[len(known["hashes"]):]
    known["hashes"] = np.append(known["hashes"], np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh)))
    h = known["hashes"][ids]
    last = np.minimum(counts, WORDS)
    n = np.where(counts > 0, np.maximum(1, counts - WORDS + 1), 0)
    at = np.arange(int(n.sum())) + np.repeat(starts_of(counts) - starts_of(n), n)
    size, code = np.repeat(last, n), np.zeros(int(n.sum()), np.uint64)
    for j in range(WORDS):
        inside = size > j
        code[inside] = code[inside] * _MIX + h[at[inside] + j]
    code = _mixed(code)
    ends = np.cumsum(n).tolist()
    for a, b in zip([0, *ends], ends):
        code[a:b].sort()
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    new[starts_of(n)[n > 0]] = True
    first = np.flatnonzero(new)
    owner = np.repeat(np.arange(len(raw)), n)[first]
    return code[first], np.diff(np.append(first, len(code))), np.bincount(owner, minlength=len(raw)), [hashlib.md5(b" ".join(w)).digest() if w else b"" for w in words]


def new_words() -> dict:
    return {"ids": numbering(), "hashes": np.zeros(0, np.uint64)}


def parts_and_keys(code: np.ndarray, parts: int) -> np.ndarray:
    """Part and key of each shingle in one number. A part has 2^40 keys for some PART_SHINGLES shingles at any scale,
    so that about one in a million share their key with another one."""
    return (code >> np.uint64(KEY_BITS)) % np.uint64(parts) << np.uint64(KEY_BITS) | code & np.uint64((1 << KEY_BITS) - 1)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :KEY_BITS // 8] = own
    return out.view("<u8").ravel().astype(np.uint64)


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed inverse document frequencies of shingles, as whole numbers from RARE to COMMON."""
    steepness = (RARE - COMMON) / np.log(max(2.0, n_docs / FEW))
    return np.maximum(COMMON, np.round(RARE - steepness * np.log(np.maximum(1.0, np.asarray(df) / FEW)))).astype(np.int64)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fixed draws: r and log c from Gamma(2, 1), b uniform; and an odd multiplier for each sample."""
    rng = np.random.RandomState(20100)
    r, c = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS)
    return r, np.log(c), rng.uniform(size=DRAWS), rng.randint(0, 2**62, SAMPLES).astype(np.uint64) * np.uint64(4) + np.uint64(1)


def signature(code: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples of each text that has shingles: equal with the probability of the weighted Jaccard similarity.

    Improved consistent weighted sampling: with r, c and b of a shingle, t is the step of log weight at width r and
    offset b, y the weight at that step, and the shingle of least c / (y e^r) is drawn together with t; the one of
    least hash on a tie.
    """
    r_, log_c, b_, multipliers = _draws()
    starts, logs = starts_of(counts), np.log(weight)
    out = np.empty((len(counts), SAMPLES), np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k, m in enumerate(multipliers):
        draw = (code * m >> np.uint64(48)).astype(np.int64)
        r, b = r_[draw], b_[draw]
        t = np.floor(logs / r + b)
        value = log_c[draw] - r * (t - b) - r
        hit = np.flatnonzero(value == np.minimum.reduceat(value, starts)[owner])
        first = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
        out[:, k] = _mixed(code[first] * m + t[first].astype(np.int64).astype(np.uint64)) >> np.uint64(32)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), 1))
    for row in range(ROWS):
        keys = _mixed(keys * _MIX + samples[:, row::ROWS].astype(np.uint64))
    return keys


def vector(keys: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """A text's shingles for comparison: 32 bits of each key, sorted, and their weights in two bytes, or four where one needs them.

    Two of the shingles of a text share the 32 bits in one text of tens of thousands; their weights are then added.
    """
    own, where = np.unique(keys.astype(np.uint32), return_inverse=True)
    sums_ = np.bincount(where, weights, len(own)).astype(np.int64)
    return own.astype("<u4").tobytes(), sums_.astype("<u2" if not len(own) or sums_.max() < 1 << 16 else "<u4").tobytes()


def weighted_jaccard(keys_a: bytes, weights_a: bytes, total_a: int, keys_b: bytes, weights_b: bytes, total_b: int) -> float:
    """Sum of the lesser weights over the sum of the greater ones, of vectors; totals count unshared shingles too."""
    (keys_a, weights_a), (keys_b, weights_b) = ((np.frombuffer(k, "<u4"), np.frombuffer(w, "<u4" if len(w) == len(k) else "<u2").astype(np.int64))
                                                for k, w in ((keys_a, weights_a), (keys_b, weights_b)))
    _, a, b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    both = int(np.minimum(weights_a[a], weights_b[b]).sum())
    return both / max(1, total_a + total_b - both)


def _shared_counts(placed: DataFrame, parts: int) -> DataFrame:
    """For every block those of its shingles that two documents or more have, with their number: block, part, keys, df."""
    def ask(block: pa.Table) -> pa.Table:
        known, own = new_words(), [np.zeros(0, np.uint64)]
        for raw in steps(block["text"], STEP_BYTES):
            own.append(parts_and_keys(shingles(raw, known)[0], parts))
        keys = np.sort(np.concatenate(own))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        n, keys = np.diff(np.append(first, len(keys))), keys[first]
        many, rows = n > 1, []
        for own_keys, own_n in ((keys[~many], None), (keys[many], n[many])):
            part = (own_keys >> np.uint64(KEY_BITS)).astype(np.int64)
            bounds = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                at = slice(bounds[p], bounds[p + 1])
                rows.append((p, _packed(own_keys[at]), None if own_n is None else own_n[at].astype("<u4").tobytes()))
        release()
        part, keys_, n_ = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(part, pa.int32()), pa.array([block["block"][0].as_py()] * len(rows), pa.int32()), pa.array(keys_, pa.binary()), pa.array(n_, pa.binary())],
                        names=["part", "block", "keys", "n"])

    def count(rows: pa.Table) -> pa.Table:
        keys = [_unpacked(k) for k in rows["keys"].to_pylist()]
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        n = np.concatenate([np.ones(s, np.int64) if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x, s in zip(rows["n"].to_pylist(), sizes.tolist())])
        keys, row = np.concatenate(keys), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, row, n = keys[order], row[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        df = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))
        shared = df > 1
        keys, row, df = keys[shared], row[shared], df[shared]
        order = np.argsort(row, kind="stable")
        keys, row, df = keys[order], row[order], df[order]
        bounds = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
        out = [(a, b) for a, b in zip(bounds, bounds[1:])]
        full = [i for i, (a, b) in enumerate(out) if b > a]
        blocks, part = rows["block"].to_pylist(), rows["part"][0].as_py()
        return pa.table([pa.array([blocks[i] for i in full], pa.int32()), pa.array([part] * len(full), pa.int32()),
                         pa.array([_packed(keys[slice(*out[i])]) for i in full], pa.binary()), pa.array([df[slice(*out[i])].astype("<u4").tobytes() for i in full], pa.binary())],
                        names=["block", "part", "keys", "df"])

    asked = placed.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, n binary")
    return asked.groupBy("part").applyInArrow(count, "block int, part int, keys binary, df binary")


def _signed(placed: DataFrame, counts: DataFrame, parts: int, n_docs: int, similarity: float, with_text: bool = False) -> DataFrame:
    """Every document with its digest and total weight; signature and weighted shingles where it can have near copies.

    `text_md5` is that of the text as it is, null unless `with_text`; the digest is that of the words.

    A pair of the wanted similarity shares that part of the weight of either document, and what it shares is met in
    two documents at least. So a document with less weight in shared shingles has no near copy, and is not sampled.
    """
    def sign(block: pa.Table, answer: pa.Table) -> pa.Table:
        shared = [(np.uint64(p << KEY_BITS) | _unpacked(k), np.frombuffer(d, "<u4")) for p, k, d in zip(*(answer[c].to_pylist() for c in ("part", "keys", "df")))]
        keys, df = (np.concatenate(x) for x in zip(*shared)) if shared else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.argsort(keys)
        keys, df = np.append(keys[order], np.uint64(2**64 - 1)), np.append(df[order], 1)
        known, rows, seen = new_words(), [], set()
        for raw in steps(block["text"], STEP_BYTES):
            code, tf, n, digests = shingles(raw, known)
            own = parts_and_keys(code, parts)
            place = np.searchsorted(keys, own)
            times = np.where(keys[place] == own, df[place], 1).astype(np.int64)
            weight = tf * idf(times, n_docs)
            owner = np.repeat(np.arange(len(raw)), n)
            total = np.bincount(owner, weight, len(raw)).astype(np.int64)
            common = np.bincount(owner, weight * (times > 1), len(raw))
            able = (n > 0) & (common >= similarity * total)
            of_able = able[owner]
            samples = signature(own[of_able], weight[of_able].astype(np.float64), n[able]) if able.any() else np.zeros((0, SAMPLES), np.uint32)
            bands, number, starts = band_keys(samples).view(np.int64), np.cumsum(able) - 1, starts_of(n)
            for i, (digest, text) in enumerate(zip(digests, raw)):
                text_md5 = hashlib.md5(text).hexdigest() if with_text else None
                if not able[i]:
                    rows.append((text_md5, None, 0, None, None, None))
                elif digest in seen:
                    rows.append((text_md5, digest, int(total[i]), None, None, None))
                else:
                    seen.add(digest)
                    mine = slice(int(starts[i]), int(starts[i] + n[i]))
                    in_two = times[mine] > 1
                    rows.append((text_md5, digest, int(total[i]), bands[number[i]].tolist(), *vector(own[mine][in_two], weight[mine][in_two])))
        release()
        columns = list(zip(*rows)) if rows else [()] * 6
        types = (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([block["id"], *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "text_md5", "digest", "total", "bands", "keys", "weights"])

    id_type = placed.schema["id"].dataType.simpleString()
    return placed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        sign, f"id {id_type}, text_md5 string, digest binary, total long, bands array<long>, keys binary, weights binary")


def _verified(pairs: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of at least the similarity. Each side's shingles meet the pair by a join on the document."""
    @F.arrow_udf("double")
    def jaccard(keys_a: pa.Array, weights_a: pa.Array, total_a: pa.Array, keys_b: pa.Array, weights_b: pa.Array, total_b: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (keys_a, weights_a, total_a, keys_b, weights_b, total_b)))
        return pa.array([weighted_jaccard(*row) for row in rows], pa.float64())

    used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    own = vectors.join(used, "node", "left_semi").select("node", F.struct("keys", "weights", "total").alias("v"))
    joined = (pairs.join(own.withColumnsRenamed({"node": "b", "v": "vb"}), "b").join(own.withColumnsRenamed({"node": "a", "v": "va"}), "a"))
    value = jaccard(*(F.col(f"{v}.{c}") for v in ("va", "vb") for c in ("keys", "weights", "total")))
    return joined.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= similarity)


def _dealt(members: DataFrame, similarity: float) -> DataFrame:
    """bucket, i, j, chunk, node, component: members of mixed buckets, once for every chunk that theirs has to meet.

    `members` has bucket, node, component, total and bytes. In a bucket of several components the members outside the
    largest one meet all others, those of the largest one never each other. Chunks hold members of like total, and meet
    those of the totals that the similarity allows; they are bounded in members and bytes, so no bucket
    meets in one task, and a bucket of one component in none.
    """
    step = F.lit(1.01 / similarity)  # a little over the greatest quotient of two totals, so that rounding parts none
    sizes = members.groupBy("bucket", "component").agg(F.count("node").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("component").alias("components")).where("components > 1")
    size = F.floor(F.log(F.greatest("total", F.lit(1))) / F.log(step)).cast("int")
    inside = members.join(mixed.drop("components"), "bucket").withColumn("kind", 2 * size + (F.col("component") == F.col("main")).cast("int"))
    kinds = inside.groupBy("bucket", "kind").agg(F.ceil(F.greatest(F.count("node") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    kinds = kinds.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("kind", "chunks"))).alias("kinds"))
    number = lambda kind, chunk: F.shiftleft(kind.cast("long"), 32) + chunk
    own = number(F.col("kind"), F.pmod(F.xxhash64("node"), F.element_at("kinds", F.col("kind"))))
    main = lambda kind: kind % 2 == 1
    met = F.filter(F.map_keys("kinds"), lambda k: (F.abs(F.floor(k / 2) - F.floor(F.col("kind") / 2)) <= 1) & ~(main(k) & main(F.col("kind"))))
    others = F.flatten(F.transform(met, lambda k: F.transform(F.sequence(F.lit(0), F.element_at("kinds", k) - 1), lambda c: number(k, c))))
    dealt = inside.join(kinds, "bucket").select("bucket", "node", "component", own.alias("chunk"), F.explode(others).alias("other"))
    return dealt.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component")


def _cross_links(members: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between components: every two documents of different components that share a bucket are compared exactly,
    but for those that a link found in the same task has joined.

    Two documents that share several buckets are compared in that of their first band. A task names no more links than join
    its components, so the rows out follow the members.
    """
    def compare(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["node"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        chunk, bucket, same = rows["chunk"].to_numpy(), rows["bucket"][0].as_py(), rows["i"][0] == rows["j"][0]
        low = chunk == rows["i"][0].as_py()
        left, right = np.flatnonzero(low), np.arange(len(chunk)) if same else np.flatnonzero(~low)
        if len(left) > len(right):
            left, right = right, left
        found = _links(rows, left, right, bucket, same, similarity) if len(left) and len(right) else []
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spread = _dealt(members, similarity).join(vectors.select("node", "total", "keys", "weights", "bands"), "node")
    return spread.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _links(rows: pa.Table, left: np.ndarray, right: np.ndarray, bucket: int, same: bool, similarity: float) -> list[tuple[int, int]]:
    node, component, total = (rows[c].to_numpy() for c in ("node", "component", "total"))
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    keys, weights = rows["keys"].to_pylist(), rows["weights"].to_pylist()
    weight_of = lambda i: np.frombuffer(weights[i], "<u4" if len(weights[i]) == len(keys[i]) else "<u2").astype(np.int64)
    names, label = np.unique(component, return_inverse=True)
    sizes = np.array([len(keys[i]) // 4 for i in right])
    universe, place = np.unique(np.concatenate([np.frombuffer(keys[i], "<u4") for i in right]), return_inverse=True)
    held, starts = np.concatenate([weight_of(i) for i in right]), starts_of(sizes)
    entry_of = np.repeat(np.arange(len(right)), sizes)
    own, out = np.zeros(len(universe), np.int64), []
    for i in left.tolist():
        need = (label[right] != label[i]) & (total[right] >= similarity * total[i]) & (total[i] >= similarity * total[right])
        if same:
            need &= right > i
        at = np.flatnonzero(need)
        shared = bands[right[at]] == bands[i]
        at = at[bands[i][shared.argmax(axis=1)] == bucket]
        if not len(at):
            continue
        mine = np.frombuffer(keys[i], "<u4")
        where = np.searchsorted(universe, mine)
        where[where == len(universe)] = 0
        hit = universe[where] == mine
        own[where[hit]] = weight_of(i)[hit]
        if 2 * len(at) < len(right):
            chosen = np.zeros(len(right), bool)
            chosen[at] = True
            entries = np.flatnonzero(chosen[entry_of])
            both = np.add.reduceat(np.minimum(own[place[entries]], held[entries]), starts_of(sizes[at]))
        else:
            both = np.add.reduceat(np.minimum(own[place], held), starts)[at]
        own[where[hit]] = 0
        for j in right[at[both >= similarity * np.maximum(1, total[i] + total[right[at]] - both)]].tolist():
            if label[j] != label[i]:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                label[label == label[j]] = label[i]
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES,
                md5_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: `id_col`, group_id (the least id of its group), kept.

    With `md5_col`, also a column of this name with the hexadecimal MD5 of the text, that of the empty text for a null
    one; it tells rows of one id from one another.

    Two documents are linked if their words are equal, or if they share a band and the weighted Jaccard similarity
    of their shingles of five words is `similarity` or more; groups are what links connect. A shingle weighs its count
    in the document times a smoothed inverse document frequency, counted over all documents. At 0.8 two
    documents miss all bands in one case of five thousand.

    Documents with equal words count as one from the bands on. Each document is first compared with one centre of its
    buckets, the one it shares most bands with, so a group of copies costs a comparison or two a member. Then all
    documents that share a band and are still apart are compared exactly; no link of such documents is skipped.

    One row of each group is `kept`. A null or empty text, or one without words, is a group of its own; repeated rows
    are copies of one another; ties go to the least id, a null id coming first. Other columns are not read; no rows
    give no rows.
    """
    blocks = block_count(docs, text_col, block_bytes)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    facts = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-facts["bytes"] // (6 * PART_SHINGLES)))
    placed = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    signed = _signed(placed, _shared_counts(placed, parts), parts, facts["n"], similarity, md5_col is not None)
    rows = checkpointed(signed.withColumn("row", F.monotonically_increasing_id()))
    nodes = rows.where("keys IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"))
    vectors = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")

    size = (F.octet_length("keys") + F.octet_length("weights")).alias("bytes")
    members = checkpointed(vectors.select("node", "total", size, F.explode("bands").alias("bucket")))
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("node").alias("size")).where("size > 1").drop("size")
    shared = members.select("bucket", "node").join(centres, "bucket").where("node <> centre").groupBy("node", "centre").agg(F.count("bucket").alias("bands"))
    first = shared.groupBy("node").agg(F.max(F.struct("bands", (-F.col("centre")).alias("centre"))).alias("best"))
    links = checkpointed(_verified(first.select((-F.col("best.centre")).alias("a"), F.col("node").alias("b")), vectors, similarity).select("a", "b"))

    found = components(links)
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = checkpointed(_cross_links(labelled, vectors, similarity))
    if not across.isEmpty():
        found = components(links.unionAll(across))

    of_digest = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    placed_rows = rows.select("id", "row", "digest", "text_md5").join(of_digest, "digest", "left").withColumn("component", F.coalesce("component", "row"))
    least = placed_rows.groupBy("component").agg(F.min(F.struct("id", "row")).alias("least"))
    named = [] if md5_col is None else [F.col("text_md5").alias(md5_col)]
    return placed_rows.join(least, "component").select(
        F.col("id").alias(id_col), F.col("least.id").alias("group_id"), (F.col("row") == F.col("least.row")).alias("kept"), *named)
