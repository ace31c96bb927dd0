"""URL filters: a cascade of Bloom filters that is exact for every key of the corpus."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed, free_name

#: Bytes that all filters of a list may take together; a list of more goes through the tasks in several passes.
MAX_BYTES = 64 << 20
#: Share of foreign keys that the filters behind the first one let through.
LATER = 0.5

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased. Path: what follows up to ? or #.
    Both are empty for a null url and one without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return _lowered(host), path


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that rules of these lengths (host, path) can list for a url, the longest first.

    A key is a host or a domain above it, with the beginning of the path. One is built for every shape that the url
    has room for, so a url of any length gives as many keys at most as the list has shapes.
    """
    def key(h: int, p: int) -> Column:
        dot = F.length(host) - h
        fits = (F.length(host) == h) | ((dot > 0) & (F.substring(host, dot, F.lit(1)) == "."))
        tail = F.substring(host, dot + 1, F.lit(h)) if h else F.lit("")
        return F.when(fits & (F.length(path) >= p), F.concat(tail, F.substring(path, F.lit(1), F.lit(p)) if p else F.lit("")))

    if not shapes:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(key(h, p) for h, p in sorted(shapes, key=lambda s: (-s[0] - s[1], -s[0])))))


def hashes(key: Column) -> Column:
    """Two independent 64-bit hashes of a key, by which the filters know it."""
    return F.struct(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


class Bloom:
    """Bits of a filter, at least 64, and the number of positions of a key; `level` makes positions differ by level."""

    def __init__(self, keys: int, miss: float, level: int):
        self.bits = max(64, math.ceil(keys * -math.log(miss) / math.log(2) ** 2 / 64) * 64)
        self.probes = max(1, round(-math.log2(miss)))
        self.salts = [np.uint64((level + 1) * int(m) % 2**64) for m in (_MIX, _STEP)]
        self.words = None

    def positions(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        x, y = (h.view(np.uint64) ^ salt for h, salt in zip((a, b), self.salts))
        for _ in range(self.probes):
            x = (x ^ x >> np.uint64(29)) * _MIX + y
            yield (x ^ x >> np.uint64(32)) % np.uint64(self.bits)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for p in self.positions(a, b):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _built(keys: DataFrame, n: int, miss: float, level: int) -> Bloom:
    """The filter of the keys (columns a, b). Tasks set bits, words of bits meet by number; the driver gets the filter alone."""
    bloom = Bloom(n, miss, level)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b"))
            at = np.unique(np.concatenate([*bloom.positions(a, b), np.zeros(0, np.uint64)]))
            word, first = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = keys.select("a", "b").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom.words = np.zeros(bloom.bits // 64, np.uint64)
    bloom.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bloom


def member(levels: list[Bloom], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the cascade holds each key: it does if the first filter that lacks the key stands at an odd place."""
    out, left = np.zeros(len(a), bool), np.arange(len(a))
    for level, bloom in enumerate(levels):
        held = bloom.holds(a[left], b[left])
        out[left[~held]] = level % 2 == 1
        left = left[held]
    out[left] = len(levels) % 2 == 1
    return out


def cascade_bytes(listed: int, foreign: int) -> int:
    """Bytes of a cascade for so many listed and foreign keys, by expectation, twice over."""
    first = Bloom(listed, _first_miss(listed, foreign), 0)
    return 2 * (first.bits // 8 + 3 * Bloom(listed, LATER, 1).bits // 8)


def _first_miss(listed: int, foreign: int) -> float:
    return min(LATER, max(1, listed) / (math.sqrt(2) * max(1, foreign)))


def cascade(listed: DataFrame, universe: DataFrame, foreign: int) -> list[Bloom]:
    """Filters by level for the `listed` keys, exact for all keys of `universe`; both have columns a and b.

    The first filter encodes the listed keys, the second the foreign keys that pass the first, the third the listed
    keys that pass the second, and so on until none pass. `foreign` is about the number of foreign keys and
    shapes the first filter alone. Of the universe only what passes the first filter is shuffled.
    """
    n = listed.count()
    if not n:
        return []
    levels = [_built(listed, n, _first_miss(n, foreign), 0)]

    def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = bloom.holds(*(batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b")))
                yield batch.filter(pa.array(held))

        return keys.mapInArrow(keep, keys.schema)

    # A key is foreign if no listed one equals it; one aggregation tells, without a join.
    met = passing(universe.select("a", "b"), levels[0]).withColumn("own", F.lit(False)).unionAll(listed.select("a", "b", F.lit(True).alias("own")))
    met = checkpointed(met.groupBy("a", "b").agg(F.max("own").alias("own")))
    own, other = met.where("own").drop("own"), met.where("NOT own").drop("own")
    while (n := other.count()):
        levels.append(_built(other, n, LATER, len(levels)))
        own, other = other, checkpointed(passing(own, levels[-1]))
    return levels


def filtered(pages: DataFrame, rules: DataFrame, url_col: str = "url", out: str = "url_filter", max_bytes: int = MAX_BYTES) -> DataFrame:
    """`pages` with one more column, the struct `out`: host, path, rule (null if none fits), verdict (allow or block).

    `rules` has host, path and allow (boolean). A rule fits its host and all subdomains, if the path of the url
    starts with the rule's; the longest wins, among equally long ones that of the longer host. A rule listed both to
    block and to allow blocks. Where none fits, no cascade holds a key of the url, and the verdict is allow.

    Listed keys are encoded once as blocking and once as allowing, in cascades of Bloom filters that are exact for all
    keys that the urls of `pages` can make. So each page is judged in its own task from the keys of its url, without a
    join, and the rule is the key itself. The number of keys that a url can make is that of the distinct
    lengths of host and path in the list. Filters of at most `max_bytes` are sent to the tasks, which is checked
    before they are built; a longer list is cut by hash and judged part by part.

    A null url, and one without ://, has an empty host and path and meets such rules alone; null hosts or paths
    of rules count as empty, a null `allow` as false; repeated rules count once, and rules that fit no url (a host with
    /, ? or #, a path that does not begin with /) are left out. A column named `out` is replaced, other
    columns are kept whatever their names; no rows give no rows, and no rules allow all.
    """
    spark = pages.sparkSession
    own = rules.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")), F.coalesce(F.col("allow"), F.lit(False)).alias("allow"))
    own = own.withColumn("host", _lowered(F.col("host"))).where(~F.col("host").rlike("[/?#]") & F.col("path").rlike("^(/[^?#]*)?$"))
    own = own.groupBy("host", "path").agg(F.min("allow").alias("allow"))
    shapes = [(r["h"], r["p"]) for r in own.select(F.length("host").alias("h"), F.length("path").alias("p")).distinct().collect()]
    listed = own.select(F.concat("host", "path").alias("key"), "allow").groupBy("key").agg(F.min("allow").alias("allow"))
    listed = checkpointed(listed.select(hashes(F.col("key")).alias("h"), "allow").select("h.a", "h.b", "allow"))

    host, path = host_and_path(F.col(url_col))
    bare = pages.select(host.alias("host"), path.alias("path"))
    universe = bare.select(F.explode(keys_of(F.col("host"), F.col("path"), shapes)).alias("key")).select(hashes(F.col("key")).alias("h")).select("h.a", "h.b")
    n, keys = listed.count(), bare.select(F.coalesce(F.sum(F.size(keys_of(F.col("host"), F.col("path"), shapes))), F.lit(0)).alias("n")).first()["n"] if shapes else 0
    parts = max(1, math.ceil(cascade_bytes(n, keys) / max_bytes))

    name = free_name([*pages.columns, out], "place")
    made, found = pages.withColumn(out, F.struct(host.alias("host"), path.alias("path"))), []
    candidates = keys_of(F.col(f"`{out}`.host"), F.col(f"`{out}`.path"), shapes)
    hashed = F.transform(candidates, hashes)
    for part in range(parts):
        mine = F.pmod(F.col("a"), F.lit(parts)) == part
        levels = {allow: cascade(listed.where(mine & (F.col("allow") == allow)).select("a", "b"), universe.where(mine), keys // parts) for allow in (False, True)}
        found.append(_places(spark, levels, parts, part)(*(F.transform(hashed, lambda h: h[c]) for c in ("a", "b"))))
    made = made.withColumn(name, F.greatest(*found) if parts > 1 else found[0])
    # Places count from the shortest key on, so the greatest of all parts is that of the longest key.
    place, allowed = F.shiftright(F.col(f"`{name}`"), 1), F.col(f"`{name}`") % 2 == 1
    rule = F.when(place > 0, F.get(candidates, (F.size(candidates) - place).cast("int")))
    verdict = F.when((place > 0) & ~allowed, "block").otherwise("allow")
    return made.withColumn(out, F.struct(F.col(f"`{out}`.host").alias("host"), F.col(f"`{out}`.path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))).drop(name)


def _places(spark, levels: dict[bool, list[Bloom]], parts: int, part: int):
    """Of the hashes of a url's keys, longest first: twice the place of the first that a cascade holds, counted from the
    end from 1, and one more if it allows; 0 if none is held."""
    shared = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("int")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        for lists_a, lists_b in batches:
            n = lists_a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists_a, lists_b))
            mine = np.flatnonzero(a % parts == part)
            blocked, allowed = (member(own[allow], a[mine], b[mine]) for allow in (False, True))
            ends, row = np.cumsum(n), np.repeat(np.arange(len(n)), n)
            hit = mine[blocked | allowed]
            value = 2 * (ends[row[hit]] - hit) + (allowed & ~blocked)[blocked | allowed]
            out = np.zeros(len(n), np.int64)
            np.maximum.at(out, row[hit], value)
            yield pa.array(out, pa.int32())

    return place
