"""Collocations: phrase counts from a weighted de Bruijn graph of the longest grams."""

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed, release

#: Words of the longest gram; nodes of the graph have one word less.
LONGEST = 4
#: Least occurrences of a phrase, and the hundredths of them that make a longer phrase stand for it.
LEAST, STANDS_FOR = 30, 80
#: Phrases of each language.
TOP = 2000
#: Text bytes whose grams are counted together before they leave a task.
STEP_BYTES = 5 << 20
#: Texts that tell which beginnings are frequent, at most, and the least share of grams from which one is dealt to several tasks.
SAMPLE, HOT_SHARE = 2000, 0.0005
#: Text bytes whose grams meet in a part, about.
PART_BYTES = 6 << 20

_DELIMITERS, _UPPER = b".,;:!?\n\x0b\x0c\r", bytes(range(65, 91))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECES = bytes.maketrans(_DELIMITERS + b"\t" + _UPPER, b"\n" * len(_DELIMITERS) + b" " + _UPPER.lower())


def stretches(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[bytes]:
    """The texts with pieces ended by line feeds, in stretches of about `limit` bytes; only a single piece may be longer."""
    raw = b"\n".join(texts).translate(_PIECES)
    start = 0
    while start < len(raw):
        stop = raw.rfind(b"\n", start, start + limit) if len(raw) - start > limit else len(raw)
        stop = stop if stop > start else raw.find(b"\n", start + 1)
        stop = stop if stop > 0 else len(raw)
        yield raw[start:stop]
        start = stop


def local_grams(stretch: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a stretch, its distinct grams as LONGEST columns of word numbers (-1 beyond the gram's end), and their counts.

    Each word begins one gram: the longest that its piece has room for. So the grams of fewer than LONGEST words are
    the ends of pieces, and every occurrence of a phrase is the beginning of exactly one gram.
    """
    known: dict = {b"": 0, b"\n": 1}
    tokens = stretch.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens)) - 2
    ids = np.append(ids[ids != -2], np.full(LONGEST, -1))
    at = np.flatnonzero(ids >= 0)
    words, inside = np.empty((LONGEST, len(at)), np.int64), np.ones(len(at), bool)
    for k in range(LONGEST):
        inside &= ids[at + k] >= 0
        words[k] = np.where(inside, ids[at + k], -1)
    first, n, _ = _distinct(words, np.ones(len(at), np.int64))
    return list(known)[2:], words[:, first], n


def _distinct(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns that are distinct: a place of each, the sum of n, and the number of each column. Sums are whole and below 2^53."""
    code = np.zeros(words.shape[1], np.int64)
    for w in words:
        # Codes are numbered anew each time, so that they stay below the number of columns.
        code = pd.factorize(code * (int(w.max(initial=0)) + 2) + w + 1)[0]
    sums = np.bincount(code, n).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    first = np.zeros(len(sums), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first, sums, code


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def dealt(lang: str, words: list[bytes], grams: np.ndarray, n: np.ndarray, parts: int, salts: dict[tuple, int]) -> Iterator[tuple[int, bytes, bytes]]:
    """Part, grams and counts, compressed: the grams of two words or more, and each word that begins grams with their number.

    The part is a hash of the language and the first two words, for a head with salts also of the third word.
    """
    single, flow, _ = _distinct(grams[:1], n)
    more = np.flatnonzero(grams[1] >= 0)
    ones = np.full((LONGEST, len(single)), -1)
    ones[0] = grams[0, single]
    grams, n = np.append(grams[:, more], ones, axis=1), np.append(n[more], flow)
    own = np.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(0))
    key = _mixed(own[grams[0]] * _MIX + own[grams[1]] + np.uint64(zlib.crc32(lang.encode())))
    if salts:
        number = {w: i for i, w in enumerate(words)}
        for (_, one, two), size in ((h, s) for h, s in salts.items() if h[0] == lang):
            at = np.flatnonzero((grams[0] == number.get(one, -2)) & (grams[1] == number.get(two, -2)))
            key[at] = _mixed(key[at] + _mixed(own[grams[2, at]]) % np.uint64(size) * _MIX)
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((grams[1], grams[0], part))
    names = pa.array([*words, None], pa.large_binary())
    columns = (names.take(pa.array(np.where(c[order] < 0, len(words), c[order]))) for c in grams)
    text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    text = pc.binary_join_element_wise(text, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets, data = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1), memoryview(text.buffers()[2] or b"")
    bounds = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)).tolist()
    packed = zstandard.ZstdCompressor(level=1)
    counts_ = n[order].astype("<u8")
    for a, b in zip(bounds, bounds[1:]):
        yield int(part[order[a]]), packed.compress(data[offsets[a]:offsets[b]]), packed.compress(counts_[a:b].tobytes())


def by_blocks(batches: Iterator[pa.RecordBatch], rows_of: Callable) -> Iterator[pa.RecordBatch]:
    """`rows_of` language, words, grams and counts of some megabytes of texts of one language at a time."""
    held, size = defaultdict(list), Counter()

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        for stretch in stretches(held.pop(lang)):
            yield rows_of(lang, *local_grams(stretch))
        del size[lang]
        release()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            held[lang].append(text.as_py())
            size[lang] += len(held[lang][-1])
            if size[lang] >= STEP_BYTES:
                yield from flush(lang)
            elif size.total() >= 4 * STEP_BYTES:
                yield from flush(max(size, key=size.get))
    for lang in list(held):
        yield from flush(lang)


def _salts(texts: DataFrame, n_texts: int, parts: int) -> dict[tuple, int]:
    """Heads (language and two words) that about SAMPLE texts show to have more grams than a part takes, and
    into how many they go. They decide where grams are counted, not the counts."""
    drawn = texts.select("lang", F.substring("text", 1, 1 << 16).alias("text")).sample(min(1.0, SAMPLE / max(1, n_texts)), 42)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(lang, words, grams, n):
            grams = grams[:, grams[1] >= 0]
            first, rows, _ = _distinct(grams[:2], np.ones(grams.shape[1], np.int64))
            one, two = ([words[i] for i in grams[k, first].tolist()] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(rows, pa.int64())], names=["lang", "one", "two", "n"])
        yield from by_blocks(batches, rows_of)

    found = drawn.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(heads, "lang string, one binary, two binary, n long")
    found = found.groupBy("lang", "one", "two").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return {(r["lang"], bytes(r["one"]), bytes(r["two"])): max(2, math.ceil(2 * r["share"] * parts))
            for r in found.where(F.col("share") > max(HOT_SHARE, 0.5 / parts)).collect()}


def merged(lang: list[str], blobs: list[bytes], sizes: list[bytes], least: int, salts: dict[tuple, int]) -> Iterator[tuple[str, str, int]]:
    """Language, phrase and count from the grams of a part: phrases that occur `least` times or more, what the part has of
    heads with salts, and each language's words under the empty phrase."""
    unpack = zstandard.ZstdDecompressor().decompress
    for own in sorted(set(lang)):
        rows = [i for i, x in enumerate(lang) if x == own]
        n = np.concatenate([np.frombuffer(unpack(sizes[i]), "<u8") for i in rows]).astype(np.int64)
        text = pa.array([b"".join(unpack(blobs[i]) for i in rows)[:-1].replace(b"\n", b" \n ")], pa.large_binary())
        tokens = pc.list_flatten(pc.split_pattern(text, pattern=b" ")).dictionary_encode()
        ids, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary.to_pylist()
        stop = ids == words.index(b"\n") if len(n) > 1 else np.zeros(len(ids), bool)
        at = np.append(0, np.flatnonzero(stop) + 1)
        end = np.append(np.flatnonzero(stop), len(ids))
        grams = np.full((LONGEST, len(at)), -1)
        for k in range(LONGEST):
            has = at + k < end
            grams[k, has] = ids[at[has] + k]
        yield own, "", int(n[grams[1] < 0].sum())
        kept = {(one, two) for lang_, one, two in salts if lang_ == own}
        for k in range(1, LONGEST + 1):
            ends = grams[1] < 0 if k == 1 else grams[k - 1] >= 0
            inside, counted = grams[:k, ends], n[ends]
            first, sums, _ = _distinct(inside, counted)
            for i in np.flatnonzero(sums >= (0 if k == 2 and kept else least)).tolist():
                phrase = [words[j] for j in inside[:, first[i]].tolist()]
                if sums[i] >= least or tuple(phrase) in kept:
                    yield own, b" ".join(phrase).decode(), int(sums[i])


def counts(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The graph's numbers for columns lang and text: lang, phrase (a list of one to LONGEST words) and n of all phrases that occur
    `least` times or more; and lang and n, all words.

    Phrases of LONGEST words are the edges. A shorter phrase is counted by its flow: what leaves it by edges, and
    what ends there with a piece. Tasks count grams by blocks of texts, and deal them out once by their heads, so that edges and nodes are
    summed up where they meet; a part stands for about PART_BYTES of text. Heads that many grams share are dealt
    on by the third word, and summed up once more.
    """
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["bytes"] // PART_BYTES))
    salts = _salts(texts, size["n"], parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(lang, *grams):
            rows = list(zip(*dealt(lang, *grams, parts, salts))) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array([lang] * len(rows[0]), pa.string()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["part", "lang", "grams", "n"])
        yield from by_blocks(batches, rows_of)

    def merge(rows: pa.Table) -> pa.Table:
        found = list(zip(*merged(*(rows[c].to_pylist() for c in ("lang", "grams", "n")), least, salts)))
        release()
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])

    blobs = texts.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "part long, lang string, grams binary, n binary")
    found = blobs.groupBy("part").applyInArrow(merge, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = checkpointed(found)
    phrases = found.where((F.col("phrase") != "") & (F.col("n") >= least)).select("lang", F.split("phrase", " ").alias("phrase"), "n")
    return phrases, found.where("phrase = ''").select("lang", "n")


def unary_paths(phrases: DataFrame) -> DataFrame:
    """lang, words, n: the edges among the phrases, compacted to the longest runs in which each goes on in the next alone.

    An inner node has one edge in and one edge out, both as heavy as the node's whole flow, so no piece begins or ends there and no
    rarer edge leaves it. Edges know the edge before them; pointers are doubled until all know the first of their
    run, about log2 of the longest run times. A run lies inside a piece, so its length is bounded by a piece's. No run is
    a ring, since every piece has a first word.
    """
    edges, nodes = phrases.where(F.size("phrase") == LONGEST), phrases.where(F.size("phrase") == LONGEST - 1)
    own = checkpointed(edges.select("lang", "n", F.slice("phrase", 1, LONGEST - 1).alias("u"), F.slice("phrase", 2, LONGEST - 1).alias("v"),
                                    F.monotonically_increasing_id().alias("edge")))
    ins = own.groupBy("lang", F.col("v").alias("phrase")).agg(F.count("edge").alias("ins"), F.min("edge").alias("before"), F.min("n").alias("n_in"))
    outs = own.groupBy("lang", F.col("u").alias("phrase")).agg(F.count("edge").alias("outs"), F.min("edge").alias("after"), F.min("n").alias("n_out"))
    inner = ins.where("ins = 1").join(outs.where("outs = 1"), ["lang", "phrase"]).where("n_in = n_out AND before <> after")
    inner = inner.join(nodes, ["lang", "phrase"]).where("n = n_in")
    steps_ = checkpointed(own.join(inner.select(F.col("after").alias("edge"), "before"), "edge", "left").select(
        "edge", F.coalesce("before", "edge").alias("first"), F.col("before").isNotNull().cast("long").alias("place")))
    while not (further := steps_.where("place > 0")).isEmpty():
        further = further.select(F.col("edge").alias("first"), F.col("first").alias("further"), F.col("place").alias("more"))
        met = checkpointed(steps_.join(further, "first", "left").select(
            "edge", F.coalesce("further", "first").alias("first"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("more").isNotNull().alias("moved")))
        steps_ = met.drop("moved")
        if met.where("moved").isEmpty():
            break
    placed = own.join(steps_, "edge")
    run = F.array_sort(F.collect_list(F.struct("place", F.get("v", F.lit(LONGEST - 2)).alias("word"), "u")))
    return placed.groupBy("first", "lang").agg(run.alias("run"), F.min("n").alias("n")).select(
        "lang", F.concat(F.get("run", F.lit(0))["u"], F.transform("run", lambda e: e["word"])).alias("words"), "n")


def windows(paths: DataFrame) -> DataFrame:
    """lang, phrase, n: the edges that the paths stand for."""
    at = F.explode(F.sequence(F.lit(1), F.size("words") - (LONGEST - 1)))
    return paths.select("lang", "words", "n", at.alias("at")).select("lang", F.slice("words", F.col("at"), LONGEST).alias("phrase"), "n")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, stands_for: int = STANDS_FOR, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; a text is cut at .,;:!? and line ends into pieces, these at spaces and tabs into words. A phrase has two
    to four words of one piece and occurs a times, `least` or more, overlaps counted. Cut after its first k words, the
    parts occur l and r times and the score is floor(2000000 a / (l + r)); the cut of the lowest score counts, the smallest k on
    a tie. A phrase is left out if a longer one that holds it occurs at least `stands_for` hundredths as often. n
    is the number of words of the language. The highest scores come first, then the highest a, then phrases in byte order.

    Only the longest grams are counted in the texts. They are the edges of a de Bruijn graph between overlapping
    nodes; unbranched paths of equal weight are joined, and shorter counts follow from what flows through a
    node and what ends there. Counts are whole numbers, scores are worked out in decimals of 38 digits.

    A null text is empty, a null language is `und`; texts without words give nothing, repeated rows count each, and no rows
    give no rows. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases, totals = counts(texts, least)
    known = checkpointed(phrases.where(F.size("phrase") < LONGEST).unionByName(windows(unary_paths(phrases))).select("lang", F.concat_ws(" ", "phrase").alias("phrase"), F.size("phrase").alias("k"), "n", F.col("phrase").alias("words")))
    candidates = known.where("k > 1")

    longer = candidates.where("k > 2").select("lang", F.col("n").alias("of_longer"), "words", "k")
    parts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.concat_ws(" ", F.slice("words", i, m))))))
    held = longer.select("lang", parts.alias("phrase"), "of_longer").groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("of_longer") < stands_for * F.col("n"), F.lit(True)))

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("cut"))).alias("left_part"),
                       F.concat_ws(" ", F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right_part"))
    number = known.select("lang", "phrase", "n")
    cuts = (cuts.join(number.withColumnsRenamed({"phrase": "left_part", "n": "l"}), ["lang", "left_part"])
            .join(number.withColumnsRenamed({"phrase": "right_part", "n": "r"}), ["lang", "right_part"]))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.select("lang", "phrase", "best.score", "best.a", "best.l", "best.r").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
