"""Probability of texts by partial matching: a trie of byte contexts with escapes and symbol exclusion."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import block_count, checkpointed, steps, sums

#: Bytes of the longest context.
DEPTH = 5
#: Symbols that no UTF-8 text holds: before the first byte of a text, and after its last one.
START, END = 0xFE, 0xFF
#: Bytes below START, and the end.
ALPHABET = 255
#: Text bytes that one task scores at a time.
BLOCK_BYTES = 16 << 20
#: Text bytes that one numpy step works on; each takes some forty bytes there.
STEP_BYTES = 1 << 20
#: Grams of the trie, and text bytes of the questions about them, for each part that answers the questions.
PART_GRAMS = 200_000
PART_BYTES = 64 << 20

_BITS = 8 * (DEPTH + 1)


def gram_codes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text its gram of DEPTH + 1 symbols, and the number of symbols of each text.

    A gram is written newest symbol first, so that the leading bytes are the shorter grams that end at the symbol.
    """
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    line = b"".join([*(bytes([START]) * DEPTH + t + bytes([END]) for t in raw), bytes(8)])
    # Eight bytes from any place on, read as one little-endian number: the newest symbol of a gram is its highest byte.
    eight = np.ndarray(len(line) - 7, "<u8", line, strides=1)
    codes = eight[np.arange(int(sizes.sum())) + np.repeat(DEPTH * np.arange(len(raw)), sizes)]
    codes &= np.uint64((1 << _BITS) - 1)
    return codes.astype(np.uint64, copy=False), sizes


def distinct_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts."""
    ordered = np.sort(codes)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def looked_up(codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each code, given sorted keys that hold them all. Codes are sorted along with their places."""
    low, out = np.uint64(64 - _BITS), np.empty(len(codes))
    for start in range(0, len(codes), 1 << int(low)):
        part = codes[start:start + (1 << int(low))]
        packed = np.sort(part << low | np.arange(len(part), dtype=np.uint64))
        ordered, place = packed >> low, (packed & np.uint64((1 << int(low)) - 1)).astype(np.int64)
        first = np.append(True, ordered[1:] != ordered[:-1])
        found = values[np.searchsorted(keys, ordered[first])]
        out[start + place] = found[np.cumsum(first) - 1]
    return out


def packed(codes: np.ndarray) -> bytes:
    """Codes in as many bytes as they need."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BITS // 8].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(-1, _BITS // 8)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :_BITS // 8] = own
    return out.view("<u8").ravel().astype(np.uint64)


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    own, where = np.unique(keys, return_inverse=True)
    return own, np.bincount(where, values, len(own)).astype(np.int64)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is none of the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0)


def log_probabilities(code: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of the newest symbol of each gram after the rest of it.

    The grams are all those with the same two symbols before the newest one, so that they hold every count of the
    contexts of two symbols or more; `pairs` has the counts of symbols (rows) after one symbol (columns). Every
    context has the number N of symbols that followed it, the number T of different ones, and X, what these have
    together in the next shorter context. The longest context that the training texts hold gives its symbols 2 n - 1
    of 2 N and the escape T of 2 N. After an escape, the symbols of the longer context are excluded from the shorter
    one: its N is less by X and its T by the longer one's T. Beyond the empty context all symbols never seen share
    what is left alike.
    """
    single = pairs.sum(axis=1)
    known, symbols = n > 0, code >> np.uint64(8 * DEPTH)
    grams = {k: _totals(code[known] >> np.uint64(8 * (DEPTH - k)), n[known]) for k in range(2, DEPTH + 1)}
    out, done = np.zeros(len(code)), np.zeros(len(code), bool)
    kinds_above, shared_above = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    for k in range(DEPTH, -1, -1):
        if k >= 2:
            gram, count = grams[k]
            mask = np.uint64((1 << (8 * k)) - 1)
            shorter = _at(*grams[k - 1], gram >> np.uint64(8)) if k > 2 else pairs[(gram >> np.uint64(16)).astype(np.int64), (gram >> np.uint64(8) & np.uint64(255)).astype(np.int64)]
            context, total = _totals(gram & mask, count)
            own = code >> np.uint64(8 * (DEPTH - k))
            here = _at(gram, count, own)
            all_, kinds, shared = (_at(context, v, own & mask) for v in (total, _totals(gram & mask, np.ones(len(gram)))[1], _totals(gram & mask, shorter)[1]))
        elif k == 1:
            before = (code >> np.uint64(8 * (DEPTH - 1)) & np.uint64(255)).astype(np.int64)
            here = pairs[symbols.astype(np.int64), before]
            all_, kinds, shared = pairs.sum(axis=0)[before], (pairs > 0).sum(axis=0)[before], ((pairs > 0) * single[:, None]).sum(axis=0)[before]
        else:
            here, shared = single[symbols.astype(np.int64)], np.zeros(len(code), np.int64)
            all_, kinds = np.full(len(code), single.sum()), np.full(len(code), (single > 0).sum())
        left, new = all_ - shared_above, kinds - kinds_above
        hit = here > 0
        share = np.where(hit, 2 * here - 1, new) / np.maximum(1, 2 * left)
        step = ~done & (left > 0)
        out[step] += np.log10(share[step])
        done |= hit
        kinds_above, shared_above = kinds, shared
    return np.where(done, out, out - np.log10(max(1, ALPHABET - (single > 0).sum())))


def gram_probabilities(counts: DataFrame) -> DataFrame:
    """code and log_p of each gram of `counts`, which has code and n, its count in the training texts, 0 if none.

    The trie is dealt by the two symbols before the newest one, at most 2^16 branches; each is worked on alone, beside
    the counts of pairs of symbols, at most 2^16, which all share.
    """
    pair = F.shiftrightunsigned("code", 8 * (DEPTH - 1))
    pairs = np.zeros((256, 256), np.int64)
    for r in counts.where("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    branch = F.shiftrightunsigned("code", 8 * (DEPTH - 2)).bitwiseAND(F.lit(0xFFFF))

    def known(rows: pa.Table) -> pa.Table:
        code = rows["code"].to_numpy().astype(np.uint64)
        return pa.table([rows["code"], pa.array(log_probabilities(code, rows["n"].to_numpy(), pairs))], names=["code", "log_p"])

    return counts.withColumn("branch", branch).groupBy("branch").applyInArrow(known, "code long, log_p double")


def _gram_counts(docs: DataFrame) -> DataFrame:
    """Every gram of the texts with its count in those that `trained` marks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trained, at = np.array(batch.column(1).to_pylist(), bool), 0
            for raw in steps(batch.column(0), STEP_BYTES):
                own, at = trained[at:at + len(raw)], at + len(raw)
                codes, sizes = gram_codes([t.lower() for t in raw])
                mine = np.repeat(own, sizes)
                keys, n = distinct_codes(codes[mine])
                others = np.setdiff1d(distinct_codes(codes[~mine])[0], keys, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, others]).astype(np.int64)), pa.array(np.append(n, np.zeros(len(others), np.int64)))],
                                                 names=["code", "n"])

    return docs.select("text", "trained").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _distinct_of(texts: pa.ChunkedArray) -> np.ndarray:
    own = [distinct_codes(gram_codes([t.lower() for t in raw])[0])[0] for raw in steps(texts, STEP_BYTES)]
    return distinct_codes(np.concatenate([np.zeros(0, np.uint64), *own]))[0]


def _by_part(codes: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    """The sorted codes dealt into parts, and the bounds of the parts."""
    part = (codes % np.uint64(parts)).astype(np.int64)
    return codes[np.argsort(part, kind="stable")], [0, *np.cumsum(np.bincount(part, minlength=parts)).tolist()]


def _gram_answers(placed: DataFrame, log_p: DataFrame, parts: int) -> DataFrame:
    """For every block and part the probabilities of the block's distinct grams, in their order: block, part, logs.

    A block sends its grams to the parts of the trie. In a part the trie comes first, by the sort within partitions,
    and the questions stream past it, so a task holds its part of the trie and one question at a time.
    """
    def ask(block: pa.Table) -> pa.Table:
        codes, bounds = _by_part(_distinct_of(block["text"]), parts)
        rows = [(p, packed(codes[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        number = block["block"][0].as_py()
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()),
                         pa.nulls(len(rows), pa.float64()), pa.array([c for _, c in rows], pa.binary())], names=["part", "block", "code", "log_p", "codes"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, logs, ready = None, [], [], None
        for batch in batches:
            rows = batch.to_pydict()
            out = ([], [], [])
            for p, block, code, log_p_, codes in zip(*(rows[c] for c in ("part", "block", "code", "log_p", "codes"))):
                if p != part:
                    part, keys, logs, ready = p, [], [], None
                if block is None:
                    keys.append(code)
                    logs.append(log_p_)
                    continue
                if ready is None:
                    ready = np.array(keys, np.uint64), np.array(logs, np.float32)
                out[0].append(block)
                out[1].append(p)
                out[2].append(ready[1][np.searchsorted(ready[0], unpacked(codes))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["block", "part", "logs"])

    trie = log_p.select(F.pmod("code", F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("block"), "code", "log_p", F.lit(None).cast("binary").alias("codes"))
    asked = placed.groupBy("block").applyInArrow(ask, "part int, block int, code long, log_p double, codes binary")
    both = trie.unionAll(asked).repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first(), "code")
    return both.mapInArrow(answer, "block int, part int, logs binary")


def _word_answers(placed: DataFrame) -> DataFrame:
    """For every block its distinct words with their counts in the training texts, and whether the block is the first
    that has the word: block, word, n, first."""
    def ask(block: pa.Table) -> pa.Table:
        trained, words, others, at = block["trained"].to_numpy(), Counter(), set(), 0
        for raw in steps(block["text"], STEP_BYTES):
            own, at = trained[at:at + len(raw)], at + len(raw)
            for text, yes in zip(raw, own):
                (words if yes else others).update(text.lower().split())
        others.difference_update(words)
        n = np.append(np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(others), np.int64))
        return pa.table([pa.array(np.full(len(n), block["block"][0].as_py(), np.int32)), pa.array([*words, *others], pa.binary()), pa.array(n)], names=["block", "word", "n"])

    asked, of_word = placed.groupBy("block").applyInArrow(ask, "block int, word binary, n long"), Window.partitionBy("word")
    return asked.select("block", "word", F.sum("n").over(of_word).alias("n"), (F.min("block").over(of_word) == F.col("block")).alias("first"))


def score(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """log10 probability of every text under the trie learned from the texts that `trained` marks, beside word counts.

    Returns `id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score. A-Z are lower-cased; the score is
    that of the bytes and the end of the text. Tokens are the words and one end; the base is the add-one unigram.

    The texts are dealt into blocks by a hash. A block asks for its distinct grams and words once, the counts over
    all texts are made where the questions meet, and the answers come back to the block, which then scores its
    texts. So a text is shuffled once, a gram or word that stands in many texts is asked for once by each block, and
    neither trie nor word counts need to fit in a task.

    A null text is an empty one, which still has its end. Repeated rows are scored each and count as often in the
    training; a null id counts as held in. Other columns are not read; no rows give no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    counts = checkpointed(_gram_counts(texts))
    blocks = block_count(docs, text_col, block_bytes)
    parts = max(1, -(-counts.count() // PART_GRAMS), -(-blocks * block_bytes // PART_BYTES))
    ends = texts.where("trained").count()
    placed = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    grams, words = _gram_answers(placed, gram_probabilities(counts), parts), _word_answers(placed)
    null = lambda kind: F.lit(None).cast(kind)
    answers = grams.select("block", "part", "logs", null("binary").alias("word"), null("long").alias("n"), null("boolean").alias("first")).unionAll(
        words.select("block", null("int"), null("binary"), "word", "n", "first"))

    def tell(block: pa.Table, answer: pa.Table) -> pa.Table:
        columns = []
        is_word = pc.is_null(answer["part"])
        about_words, about_grams = answer.filter(is_word), answer.filter(pc.invert(is_word))
        n, first = about_words["n"].to_numpy(), about_words["first"].to_numpy()
        word = dict(zip(about_words["word"].to_pylist(), n.tolist()))
        codes, bounds = _by_part(_distinct_of(block["text"]), parts)
        logs = np.zeros(len(codes))
        for p, own in zip(about_grams["part"].to_pylist(), about_grams["logs"].to_pylist()):
            logs[bounds[p]:bounds[p + 1]] = np.frombuffer(own, np.float32)
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        for raw in steps(block["text"], STEP_BYTES):
            raw = [t.lower() for t in raw]
            symbols, sizes = gram_codes(raw)
            total = sums(looked_up(symbols, codes, logs), sizes)
            tokens = [t.split() for t in raw]
            n_words = np.fromiter(map(len, tokens), np.int64, len(raw))
            c = np.fromiter((word[w] for ws in tokens for w in ws), np.int64, int(n_words.sum()))
            columns.append((n_words + 1, sums(c > 0, n_words) + (ends > 0), sums(np.log10(c + 1.0), n_words) + np.log10(ends + 1), total))
        own = [np.concatenate(c) for c in zip(*columns)]
        kinds, train_words = np.zeros((2, len(block)), np.int64)
        kinds[:1], train_words[:1] = (first & (n > 0)).sum(), n[first].sum()
        return pa.table([block["id"], block["trained"], *map(pa.array, (*own, kinds, train_words))], names=told.names)

    told = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("trained", T.BooleanType()),
                         *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("logs", T.DoubleType()),
                                                            ("score", T.DoubleType()), ("kinds", T.LongType()), ("train_words", T.LongType())))])
    scored = checkpointed(placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell, told))
    totals = scored.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"), F.coalesce(F.sum("train_words"), F.lit(0)).alias("n")).first()
    train_tokens, kinds = totals["n"] + ends, totals["v"] + (ends > 0)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + kinds + 1)))
    return scored.select(F.col("id").alias(id_col), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
