"""Packing of tokenised texts into sequences: shortest pack first over the histogram of lengths."""

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tracewell.llm.common import checkpointed, numbering, release, starts_of, steps, sums, word_ids
from tracewell.llm.pairs import Merges, Runs
from tracewell.llm.ranks import numbered

CAPACITY = 4096
#: Id that ends every document.
END_ID = 2
#: Words whose ids a task keeps before it starts anew.
KEPT_WORDS = 250_000
#: Text bytes that one numpy step works on.
STEP_BYTES = 2 << 20


#: A run of plain letters, then one of plain punctuation: two words of their own under the tokenizer, whose normal
#: form is lower case. Others, as with digits, apostrophes or marks, are left to the tokenizers library.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


class WordTokens:
    """Ids of texts under a tokenizer that drops white space, so that each run of other characters stands alone.

    Each distinct run is encoded once by a task: plain ones by merging many at a time, the rest by the library.
    """

    def __init__(self, definition: str):
        self.tokenizer, self.merges = Tokenizer.from_str(definition), Merges(definition)
        self.forget()

    def forget(self) -> None:
        self.known, self.parts = numbering(), numbering()
        self.runs, self.part_runs = Runs(), Runs()

    def _learn(self, fresh: list[str]) -> None:
        before, split, others = len(self.parts), [], []
        for w in fresh:
            plain = PLAIN.fullmatch(w)
            if plain is None:
                others.append(w)
                split.append((self.parts[None, w],))
            else:
                letters, marks = plain.groups()
                split.append((self.parts[letters.lower()], self.parts[marks]) if marks else (self.parts[letters.lower()],))
        new = list(self.parts)[before:]
        plain_ids, plain_sizes = self.merges.exact([w.encode() for w in new if isinstance(w, str)])
        other_ids = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        sizes, ids = np.zeros(len(new), np.int64), np.zeros(0, np.uint32)
        is_plain = np.fromiter((isinstance(w, str) for w in new), bool, len(new))
        sizes[is_plain], sizes[~is_plain] = plain_sizes, np.fromiter(map(len, other_ids), np.int64, len(other_ids))
        ids = np.zeros(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(is_plain, sizes)
        ids[of_plain], ids[~of_plain] = plain_ids, np.fromiter((i for x in other_ids for i in x), np.uint32)
        self.part_runs.add(ids, sizes)
        n_parts = np.fromiter(map(len, split), np.int64, len(split))
        ids, sizes = self.part_runs.take(np.fromiter((p for s in split for p in s), np.int64, int(n_parts.sum())))
        self.runs.add(ids, sums(sizes, n_parts))

    def encode(self, raw: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by `end_id`, and the number of ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        before = len(self.known)
        words, counts = word_ids([t.split() for t in raw], self.known)
        if len(self.known) > before:
            self._learn([w.decode() for w in list(self.known)[before:]])
        body_ids, sizes = self.runs.take(words)
        n_tokens = sums(sizes, counts) + 1
        out = np.full(int(n_tokens.sum()), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(n_tokens) - 1] = False
        out[body] = body_ids
        return out, n_tokens


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most `capacity` ids: `id_col`, start, length, ids_crc32, doc_tokens."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokens = WordTokens(definition.value)  # made in a third of a second; a worker that kept it had less room for other work
        for batch in batches:
            at = 0
            for raw in steps(batch.column(1), STEP_BYTES):
                ids, counts = tokens.encode(raw, end_id)
                n_pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(raw)), n_pieces)
                start = (np.arange(len(owner)) - np.repeat(starts_of(n_pieces), n_pieces)) * capacity
                length = np.minimum(capacity, counts[owner] - start)
                first = starts_of(counts)[owner] + start
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), (first + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + owner)), *map(pa.array, (start, length, np.array(crc, np.int64), counts[owner]))],
                    names=schema.names)
                at += len(raw)
            release()
        del tokens
        release()

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts for a histogram of lengths.

    Lengths are placed longest first, each into the open pattern with the most free space, that is the shortest pack;
    where it fits nowhere, new sequences take as many of the length as they hold. Only counts move: all sequences of
    a pattern take a length at once, so the work depends on the number of lengths and patterns, not of documents.
    """
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not free[top]:
                top -= 1
            if top >= length:
                pattern, count = free[top].pop()
                used = min(count, left)
                if used < count:
                    free[top].append((pattern, count - used))
                free[top - length].append(((*pattern, length), used))
                left -= used
                continue
            each = capacity // length
            for copies, count in ((each, left // each), (left % each, 1)):
                if copies and count:
                    free[capacity - copies * length].append(((length,) * copies, count))
                    top = max(top, capacity - copies * length)
            left = 0
    return [p for room in sorted(free) for p in free[room]]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of every place in every pattern."""
    out, taken, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most `capacity` ids: the pieces with `sequence_id` and `offset`.

    A text is its ids under the tokenizer, then `end_id`; a longer one is cut every `capacity` ids. Pieces of a length
    are numbered, and a number finds its pattern, sequence and offset. The driver holds the histogram and the
    patterns alone, whose number depends on `capacity`; the table of places is broadcast for the same reason.

    A null text is an empty one, of one id. Repeated rows are packed each; other columns are not read; no rows give
    no rows. Ties between pieces of equal length are settled by id, start and checksum.
    """
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = placements(shortest_pack_first(histogram, capacity))
    found = spark.createDataFrame(places, "length long, __from long, __to long, __sequence long, __offset long")
    ranked = numbered(cut, ["length"], [id_col, "start", "ids_crc32", "doc_tokens"], "__rank")
    at = F.broadcast(found).alias("p")
    here = (F.col("r.length") == F.col("p.length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    return ranked.alias("r").join(at, here).select(
        f"r.{id_col}", "start", "r.length", "ids_crc32", "doc_tokens",
        (F.col("__sequence") + F.col("__rank") - F.col("__from")).alias("sequence_id"), F.col("__offset").alias("offset"))
