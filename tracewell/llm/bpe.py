"""Byte pair encoding and decoding of whole texts: speculate by the longest match, verify, merge what fails."""

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import numbering, steps, sums
from tracewell.llm.pairs import Merges, Runs

#: Fixed: splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps before it starts anew.
KEPT_WORDS = 600_000


class Codec:
    """Encoding and decoding under a byte-level vocabulary, from the text of a tokenizer file."""

    def __init__(self, definition: str):
        self.merges = Merges(definition)
        self.split = regex.compile(PATTERN)
        self.special = {t["content"]: t["id"] for t in json.loads(definition).get("added_tokens", [])}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = self.merges.bytes_of | {i: t.encode() for t, i in self.special.items()}
        self.failed = 0
        self.forget()

    def forget(self) -> None:
        self.known = numbering()
        self.runs = Runs()

    def words(self, text: str) -> list:
        """The words of a text; a special token stands as its id."""
        if self.at_special is None or not any(t in text for t in self.special):
            return self.split.findall(text)
        out: list = []
        for part in self.at_special.split(text):
            out += [self.special[part]] if part in self.special else self.split.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        before, known = len(self.known), self.known
        counts, runs = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            words = self.words(text)
            counts[i] = len(words)
            runs.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        fresh = list(known)[before:]
        if fresh:
            ids, sizes, failed = self.merges.speculate([w.encode() if isinstance(w, str) else b"" for w in fresh])
            self.failed += failed
            whole = np.fromiter((-1 if isinstance(w, str) else w for w in fresh), np.int64, len(fresh))
            sizes[whole >= 0] = 1
            out = np.empty(int(sizes.sum()), np.int64)
            merged = np.repeat(whole < 0, sizes)
            out[merged], out[~merged] = ids, whole[whole >= 0]
            self.runs.add(out, sizes)
        ids, sizes = self.runs.take(np.concatenate([np.zeros(0, np.int64), *runs]))
        return ids, sums(sizes, counts)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(definition: str) -> Codec:
    """The codec of a tokenizer file, made once by a worker process."""
    return Codec(definition)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with an array of ids `out`.

    A null or empty text has no ids. Repeated rows get equal ids; other columns are kept, and one named as `out` is
    replaced. Texts of any length are encoded whole; nothing is shuffled.
    """
    definition = _shared(docs, tokenizer_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(definition.value)
        for batch in batches:
            found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for raw in steps(batch):
                a, n = codec.encode([t.decode() for t in raw])
                found.append(a)
                counts.append(n)
            ends = np.append(0, np.cumsum(np.concatenate(counts)))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))

    return docs.withColumn(out, ids.asNondeterministic()(F.col(text_col)))


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text `out` of the ids; a null array gives an empty text, and an unknown id is an error."""
    definition = _shared(rows, tokenizer_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(definition.value)
        for batch in batches:
            yield pa.array([codec.decode(x.as_py() or []) for x in batch], pa.string())

    return rows.withColumn(out, text.asNondeterministic()(F.col(ids_col)))


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the text decoded from them.

    encode() and decode() in one step, for checks over whole tables: neither ids nor decoded texts leave the worker.
    Ids are digested as little-endian unsigned 32-bit integers, the text as UTF-8. Rows as in encode().
    """
    definition = _shared(docs, tokenizer_path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(definition.value)
        for batch in batches:
            rows = []
            for raw in steps(batch):
                ids, counts = codec.encode([t.decode() for t in raw])
                end = 0
                for n in counts.tolist():
                    own, end = ids[end:end + n], end + n
                    text = codec.decode(own.tolist())
                    rows.append((n, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                                             ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, digest.asNondeterministic()(F.col(text_col)).alias("__d")).select(id_col, "__d.*")


def _shared(df: DataFrame, tokenizer_path: str):
    """The tokenizer file, whose size does not depend on the data, broadcast as text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
