"""Helpers shared by the operators of this folder."""

import ctypes
import math
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; a longer single text makes a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also lets Python workers import this library from the place where the driver has it."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id written as text leaves this remainder; a null id leaves none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines share.

    Where the setting is missing, as in tests on a local master, a folder beside the warehouse is taken;
    a cluster without the setting is an error, as its machines share no other folder known here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores behind it where columns have it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def block_count(docs: DataFrame, text_col: str, block_bytes: int) -> int:
    """Blocks of about `block_bytes` that the texts fill."""
    return max(1, math.ceil(text_bytes(docs, text_col) / block_bytes))


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in order, in lists of about `limit` bytes; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)) if len(raw) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < len(raw):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield raw[start:stop].to_pylist()
        start, done = stop, int(ends[stop - 1])


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each run in the concatenation of runs of these lengths."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run; 0 for an empty one. Each run is added on its own, so its sum does not depend on the others."""
    out = np.zeros(len(lengths), values.dtype if values.dtype != bool else np.int64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts_of(lengths)[full], dtype=out.dtype)
    return out


def numbering() -> dict:
    """A dictionary that numbers keys from 0 as they are first asked for.

    The numbers come from a counter and not from the dictionary's own length: a dictionary that holds itself is freed only
    when Python next collects cycles, which tasks of numpy and bytes hardly ever bring about, so old ones would pile up.
    """
    return defaultdict(count().__next__)


def word_ids(words: list[list[bytes]], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the number of words of each text; `known` is a growing dictionary."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(counts.sum()))
    return ids, counts


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the machine; a worker else keeps the most it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
