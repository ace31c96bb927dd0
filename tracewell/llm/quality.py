"""Quality of texts: classifiers over the shape of the text, learned from trusted texts and unlabelled ones."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import nnpu
from tracewell.llm.common import numbering, starts_of, steps, sums, word_ids

#: Bounds of the sample that the classifiers are fitted to.
MAX_POSITIVE = 6000
MAX_UNLABELLED = 12000
RIDGE = 1e-4
#: Each measure falls into the class of the highest edge that it reaches.
SHARES = (1e-9, 0.002, 0.01, 0.03, 0.06, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8)
LENGTHS = (2, 3, 4, 5, 6, 7, 8, 10, 14, 20)
COUNTS = (1, 10, 25, 50, 100, 200, 500, 1000, 3000, 10000)
MARKS = b"#*$%&|<>"
#: Words whose shape a worker keeps before it starts anew.
KEPT_WORDS = 600_000

#: What is asked of a word, by name.
WORD_FLAGS = ("capitals", "marks", "run_of_marks", "digits", "no_letter", "short", "long", "ends_clause", "inner_capital")
MEASURES = {**dict.fromkeys((*WORD_FLAGS, "as_before", "distinct", "commonest", "repeated_threes", "repeated_lines"), SHARES), "word_bytes": LENGTHS, "words": COUNTS}
WIDTH = sum(len(edges) + 1 for edges in MEASURES.values())

_NO_MARK = bytes(i for i in range(256) if i not in MARKS)
_LETTERS = bytes(i for i in range(256) if chr(i).isascii() and chr(i).isalpha() or i >= 128)


def word_flags(word: bytes) -> list[bool]:
    """The flags of WORD_FLAGS."""
    text = word.decode()
    ends = word[-1:]
    return [len(text) > 1 and text.isupper(), word.translate(None, _NO_MARK) != b"", len(word) > 1 and ends == word[-2:-1] and not ends.isalnum() and ends < b"\x80",
            any(c.isdigit() for c in text), word.translate(None, _LETTERS) == word, len(text) <= 2, len(text) > 16, ends in b".,;:!?",
            len(text) > 2 and not text.isupper() and text[1:] != text[1:].lower()]


class Shapes:
    """Measures texts; the flags of each distinct word are kept."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known = numbering()
        self.flags = np.zeros((0, len(WORD_FLAGS) + 1), np.float32)

    def measure(self, raw: list[bytes]) -> dict[str, np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        before = len(self.known)
        ids, counts = word_ids([t.split() for t in raw], self.known)
        fresh = list(self.known)[before:]
        if fresh:
            self.flags = np.concatenate([self.flags, np.array([[*word_flags(w), len(w)] for w in fresh], np.float32)])
        n = np.maximum(1, counts)
        own = self.flags[ids]
        out = {name: sums(own[:, i].astype(np.float64), counts) / n for i, name in enumerate(WORD_FLAGS)}
        text = np.repeat(np.arange(len(raw)), counts)
        same = np.append(False, (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])) if len(ids) else np.zeros(0, bool)
        out["as_before"] = sums(same, counts) / n
        each, times = np.unique(text * (len(self.known) + 1) + ids, return_counts=True)
        distinct = np.bincount(each // (len(self.known) + 1), minlength=len(raw))
        most = np.zeros(len(raw), np.int64)
        full = distinct > 0
        if full.any():
            most[full] = np.maximum.reduceat(times, starts_of(distinct)[full])
        out["distinct"], out["commonest"] = distinct / n, most / n
        out["repeated_threes"] = _repeated_threes(ids, text, len(raw)) / n
        lines = [t.split(b"\n") if b"\n" in t else () for t in raw]
        out["repeated_lines"] = np.array([(len(x) - len(set(x))) / len(x) if x else 0.0 for x in lines])
        out["word_bytes"], out["words"] = sums(own[:, -1].astype(np.float64), counts) / n, counts
        return out

    def features(self, raw: list[bytes]) -> np.ndarray:
        """One row of feature numbers for each text: the class of every measure."""
        found, columns, first = self.measure(raw), [], 0
        for name, edges in MEASURES.items():
            columns.append(first + np.searchsorted(edges, found[name], "right"))
            first += len(edges) + 1
        return np.stack(columns, axis=1) if raw else np.zeros((0, len(MEASURES)), np.int64)


def _repeated_threes(ids: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Number of three-word windows of each text that occurred in it before; windows are told apart by a 64-bit mix."""
    if len(ids) < 3:
        return np.zeros(n_texts)
    inside = text[2:] == text[:-2]
    u = ids.astype(np.uint64)
    mixed = text[2:].astype(np.uint64)
    for part in (u[:-2], u[1:-1], u[2:]):
        mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    windows = np.bincount(text[2:][inside], minlength=n_texts)
    order = np.sort(mixed[inside] >> np.uint64(20) | (text[2:][inside].astype(np.uint64) << np.uint64(44)))
    new = np.append(True, order[1:] != order[:-1])
    return windows - np.bincount((order >> np.uint64(44)).astype(np.int64)[new], minlength=n_texts)


def fit(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> nnpu.Model:
    """The classifier, from rows of `labels` and `docs` where `trusted` (on the id) holds.

    Only the ids labelled 1 are used as labels; all other rows, labelled or not, serve as unlabelled text.
    """
    trusted = F.lit(True) if trusted is None else trusted
    positives = labels.where(trusted & (F.col(label_col) == 1))
    sample = nnpu.sample(docs, positives, trusted, id_col, text_col, MAX_POSITIVE, MAX_UNLABELLED)

    @F.arrow_udf("array<int>")
    def present(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes = Shapes()
        for batch in batches:
            yield pa.array([row for raw in steps(batch) for row in shapes.features(raw).tolist()], pa.list_(pa.int32()))

    return nnpu.train(sample.select("positive", "id_hash", present(F.col("text")).alias("features")), WIDTH, ridge=RIDGE)


def score(docs: DataFrame, model: nnpu.Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """The rows with the probability `out` of good quality, from 0 to 1.

    A null or empty text has the shape of a text without words and gets the probability of that. Repeated rows get
    equal scores; other columns are kept, and one named as `out` is replaced. Nothing is shuffled; the model's size
    is fixed.
    """
    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes = Shapes()
        for batch in batches:
            z = [model.weights[shapes.features(raw)].sum(axis=1) for raw in steps(batch)]
            yield pa.array(nnpu.sigmoid(np.concatenate([np.zeros(0), *z]) + model.bias), pa.float64())

    return docs.withColumn(out, probability.asNondeterministic()(F.col(text_col)))
