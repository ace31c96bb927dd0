"""Language of texts: interpolated Kneser-Ney models over characters, one for each language."""

import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import starts_of, steps, sums

ORDER = 4
#: Bound of the sample that each language is learned from, in characters.
MAX_CHARS = 2_000_000
#: One text in so many of the sample is kept for the calibration.
CALIBRATION = 5
#: Share of a language's own texts that the rejection lets through.
ACCEPTED = 0.999
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case, or 0 where it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the grams that end at each character, hashes of their contexts, characters and letters of each text.

    Runs of other characters count as one blank; blanks at the start are dropped and three stand before each text.
    The first list has the grams of 1, 2, ... characters, the second the contexts of 1, 2, ... characters.
    """
    joined = b"".join(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    points = sums((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80, sizes)
    chars = letters()[np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)]
    text = np.repeat(np.arange(len(raw)), points)
    first = np.zeros(len(chars) + 1, bool)
    first[starts_of(points)] = True
    blank = chars == 0
    keep = ~blank | ~(np.append(True, blank[:-1]) | first[:-1])
    n_letters = sums(~blank, points)
    chars, text = chars[keep], text[keep]
    counts = np.bincount(text, minlength=len(raw))
    at = np.arange(len(chars)) + (ORDER - 1) * (text + 1)
    line = np.zeros(len(chars) + (ORDER - 1) * len(raw), np.uint64)
    line[at] = chars
    hashes, h = [], np.zeros(len(line), np.uint64)
    for k in range(ORDER):
        shifted = np.zeros(len(line), np.uint64)
        shifted[k:] = line[:len(line) - k]
        h = h * _STEP + shifted + np.uint64(1)
        hashes.append(h ^ h >> np.uint64(31))
    return [x[at] for x in hashes], [x[at - 1] for x in hashes[:-1]], counts, n_letters


def discounted(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of each key in its context after the discount; the contexts, sorted; the share that the discount frees."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    discount = ones / (ones + 2 * twos) if ones else 0.5
    own, where = np.unique(contexts, return_inverse=True)
    total, kinds = np.bincount(where, counts), np.bincount(where)
    return np.maximum(counts - discount, 0) / total[where], own, discount * kinds / total


class Model(NamedTuple):
    """Languages in order, and for each order sorted hashes with one column of values for each language."""
    languages: list[str]
    keys: list[np.ndarray]
    values: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    scale: float
    limits: np.ndarray
    means: np.ndarray

    def log_probability(self, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of each gram's last character, one column for each language."""
        p = np.full((len(gram[0]), len(self.languages)), 1.0 / sys.maxunicode)
        for k in range(ORDER):
            free = _at(self.contexts[k], self.weights[k], context[k - 1], 1.0) if k else self.weights[0]
            p = _at(self.keys[k], self.values[k], gram[k], 0.0) + free * p
        return np.log(p)

    def entropies(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text by character, one column for each language; characters; letters."""
        gram, context, counts, n_letters = grams(raw)
        _, first, where = np.unique(gram[-1], return_index=True, return_inverse=True)
        logs = self.log_probability([g[first] for g in gram], [c[first] for c in context])
        total = np.stack([sums(logs[:, i][where], counts) for i in range(len(self.languages))], axis=1)
        return -total / np.maximum(1, counts)[:, None], counts, n_letters


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[place] == wanted)[:, None], values[place], missing)


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """The tables of one language from its distinct grams of the highest order with their counts.

    The highest order uses the counts; each lower one counts in how many longer grams a gram is met.
    """
    gram = [rows[f"g{k}"].to_numpy(np.int64).view(np.uint64) for k in range(1, ORDER + 1)]
    context = [rows[f"c{k}"].to_numpy(np.int64).view(np.uint64) for k in range(1, ORDER)]
    counts = rows["n"].to_numpy(np.float64)
    out = {"lang": [rows["lang"].iloc[0]]}
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            _, first, counts = np.unique(gram[k - 1], return_index=True, return_counts=True)
            gram, context, counts = [g[first] for g in gram], [c[first] for c in context], counts.astype(np.float64)
        above = context[k - 2] if k > 1 else np.zeros(len(counts), np.uint64)
        share, own, free = discounted(gram[k - 1], above, counts)
        order = np.argsort(gram[k - 1])
        out[f"keys{k}"], out[f"values{k}"] = [gram[k - 1][order].tobytes()], [share[order].tobytes()]
        out[f"contexts_of_{k - 1}"], out[f"weights_of_{k - 1}"] = [own.tobytes()], [free.tobytes()]
    return pd.DataFrame(out)


def _joined(rows: list, key: str, value: str, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of the hashes of all languages, and a column of values for each."""
    own = [(np.frombuffer(r[key], np.uint64), np.frombuffer(r[value], np.float64)) for r in rows]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in own)]))
    values = np.full((len(keys), len(rows)), missing)
    for i, (k, v) in enumerate(own):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def fit(docs: DataFrame, trusted: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        max_chars: int = MAX_CHARS) -> Model:
    """Models of the languages that `lang_col` names, from rows where `trusted` holds and text and language are known.

    A language with more than about `max_chars` characters is learned from whole texts drawn by a hash of id and text at
    the rate that gives so many, so the model's size is bounded by the number of languages; rows equal in both count
    once. A fifth of the sample is kept back: it gives the scale that turns entropies into probabilities, and for each
    language the limit above which a text is rejected. The text of least hash is always learned from, so a language
    with a letter in any text is never missing. Null ids hash like others; no known rows give a model of no language.
    """
    trusted = F.lit(True) if trusted is None else trusted
    known = docs.where(trusted & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    least = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("draw"))).alias("least")
    totals = known.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), least).collect()
    if not totals:
        return Model([], [], [], [], [], 1.0, np.zeros(0), np.zeros(0))
    per_lang = lambda value: F.element_at(F.create_map(*(F.lit(x) for r in totals for x in (r["lang"], value(r)))), F.col("lang"))
    rate = per_lang(lambda r: min(1.0, max_chars / max(1, r["n"])))
    first = F.coalesce(F.col("draw") == per_lang(lambda r: r["least"] or 0), F.lit(False))
    drawn = known.where((F.pmod("draw", F.lit(1 << 20)) < rate * (1 << 20)) | first).dropDuplicates(["lang", "draw"])
    kept_back = (F.pmod(F.shiftright("draw", 20), F.lit(CALIBRATION)) == 0) & ~first
    columns = [*(f"g{k}" for k in range(1, ORDER + 1)), *(f"c{k}" for k in range(1, ORDER))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at = np.array(batch.column(0).to_pylist(), object), 0
            for raw in steps(batch.column(1)):
                own, at = langs[at:at + len(raw)], at + len(raw)
                for lang in sorted(set(own)):
                    gram, context, _, _ = grams([t for t, x in zip(raw, own) if x == lang])
                    _, first, n = np.unique(gram[-1], return_index=True, return_counts=True)
                    found = [x[first].view(np.int64) for x in (*gram, *context)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *map(pa.array, found), pa.array(n)], names=["lang", *columns, "n"])

    counted = drawn.where(~kept_back).select("lang", "text").mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in columns) + ", n long")
    distinct = counted.groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    names = [f"{a}{k}" for k in range(ORDER, 0, -1) for a in ("keys", "values")] + [f"{a}_of_{k}" for k in range(ORDER) for a in ("contexts", "weights")]
    rows = sorted(distinct.groupBy("lang").applyInPandas(_learn, "lang string, " + ", ".join(f"{n} binary" for n in names)).collect(), key=lambda r: r["lang"])
    if not rows:
        return Model([], [], [], [], [], 1.0, np.zeros(0), np.zeros(0))
    keys, values = zip(*(_joined(rows, f"keys{k}", f"values{k}", 0.0) for k in range(1, ORDER + 1)))
    contexts, weights = zip(*(_joined(rows, f"contexts_of_{k}", f"weights_of_{k}", 1.0) for k in range(ORDER)))
    languages = [r["lang"] for r in rows]
    rough = Model(languages, list(keys), list(values), list(contexts), list(weights), 1.0, np.full(len(rows), np.inf), np.zeros(len(rows)))
    return _calibrated(rough, drawn.where(kept_back).select("lang", "text"))


def _calibrated(model: Model, texts: DataFrame) -> Model:
    """The model with its scale and limits, from a bounded sample of texts whose languages are known."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in steps(batch.column(1)):
                entropy, counts, n_letters = shared.value.entropies(raw)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.array(list(entropy.astype(np.float64)), pa.list_(pa.float64())), pa.array(np.where(n_letters > 0, counts, 0))],
                                                 names=["lang", "entropy", "n"])
                at += len(raw)

    seen = [r for r in texts.mapInArrow(measure, "lang string, entropy array<double>, n long").collect() if r["n"] > 0]
    means, limits = np.zeros(len(model.languages)), np.full(len(model.languages), np.inf)
    right = np.array([model.languages.index(r["lang"]) if r["lang"] in model.languages else -1 for r in seen], np.int64)
    if not (right >= 0).any():
        return model._replace(scale=10.0)
    entropy, n = np.array([r["entropy"] for r in seen])[right >= 0], np.array([r["n"] for r in seen], np.float64)[right >= 0]
    right = right[right >= 0]
    own = entropy[np.arange(len(right)), right]
    scales = 2.0 ** np.arange(-2, 9)
    loss = [(np.logaddexp.reduce(-s * entropy, axis=1) + s * own).mean() for s in scales]
    for i in range(len(model.languages)):
        mine = right == i
        if mine.any():
            means[i] = np.average(own[mine], weights=n[mine])
            limits[i] = np.quantile((own[mine] - means[i]) * np.sqrt(n[mine]), ACCEPTED)
    return model._replace(scale=float(scales[int(np.argmin(loss))]), means=means, limits=limits)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """The rows with a struct `out`: lang, score (0 to 1), cross_entropy, rejected.

    The language is the one of least cross-entropy by character, the first by name on a tie; the score is its share
    after scaling. `rejected` is true where the entropy is beyond what the language's own texts of that length show.
    A null text, one without a letter, or any text where no language was learned gives 'und', score 0, no entropy and
    rejected. Repeated rows get equal results; other columns are kept, and one named as `out` is replaced. Nothing is
    shuffled; the model is broadcast, its size bounded by fit().
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, cross_entropy double, rejected boolean")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_found(shared.value, raw) for raw in steps(batch)] or [_found(shared.value, [])]
            yield pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], ["lang", "score", "cross_entropy", "rejected"])

    return docs.withColumn(out, find.asNondeterministic()(F.col(text_col)))


def _found(model: Model, raw: list[bytes]) -> list[pa.Array]:
    if not model.languages or not raw:
        n = len(raw)
        return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
    entropy, counts, n_letters = model.entropies(raw)
    best, none, row = entropy.argmin(axis=1), n_letters == 0, np.arange(len(raw))
    least = entropy[row, best]
    share = np.exp(-model.scale * least - np.logaddexp.reduce(-model.scale * entropy, axis=1))
    beyond = (least - model.means[best]) * np.sqrt(counts) > model.limits[best]
    return [pa.array([UNKNOWN if x else model.languages[i] for x, i in zip(none, best)], pa.string()), pa.array(np.where(none, 0.0, np.minimum(1.0, share))),
            pa.array(least, mask=none), pa.array(none | beyond)]
