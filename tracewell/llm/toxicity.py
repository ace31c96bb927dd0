"""Toxicity of texts: classifiers over telling words, learned from toxic examples and unlabelled text."""

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import nnpu
from tracewell.llm.common import release, steps

#: Bounds of the sample that the classifiers are fitted to.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 15000
#: Features kept, those most unevenly spread between toxic and unlabelled examples, and the least z value of one.
FEATURES = 512
LEAST_Z = 5.0
#: How much larger its share of the toxic examples is, at least.
LEAST_LIFT = 3.0
#: Examples added to a feature's count, so that a rare feature needs more than chance to stand out.
SMOOTHING = 10
#: A feature is met in so many examples at least.
LEAST_EXAMPLES = 5
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words whose features a worker keeps before it starts anew.
KEPT_WORDS = 250_000

_TO_SPACE = bytes.maketrans((string.punctuation + string.digits).encode(), b" " * 42)


def words(text: bytes) -> set[bytes]:
    """The distinct words in lower case, without ASCII marks and digits; letters beyond ASCII are kept as they are."""
    return set(text.lower().translate(_TO_SPACE).split())


def word_features(word: bytes) -> list[bytes]:
    """The word itself, marked by a space, and its beginnings short of the whole word."""
    return [b" " + word, *(word[:n] for n in PREFIXES if n < len(word))]


def features_of(found: Iterable[bytes]) -> Iterator[bytes]:
    """The features of a text from those of its distinct words: each, and marked by a plus if two words share it."""
    for feature, times in Counter(found).items():
        yield feature
        if times > 1:
            yield b"+" + feature


def telling_features(sample: DataFrame, limit: int = FEATURES) -> list[bytes]:
    """The features with a far larger share of the toxic than of the unlabelled examples, by the two-sample z value."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive, at = batch.column(0).to_pylist(), 0
            for raw in steps(batch.column(1)):
                both = (Counter(), Counter())
                for text, toxic in zip(raw, positive[at:at + len(raw)]):
                    both[toxic].update(features_of(f for w in words(text) for f in word_features(w)))
                at += len(raw)
                found = list(both[0] | both[1])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(pa.array([c[f] for f in found], pa.int64()) for c in both[::-1])],
                                                 names=["feature", "p", "u"])

    totals = sample.agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")).first()
    n_p, n_u = max(1, totals["p"]), max(1, totals["u"])
    shared = (F.col("p") + F.col("u") + SMOOTHING) / (n_p + n_u + 2 * SMOOTHING)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(shared * (1 - shared) * (1 / n_p + 1 / n_u) + 1e-12)
    counts = sample.select("positive", "text").mapInArrow(count, "feature binary, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    common = (F.col("p") + F.col("u") >= LEAST_EXAMPLES) & (F.col("p") / n_p >= LEAST_LIFT * F.col("u") / n_u)
    best = counts.where(common).select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(limit)
    return [bytes(r["feature"]) for r in best.collect()]


class Scorer:
    """Finds the telling features of texts; those of each word are kept."""

    def __init__(self, features: list[bytes]):
        self.number = {f: i for i, f in enumerate(features)}
        self.parts = {f.removeprefix(b"+") for f in features}
        self.known: dict = {}

    def features(self, text: bytes) -> list[int]:
        known, found = self.known, []
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in word_features(w) if f in self.parts)
            if own:
                found += own
        return sorted(self.number[f] for f in features_of(found) if f in self.number)


def fit(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> tuple[list[bytes], nnpu.Model]:
    """Telling features and classifier, from rows of `labels` and `docs` where `trusted` (on the id) holds.

    The examples' labels are those of the ids labelled 1; all other rows, labelled or not, serve as unlabelled text.
    The class prior is the toxic share of all labels, or, where they name positives alone, estimated from scores.
    Where no feature is telling, as with very few examples, every text gets the same low probability.
    """
    trusted = F.lit(True) if trusted is None else trusted
    positives = labels.where(trusted & (F.col(label_col) == 1))
    share = labels.where(trusted).agg(F.avg(F.when(F.col(label_col) == 1, 1.0).when(F.col(label_col) == 0, 0.0)).alias("toxic")).first()["toxic"]
    sample = nnpu.sample(docs, positives, trusted, id_col, text_col, MAX_POSITIVE, MAX_UNLABELLED)
    features = telling_features(sample)
    if not features:
        return features, nnpu.Model(np.zeros(1), -4.0, 0.0)

    @F.arrow_udf("array<int>")
    def present(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(features)
        for batch in batches:
            yield pa.array([scorer.features(t) for raw in steps(batch) for t in raw], pa.list_(pa.int32()))

    examples = sample.select("positive", "id_hash", present(F.col("text")).alias("features"))
    return features, nnpu.train(examples, len(features), prior=share if share and share < 1 else None)


def score(docs: DataFrame, features: list[bytes], model: nnpu.Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows with the probability `out` of being toxic, from 0 to 1.

    A null or empty text has no features and gets the probability of such a text. Repeated rows get equal scores;
    other columns are kept, and one named as `out` is replaced. Nothing is shuffled; the model's size is fixed.
    """
    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(features)
        for batch in batches:
            z = [math.fsum(model.weights[scorer.features(t)]) for raw in steps(batch) for t in raw]
            release()
            yield pa.array(nnpu.sigmoid(np.array(z, np.float64) + model.bias), pa.float64())

    return docs.withColumn(out, probability.asNondeterministic()(F.col(text_col)))
