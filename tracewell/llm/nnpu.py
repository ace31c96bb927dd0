"""Learning from positive and unlabelled examples: non-negative risk, class prior, and fitting as a Spark job."""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classifiers whose logits are averaged; each is validated on the examples that it leaves out.
CLASSIFIERS = 3
STEPS = 400
RATE = 0.1
RIDGE = 1e-3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-_softplus(-np.asarray(z, np.float64)))


def risk(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under logistic loss: prior times the positives' loss as positives, and the negatives'
    loss, which is the unlabelled ones' loss as negatives less the share that is due to positives among them."""
    return prior * _softplus(-z_pos).mean(), _softplus(z_unl).mean() - prior * _softplus(z_pos).mean()


def fit(x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by full-batch Adam; deterministic.

    The negatives' part of the risk cannot be negative in truth. Where its estimate falls below zero the step goes
    uphill on that part alone, which undoes the overfitting. Without a prior, positives are told from unlabelled
    examples by plain logistic loss, each side weighing the same.
    """
    w, first, second = np.zeros(x_pos.shape[1] + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        z_pos, z_unl = x_pos @ w[:-1].astype(x_pos.dtype) + w[-1], x_unl @ w[:-1].astype(x_unl.dtype) + w[-1]
        up = (sigmoid(z_pos) - 1) / len(z_pos)
        as_negative, unlabelled = sigmoid(z_pos) / len(z_pos), sigmoid(z_unl) / len(z_unl)
        if prior is None:
            g_pos, g_unl = up, unlabelled
        elif risk(z_pos, z_unl, prior)[1] >= 0:
            g_pos, g_unl = prior * (up - as_negative), unlabelled
        else:
            g_pos, g_unl = prior * as_negative, -unlabelled
        g = np.append(g_pos.astype(x_pos.dtype) @ x_pos + g_unl.astype(x_unl.dtype) @ x_unl + ridge * w[:-1], g_pos.sum() + g_unl.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of the two tails above a threshold.

    Above any threshold the unlabelled tail is at least the prior times the positives' tail, with equality where no
    negative scores as high. Thin tails are kept from winning by a bound on the error of both shares.
    """
    pos, unl = np.sort(pos), np.sort(unl)
    cuts = np.unique(pos)
    tail_p = 1 - np.searchsorted(pos, cuts) / len(pos)
    tail_u = 1 - np.searchsorted(unl, cuts) / len(unl)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def dense(features: list, width: int) -> np.ndarray:
    """0/1 rows from lists of feature numbers."""
    out = np.zeros((len(features), width), np.float32)
    for row, own in zip(out, features):
        row[np.asarray(own, np.int64)] = 1
    return out


def train(examples: DataFrame, width: int, prior: float | None = None, ridge: float = RIDGE) -> Model:
    """The mean of the classifiers fitted to `examples`: positive boolean, id_hash long, features array<int>.

    `examples` is a bounded sample, its bound given by the operator that draws it; it is dealt to as many tasks as
    there are classifiers, with each example left out of one. Where the prior is not given, it is the median of the
    estimates from the scores of the left-out examples. Without positives the model says 'negative', without
    unlabelled examples 'positive'.
    """
    def sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.sort_values(["positive", "id_hash"], kind="stable")
        return dense(rows["features"].tolist(), width), rows["positive"].to_numpy(bool), rows["out"].to_numpy(bool)

    def estimate(rows: pd.DataFrame) -> pd.DataFrame:
        x, pos, out = sides(rows)
        if any(not m.any() for m in (pos & out, ~pos & out, pos & ~out, ~pos & ~out)):
            return pd.DataFrame({"prior": np.zeros(0)})
        w, _ = fit(x[pos & ~out], x[~pos & ~out], None, ridge)
        z = x[out] @ w
        return pd.DataFrame({"prior": [class_prior(z[pos[out]], z[~pos[out]])]})

    dealt = (examples.select("positive", "id_hash", "features", F.explode(F.array(*map(F.lit, range(CLASSIFIERS)))).alias("classifier"))
             .withColumn("out", F.pmod("id_hash", F.lit(CLASSIFIERS)) == F.col("classifier")).groupBy("classifier"))
    if prior is None:
        found = [r["prior"] for r in dealt.applyInPandas(estimate, "prior double").collect()]
        prior = float(np.median(found)) if found else 0.5

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, pos, out = sides(rows)
        if (pos & ~out).any() and (~pos & ~out).any():
            w, b = fit(x[pos & ~out], x[~pos & ~out], prior, ridge)
        else:
            w, b = np.zeros(width), 4.0 if pos.any() else -4.0
        return pd.DataFrame({"weights": [np.asarray(w, "<f8").tobytes()], "bias": [b]})

    models = dealt.applyInPandas(one, "weights binary, bias double").collect()
    if not models:
        return Model(np.zeros(width), -4.0, prior)
    return Model(np.mean([np.frombuffer(m["weights"], "<f8") for m in models], axis=0), float(np.mean([m["bias"] for m in models])), prior)


def sample(docs: DataFrame, positives: DataFrame, trusted: Column, id_col: str, text_col: str, max_positive: int,
           max_unlabelled: int) -> DataFrame:
    """The examples' texts: positive boolean, id_hash long, text.

    Up to `max_positive` ids of `positives` and up to `max_unlabelled` ids of all rows where `trusted` holds, those
    with the least hashes; these lists, of bounded size, are broadcast, so no text is shuffled to draw the sample. An id
    gives one row, that of the text of least hash, so the bounds hold for rows; null ids give none.
    """
    key = F.xxhash64(id_col)

    def least(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(key, id_col).limit(n))

    text = F.coalesce(F.col(text_col), F.lit(""))
    one = F.min(F.struct(F.xxhash64(text).alias("hash"), text.alias("text")))["text"]
    pick = lambda ids, positive: docs.select(id_col, text_col).join(ids, id_col, "left_semi").groupBy(id_col).agg(one.alias("text")).select(
        F.lit(positive).alias("positive"), key.alias("id_hash"), "text")
    return pick(least(positives, max_positive), True).unionAll(pick(least(docs.where(trusted), max_unlabelled), False))
