"""Hooks for models: batch scoring by a user function, and a text gate trained on Spark."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parallelism: int | None = None) -> DataFrame:
    """Call a user function on Arrow batches of rows and collect its prediction rows.

    The function gets a pandas frame and returns one with the columns of `schema`; retries and
    clients belong to it. `parallelism` spreads rows over that many tasks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    rows = df.repartition(parallelism) if parallelism else df
    return rows.mapInPandas(run, schema)


def fit_text_gate(train: DataFrame, features: int = 1 << 16, max_iter: int = 20):
    """Availability and relation heads over hashed words, trained on a recipe.

    `train` has text, available (0/1) and gold_relation. Returns (availability model, relation
    model, names of the relations by index); the relation head learns from available notes.
    """
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+")
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    head = lambda label, p: LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol=p,
                                               rawPredictionCol=f"_raw{p}", predictionCol=f"_pred{p}", maxIter=max_iter)
    labelled = train.withColumn("_available", F.col("available").cast("double"))
    encoder = Pipeline(stages=[words, tf, idf]).fit(labelled)
    # Features are computed once and feed both heads.
    encoded = encoder.transform(labelled).select("_available", "gold_relation", "_features").persist()
    try:
        availability = head("_available", "_p_avail").fit(encoded)
        usable = encoded.where("_available = 1")
        indexer = StringIndexer(inputCol="gold_relation", outputCol="_relation", stringOrderType="alphabetAsc").fit(usable)
        relation = head("_relation", "_p_rel").fit(indexer.transform(usable))
    finally:
        encoded.unpersist()
    return encoder, availability, relation, list(indexer.labels)


def predict_text_gate(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Prediction rows of a fitted gate: availability, probabilities, abstention and answer."""
    from tracewell.operators.gates import availability_threshold_gate
    encoder, availability, relation, labels = model
    scored = relation.transform(availability.transform(encoder.transform(df)))
    scored = scored.withColumns({
        "availability_probability": vector_to_array("_p_avail")[1], "probs": vector_to_array("_p_rel"), "is_gate": F.lit(True)})
    out = availability_threshold_gate(scored, threshold, labels)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
