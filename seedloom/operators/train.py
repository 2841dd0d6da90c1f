"""A linear text classifier with epoch history, calibration and held-out metrics, on pyspark.ml."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import metrics as m


def featured(rows: DataFrame) -> DataFrame:
    """Tokens and label id of valid rows, with the first-person flag as a token of its own."""
    flag = F.when(t.has_word(F.col("text"), t.FIRST_PERSON_SINGULAR), F.array(F.lit("<first-person>"))).otherwise(F.array().cast("array<string>"))
    valid = rows.filter(F.col("label").isin(*t.LABELS) & F.col("text").isNotNull())
    return valid.withColumn("tokens", F.concat(t.tokens(F.col("text")), flag)).withColumn("y", (F.col("label") == t.LABELS[1]).cast("double"))


def resampled(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with a ``weight``: how often a bootstrap sample of that seed draws a row, by its text and label alone.

    The counts are those of a Poisson distribution of mean one, read from a hash, so that any engine draws alike.
    """
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "label", "text").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    weight, below, term = F.lit(0.0), math.exp(-1), math.exp(-1)
    for k in range(1, 8):
        weight = weight + (share >= below).cast("double")
        term /= k
        below += term
    return rows.withColumn("weight", weight)


def trained(rows: DataFrame, features: int = 1 << 16, iterations: int = 20, seed: int | None = None) -> PipelineModel:
    """A classifier of the rows; with a seed, of the bootstrap sample of that seed, so that replicates differ."""
    fitted = LogisticRegression(labelCol="y", maxIter=iterations, regParam=1e-4)
    if seed is not None:
        rows, fitted = resampled(rows, seed), fitted.setWeightCol("weight")
    return Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="features", numFeatures=features), fitted]).fit(featured(rows))


def predictions(model: PipelineModel, rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows with logits, probabilities, margin and predicted label; with a threshold, that decides."""
    out = model.transform(featured(rows)).withColumn("logits", vector_to_array("rawPrediction")).withColumn("probs", m.softmax(F.col("logits")))
    positive = F.get("probs", F.lit(1)) >= threshold if threshold is not None else m.argmax(F.col("logits")) == 1
    label = F.when(positive, t.LABELS[1]).otherwise(t.LABELS[0])
    kept = out.select(*rows.columns, "logits", "probs", m.margin(F.col("probs")).alias("margin"), label.alias("pred_label"))
    return kept.withColumn("true_label", F.col("label")).withColumn("correct", F.col("true_label") == F.col("pred_label"))


def calibrated(model: PipelineModel, valid: DataFrame) -> float:
    scores = model.transform(featured(valid)).select(F.lit(1).alias("all"), F.get(m.softmax(vector_to_array("rawPrediction")), F.lit(1)).alias("score"), (F.col("y") == 1).alias("positive"))
    return m.best_threshold(scores, ["all"]).first().threshold
