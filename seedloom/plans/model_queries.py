"""Queries that train a classifier or run a generation loop over the offline provider."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.curate import ensure_checkpoint
from ..operators.provider import Stub
from ..operators.sampling import seed_pool
from ..operators.train import calibrated, predictions, trained
from ..sources.tables import read
from . import methods

#: Seeds of the runs, and runs at a time.
SEEDS, RUNS = [42, 123, 456], 8
TEXTS = Stub(("The {0} {1} near the {2} was moved to the {3} on day {n}.>>>", "I told {0} about the {1} {2} before the {4} opened at {n}.>>>", "My {0} keeps a {1} by the {5} since {n}.>>>"))


def train_classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Held-out metrics per dataset of a classifier fitted on the whole training split, calibrated on the validation split."""
    train, valid, test = (read(spark, d, name, "row_id", "dataset", "text", "label") for name in ("train", "valid", "test"))
    model = trained(train)
    out = predictions(model, test, calibrated(model, valid))
    return m.judged(out, ["dataset"])


def stub_generation_run(spark: SparkSession, d: str) -> DataFrame:
    """Rows per dataset, seed and label of few-shot runs over the offline provider, one for each dataset and seed."""
    rows = read(spark, d, "train", "row_id", "dataset", "label", "text").filter("text is not null and dataset is not null")
    ensure_checkpoint(spark)
    pool = seed_pool(rows, SEEDS, 5, ["dataset"]).select("dataset", "seed", "label", "rank", "text").checkpoint()
    runs = [(r["dataset"], r["seed"]) for r in pool.select("dataset", "seed").distinct().orderBy("dataset", "seed").collect()]  # one row a run

    def made(run: tuple[str, int]) -> DataFrame:
        dataset, seed = run
        mine = pool.filter((F.col("dataset") == dataset) & (F.col("seed") == seed))
        out = methods.fewshot(mine, TEXTS, methods.Limits(size=24, batch=12))
        return out.select(F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), "label")

    whole = spark.createDataFrame([], "dataset string, seed int, label string")
    with ThreadPoolExecutor(RUNS) as threads:  # the runs are small jobs that wait for each other's rounds only
        for part in threads.map(made, runs):
            whole = whole.unionByName(part)
    return whole.groupBy("dataset", "seed", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (train_classifier_metrics, stub_generation_run)}
SQL: dict[str, str] = {}
