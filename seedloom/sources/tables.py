"""The input tables as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def splits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The labelled splits as one table with a column ``split``."""
    each = [read(spark, sf_dir, name, *columns).select(F.lit(name).alias("split"), *columns) for name in ("train", "valid", "test")]
    return reduce(DataFrame.unionByName, each)
