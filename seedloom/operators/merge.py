"""Putting tables side by side: zipped by place, merged by key, numbered in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring order values that one task numbers.
SPAN = 4096


def zipped(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """Rows of both sides with the same place ``at``; a place that one side lacks, or has twice, is an error."""
    sides = [df.join(df.groupBy(at).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(at), at, "left_semi") for df in (left, right)]
    if not all(s.isEmpty() for s in sides):
        raise ValueError(f"a place of {at} stands for several rows")
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), at, "full")
    short = F.raise_error(F.concat(F.lit("only one side has place "), F.col(at).cast("string")))
    return both.filter(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), True).otherwise(short.cast("boolean"))).drop("_l", "_r")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key: the existing one where there is one, else the new one."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def running_numbers(rows: DataFrame, by: list[str], order: str, first: int = 1) -> DataFrame:
    """``rows`` with ``number``: their place in the order of a bigint column within each group, from ``first``.

    Rows are counted per group and span of the order and numbered within spans, so no task holds a group. Rows that are
    equal in the order are numbered in any order among themselves.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(order) / SPAN))
    counts = spanned.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_c"))
    below = counts.withColumn("_below", F.sum("_c").over(Window.partitionBy(*by).orderBy("_span")) - F.col("_c"))  # a row a span
    within = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(order))
    return spanned.withColumn("_in", within).join(below, [*by, "_span"]).withColumn("number", (F.col("_below") + F.col("_in") + (first - 1)).cast("bigint")).select(*rows.columns, "number")


def numbered_id(prefix: Column, number: Column, digits: int = 6) -> Column:
    return F.concat(prefix, F.lpad(number.cast("string"), digits, "0"))
