"""Drawing an exact number of rows per cell at random, without ranking a whole cell in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a cell by random number; only one of them is ranked.
SLICES = 1 << 14


def draw(rows: DataFrame, cells: list[str], quotas: DataFrame, order: list[Column], seed: int) -> DataFrame:
    """Of every cell, ``quota`` rows chosen at random but repeatably.

    ``quotas``: one row (cells.., quota) per cell; cells are compared null-safely only if they hold no null, so rows
    with a null in a cell column are never drawn. ``order`` identifies a row; equal rows share their random number and
    are told apart by rank alone. Each row gets a random number from ``seed`` and ``order``. Rows are counted per cell
    and slice of that number, the slice in which the quota is reached is ranked, and the slices below it are taken whole:
    a cell of any size costs one aggregation and a rank over about 1 / SLICES of it.
    """
    number = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(1 << 40))
    wanted = quotas.select(*cells, F.col("quota").alias("_draw_quota"))
    numbered = rows.join(wanted, cells).withColumn("_draw_number", number).withColumn("_draw_slice", F.shiftright("_draw_number", 26).cast("int"))
    counts = numbered.groupBy(*cells, "_draw_slice").agg(F.count(F.lit(1)).alias("_draw_count"))
    below = F.sum("_draw_count").over(Window.partitionBy(*cells).orderBy("_draw_slice")) - F.col("_draw_count")
    placed = numbered.join(counts.withColumn("_draw_below", below), [*cells, "_draw_slice"]).filter(F.col("_draw_below") < F.col("_draw_quota"))
    all_of_it = F.col("_draw_below") + F.col("_draw_count") <= F.col("_draw_quota")
    rank = F.row_number().over(Window.partitionBy(*cells, "_draw_slice").orderBy("_draw_number", *order))
    part = placed.filter(~all_of_it).withColumn("_draw_rank", rank).filter(F.col("_draw_below") + F.col("_draw_rank") <= F.col("_draw_quota"))
    return placed.filter(all_of_it).select(rows.columns).unionByName(part.select(rows.columns))
