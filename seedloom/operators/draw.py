"""Choosing an exact number of rows per group in a given order, without ranking a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, *key: str) -> Column:
    """A random order that depends on seed and key alone, the same in any engine: md5 of 'seed:key:..'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))


def first_per_group(rows: DataFrame, groups: list[str], quotas: DataFrame, order: str) -> DataFrame:
    """Of every group, the first ``quota`` rows by the md5 column ``order``.

    ``quotas``: one row (groups.., quota). Rows are counted per group and leading digits of the order; the digits where
    the quota is reached are ranked, those before are taken whole. So a group of any size costs one aggregation and a
    rank over about 1 / 4096 of it.
    """
    sliced = rows.join(quotas, groups).withColumn("_slice", F.substring(order, 1, 3))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    below = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_slice")) - F.col("_c")
    slices = counts.withColumn("_below", below)
    placed = sliced.join(slices, [*groups, "_slice"]).filter(F.col("_below") < F.col("quota"))
    whole = placed.filter(F.col("_below") + F.col("_c") <= F.col("quota"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(order))
    part = placed.filter(F.col("_below") + F.col("_c") > F.col("quota")).withColumn("_rank", rank).filter(F.col("_below") + F.col("_rank") <= F.col("quota"))
    return whole.select(rows.columns).unionByName(part.select(rows.columns))


def stratified_quotas(counts: DataFrame, size: int, trim: bool, by: list[str] | None = None) -> DataFrame:
    """Quota of each label by largest remainder: (by.., label, quota) from (by.., label, n).

    A label gets the whole part of its share, at least one where there is room for all labels, and no more than it has.
    What is left goes to the greatest remainders, ties to the greater label; with ``trim`` an excess is taken from the
    smallest ones. Groups of no more rows than ``size`` are taken whole.
    """
    by = by or []
    group = Window.partitionBy(*by)
    exact = F.lit(float(size)) * F.col("n") / F.col("total")
    q = counts.withColumn("total", F.sum("n").over(group)).withColumn("labels", F.count(F.lit(1)).over(group))
    q = q.withColumn("whole", exact.cast("bigint")).withColumn("rest", exact - F.col("whole"))
    lifted = F.when((F.col("whole") == 0) & (F.lit(size) >= F.col("labels")), 1).otherwise(F.col("whole"))
    q = q.withColumn("base", F.least(lifted, F.col("n"))).withColumn("missing", F.lit(size) - F.sum("base").over(group))
    room = F.col("base") < F.col("n")
    up = F.sum(room.cast("int")).over(group.orderBy(F.desc("rest"), F.desc("label")))
    down = F.sum((F.col("base") > 1).cast("int")).over(group.orderBy("rest", "label"))
    quota = F.col("base") + (room & (up <= F.col("missing"))).cast("int")
    if trim:
        quota = quota - ((F.col("base") > 1) & (down <= -F.col("missing"))).cast("int")
    return q.select(*by, "label", F.when(F.col("total") <= size, F.col("n")).otherwise(quota).cast("bigint").alias("quota"))
