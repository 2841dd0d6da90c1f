"""Seed pools, stratified samples, splits and few-shot picks in a seeded, engine-independent order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LABELS
from .draw import first_per_group, seeded, stratified_quotas


def ranked(rows: DataFrame, by: list[str], seed: int | str, key: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in seeded order, with their rank from 1; Spark keeps only that many per task."""
    order = rows.withColumn("_order", seeded(seed, *key))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_order", *key))
    return order.withColumn("rank", rank).filter(F.col("rank") <= most).drop("_order")


def seed_pool(rows: DataFrame, seeds: list[int], per_label: int, by: list[str], key: str = "row_id") -> DataFrame:
    """Per seed, group and label, ``per_label`` examples: the rows plus ``seed`` and ``rank``."""
    many = rows.filter(F.col("label").isin(*LABELS)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    order = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("seed", *by, "label").orderBy(order, key))
    return many.withColumn("rank", rank).filter(F.col("rank") <= per_label)


def support_id(label: Column, rank: Column) -> Column:
    return F.concat(F.when(label == LABELS[1], "S").otherwise("N"), rank.cast("string"))


def stratified(rows: DataFrame, size: int, seed: int, by: list[str], trim: bool, key: str = "row_id") -> DataFrame:
    """A sample of ``size`` rows per group whose labels keep their shares, by largest remainder."""
    counts = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    quotas = stratified_quotas(counts, size, trim, by)
    return first_per_group(rows.withColumn("_order", seeded(seed, key)), [*by, "label"], quotas, "_order").drop("_order")


def train_valid_split(rows: DataFrame, ratio: float, seed: int, by: list[str], key: str = "row_id") -> DataFrame:
    """Rows marked ``train`` or ``valid``; the first int(n * ratio) of each group in seeded order are valid."""
    quota = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, (F.col("n") * F.lit(ratio)).cast("bigint").alias("quota"))
    chosen = first_per_group(rows.withColumn("_order", seeded(seed, key)), by, quota, "_order").select(key).withColumn("part", F.lit("valid"))
    return rows.join(chosen, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def cyclic(items: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Each group's items repeated in turn to ``size`` rows: (by.., index, item columns)."""
    w = Window.partitionBy(*by)
    numbered = items.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.lit(size) - F.col("_i")) / F.col("_n")).cast("int") - 1))
    spread = numbered.filter(F.col("_i") < size).withColumn("_turn", F.explode(turns))
    return spread.withColumn("index", (F.col("_turn") * F.col("_n") + F.col("_i")).cast("bigint")).drop("_i", "_n", "_turn")


def balanced(parts: int, index: Column, total: Column) -> Column:
    """Share of part ``index`` (from 0) when ``total`` is dealt out to ``parts`` as evenly as can be, the first get more."""
    return F.floor(total / parts) + (index < total % parts).cast("bigint")
