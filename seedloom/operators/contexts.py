"""Support records, contexts of them, and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS, scrubbed_line
from .draw import seeded
from .sampling import cyclic, support_id


def support_records(pool: DataFrame, by: list[str]) -> DataFrame:
    """(by.., support_id, label, line) of a seed pool: S1.. and N1.. in pool order."""
    key = support_id(F.col("label"), F.col("rank"))
    return pool.select(*by, key.alias("support_id"), "label", "rank", scrubbed_line(key, F.col("text")).alias("line"))


def combinations(records: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """(by.., name) all subsets of ``size`` support ids of each group, as arrays in order of rank."""
    sides = [records.select(*by, F.col("rank").alias(f"r{i}"), F.col("support_id").alias(f"s{i}")) for i in range(size)]

    def joined(left: DataFrame, i: int) -> DataFrame:
        return left.join(sides[i], by).filter(F.col(f"r{i - 1}") < F.col(f"r{i}"))

    return reduce(joined, range(1, size), sides[0]).select(*by, F.array(*(f"s{i}" for i in range(size))).alias(name))


def rubric_contexts(records: DataFrame, by: list[str], calls: int, seed: int, size: int = 3) -> DataFrame:
    """``calls`` contexts per group: ``size`` positive and ``size`` negative supports each, all combinations in seeded
    order, from the beginning again when there are fewer. Ids are in string order, as S10 before S2."""
    parts = [combinations(records.filter(F.col("label") == label), by, size, name) for label, name in ((LABELS[1], "positive"), (LABELS[0], "negative"))]
    both = parts[0].join(parts[1], by)  # pools hold a few records per label
    keyed = both.withColumn("_key", F.concat_ws(",", "positive", "negative")).withColumn("_order", F.concat(seeded(seed, "_key"), F.col("_key")))
    turned = cyclic(keyed, by, "_order", calls)
    at = (F.col("index") + 1).cast("bigint")
    return turned.select(*by, at.alias("context_index"), F.concat(F.lit("R"), F.lpad(at.cast("string"), 3, "0")).alias("context_id"), F.array_sort("positive").alias("positive_ids"), F.array_sort("negative").alias("negative_ids"))


def joined_lines(line: Column, order: Column) -> Column:
    """Lines of a group in order, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")


def judge_prompt(examples: Column, text: Column) -> Column:
    """Instruction, labelled examples and the text to judge. ``examples``: lines."""
    head = "Decide for one text whether it is Sensitive or Non-sensitive.\nAnswer with one of these two labels and nothing else.\n\n"
    return F.concat(F.lit(head), examples, F.lit("\n\n<<<"), text, F.lit(">>>:"))


def fewshot_prompt(examples: Column, label: Column) -> Column:
    head = "Write one new text with the label {label} in the manner of these examples, between <<< and >>>.\n\n"
    return F.concat(F.replace(F.lit(head), F.lit("{label}"), label), examples, F.lit("\n\n"), label, F.lit(": <<<"))
