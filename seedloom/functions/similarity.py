"""Similarity of token sequences and of 3-gram sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trigrams


def lcs(left, right) -> int:
    """Length of the longest common subsequence, bit-parallel: one big integer holds a row of the table."""
    if len(left) > len(right):
        left, right = right, left
    where: dict[str, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | 1 << i
    mask = (1 << len(left)) - 1
    row = mask
    for token in right:
        hit = row & where.get(token, 0)
        row = (row + hit | row - hit) & mask
    return len(left) - row.bit_count()


def _lengths(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([lcs(a, b) if a is not None and b is not None else 0 for a, b in zip(left, right, strict=True)], dtype="int32")


def lcs_length(left: Column, right: Column) -> Column:
    return F.pandas_udf(_lengths, "int")(left, right)


def f1_of(common: Column, left: Column, right: Column) -> Column:
    """Harmonic mean of precision and recall, in the order of operations that decides ties at a threshold."""
    p, r = common / left, common / right
    return F.when((common > 0) & (left > 0) & (right > 0), F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_l(left: Column, right: Column) -> Column:
    """ROUGE-L F1 of two token arrays."""
    return f1_of(lcs_length(left, right), F.size(left), F.size(right))


def jaccard_trigrams(left: Column, right: Column) -> Column:
    """Shared share of two 3-gram sets; 0 if either is empty."""

    def share(both: Column) -> Column:
        def of(shared: Column) -> Column:
            return shared / (F.size(both["a"]) + F.size(both["b"]) - shared)

        return F.when((F.size(both["a"]) > 0) & (F.size(both["b"]) > 0), let(F.size(F.array_intersect(both["a"], both["b"])), of)).otherwise(F.lit(0.0))

    return let(F.struct(trigrams(left).alias("a"), trigrams(right).alias("b")), share)
