"""Mixing sources to target shares of a token budget (problem 7): subset sums over counts of exact lengths."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace, table
from .draw import draw
from .token_counts import TOKENIZER, token_counts

#: Tokens that the dynamic programme fits, at most; before it, lengths are taken in proportion.
FITTED = 60_000
SEED = 11


def fitted_counts(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents of each length to take so that their total is as near below ``budget`` as it can be.

    Most of the budget goes to all lengths in proportion to their counts; the remainder, of at most ``FITTED`` tokens or
    the longest document if that is more, is met by a bounded knapsack: bit s of a row of the programme tells whether
    the lengths so far reach s tokens.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: random.Random(f"{seed}:{lengths[i]}").random())
    share = budget / total if total else 0.0
    take = [int(c * share) for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in order:  # single documents, until the programme can do the rest
        if left <= FITTED:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    mask, reach = (1 << (left + 1)) - 1, 1
    steps = []
    for i in order:
        spare, unit = min(counts[i] - take[i], left // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            used = min(unit, spare)
            steps.append((i, used, reach))
            reach |= (reach << (used * lengths[i])) & mask
            spare -= used
            unit *= 2
    at = reach.bit_length() - 1
    for i, used, before in reversed(steps):
        if not before >> at & 1:
            take[i] += used
            at -= used * lengths[i]
    return take


def mixed(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(use, report): how often each document is used, and the shares reached.

    ``sizes``: id, source, n_tokens. ``targets``: source, target_share, max_repeats, budget_tokens (the same on all
    rows). A source's documents are used as often as they all fit into its part of the budget, up to ``max_repeats``;
    what then remains is fitted by ``fitted_counts`` with documents used once more, drawn at random per length. Of ``use``
    only documents used at least once are rows. A source that can't fill its part is used ``max_repeats`` times and
    reported with its shortfall; sources without a target, null sources and sizes of zero or null are not used; a target
    without documents is reported with nothing. Shares are of the tokens mixed. Ids may repeat; each row is a document.
    """
    work = Workspace(sizes.sparkSession, "mixing")
    one = targets.filter("source is not null").groupBy("source").agg(*(F.max(c).alias(c) for c in ("target_share", "max_repeats", "budget_tokens"))).na.fill(0)
    wanted = one.withColumn("target_tokens", F.floor(F.col("target_share") * F.col("budget_tokens") + F.lit(1e-6)).cast("bigint"))
    documents = sizes.filter("n_tokens > 0 and source is not null")
    lengths = work.keep(documents.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("documents")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("documents")).alias("available_tokens"))
    plan = wanted.join(totals, "source", "left").na.fill(0, ["available_tokens"])
    rounds = F.least(F.col("max_repeats"), F.floor(F.col("target_tokens") / F.nullif("available_tokens", F.lit(0)))).cast("bigint")
    plan = plan.withColumn("rounds", F.coalesce(rounds, F.lit(0))).withColumn(
        "rest", F.when(F.col("rounds") < F.col("max_repeats"), F.col("target_tokens") - F.col("rounds") * F.col("available_tokens")).otherwise(F.lit(0)).cast("bigint")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        quota = fitted_counts(pdf["n_tokens"].tolist(), pdf["documents"].tolist(), int(pdf["rest"].iloc[0]), seed)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "quota": quota})

    # a group holds one row per length of a source, however many documents there are
    fits = lengths.join(plan.select("source", "rest"), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, quota bigint")
    quota = work.keep(fits, "quota")
    extra = draw(documents.select(id_col, "source", "n_tokens"), ["source", "n_tokens"], quota.filter("quota > 0"), [F.col(id_col)], seed)
    base = documents.join(plan.filter("rounds > 0").select("source", "rounds"), "source").select(id_col, "source", "n_tokens", F.col("rounds").alias("times"))
    use = base.unionByName(extra.withColumn("times", F.lit(1).cast("bigint"))).groupBy(id_col, "source", "n_tokens").agg(F.sum("times").alias("times"))
    added = quota.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("quota")).alias("added"))
    report = plan.join(added, "source", "left").withColumn("actual_tokens", (F.col("rounds") * F.col("available_tokens") + F.coalesce("added", F.lit(0))).cast("bigint"))
    share = F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(Window.partitionBy()), F.lit(0))
    report = report.withColumn("actual_share", share).withColumn("shortfall_tokens", F.col("target_tokens") - F.col("actual_tokens"))
    return use, report.select("source", "target_share", "max_repeats", "budget_tokens", "target_tokens", "available_tokens", "actual_tokens", "actual_share", "shortfall_tokens")


def mix_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """``mixed`` over documents, sized in tokens of a public tokenizer; blank documents are not used."""
    sizes = Workspace(documents.sparkSession, "sizes").keep(token_counts(documents, "doc_id", "text", ["source"], tokenizer), "sizes")
    return mixed(sizes, targets)


def _both(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark, sf_dir):
    return _both(spark, sf_dir)[0]


def p7_shares(spark, sf_dir):
    return _both(spark, sf_dir)[1]
