"""Classification metrics, probabilities and threshold calibration as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LABELS, PARSE_FAILED

#: Slices of the score range from 0 to 1.
SLICES = 4096


def f1_of_label(true: Column, pred: Column, label: str) -> Column:
    hit = F.count_if((true == label) & (pred == label))
    sizes = F.count_if(true == label) + F.count_if(pred == label)
    return F.when(sizes > 0, F.lit(2.0) * hit / sizes).otherwise(F.lit(0.0))


def accuracy(true: Column, pred: Column) -> Column:
    return F.count_if(true == pred) / F.count(F.lit(1))


def macro_f1(true: Column, pred: Column) -> Column:
    """Mean F1 over the fixed label set; a prediction outside it is a miss of the true label and no class of its own."""
    return (f1_of_label(true, pred, LABELS[0]) + f1_of_label(true, pred, LABELS[1])) / 2


def macro_f1_observed(true: Column, pred: Column) -> Column:
    """Mean F1 over those labels that occur among the true or the predicted ones."""
    seen = [F.count_if((true == label) | (pred == label)) > 0 for label in LABELS]
    total = sum((F.when(s, f1_of_label(true, pred, label)).otherwise(0.0) for s, label in zip(seen, LABELS, strict=True)), F.lit(0.0))
    return total / F.nullif(seen[0].cast("int") + seen[1].cast("int"), F.lit(0))


def judged(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per group of predictions (true_label, pred_label)."""
    true, pred = F.col("true_label"), F.col("pred_label")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.count_if(pred == PARSE_FAILED).alias("parse_failed"),
        F.round(accuracy(true, pred), 9).alias("accuracy"),
        F.round(macro_f1(true, pred), 9).alias("macro_f1"),
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def margin(probs: Column) -> Column:
    """Distance of the two greatest probabilities."""
    ordered = F.sort_array(probs, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def argmax(values: Column) -> Column:
    """Position of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def threshold_sweep(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by.., threshold, accuracy, macro_f1) of all thresholds worth trying on (by.., score, positive).

    Those are one below all scores, one above all, and the midpoints between neighbouring scores. Rows are counted per
    distinct score and per slice of scores; running sums go over the slices, at most ``SLICES`` of a group, and inside
    each slice, so no task orders a whole group. Macro F1 is over the labels that occur.
    """
    hits = F.count_if(F.col("positive"))
    counted = scores.groupBy(*by, "score").agg(hits.alias("pos"), (F.count(F.lit(1)) - hits).alias("neg"))
    counted = counted.withColumn("slice", F.floor(F.col("score") * SLICES).cast("bigint"))
    order = Window.partitionBy(*by).orderBy("slice")
    every, before = Window.partitionBy(*by), order.rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*by, "slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("score").alias("low"), F.max("score").alias("high"))
    sums = sums.select(
        *by, "slice", F.lag("high").over(order).alias("last"), F.lead("low").over(order).alias("next"),
        F.sum("pos").over(every).alias("all_pos"), F.sum("neg").over(every).alias("all_neg"),
        F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("base_pos"), F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("base_neg"),
    )
    joined = counted.alias("c").join(sums.alias("s"), [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in (*by, "slice")])
    joined = joined.select(*(F.col(f"c.{x}").alias(x) for x in (*by, "slice", "score", "pos", "neg")), "last", "next", "all_pos", "all_neg", "base_pos", "base_neg")
    inner = Window.partitionBy(*by, "slice").orderBy("score")
    below = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = joined.select(
        *by, "score", F.coalesce(F.lag("score").over(inner), "last").alias("before"), F.coalesce(F.lead("score").over(inner), "next").alias("after"), "all_pos", "all_neg",
        (F.col("base_pos") + F.coalesce(F.sum("pos").over(below), F.lit(0))).alias("fn"), (F.col("base_neg") + F.coalesce(F.sum("neg").over(below), F.lit(0))).alias("tn"),
    )
    at = F.when(F.col("before").isNull(), F.lit(-1e-12)).otherwise((F.col("before") + F.col("score")) / 2)
    lows = rows.select(*by, at.alias("threshold"), "all_pos", "all_neg", "fn", "tn")
    top = rows.filter("after is null").select(*by, F.lit(1 + 1e-12).alias("threshold"), "all_pos", "all_neg", F.col("all_pos").alias("fn"), F.col("all_neg").alias("tn"))
    tp, fp = F.col("all_pos") - F.col("fn"), F.col("all_neg") - F.col("tn")

    def f1(hit: Column, a: Column, b: Column) -> Column:
        return F.when(a + b > 0, F.lit(2.0) * hit / (a + b)).otherwise(F.lit(0.0))

    f_pos, f_neg = f1(tp, F.col("all_pos"), tp + fp), f1(F.col("tn"), F.col("all_neg"), F.col("fn") + F.col("tn"))
    seen_pos, seen_neg = ((F.col("all_pos") + tp + fp) > 0).cast("int"), ((F.col("all_neg") + F.col("fn") + F.col("tn")) > 0).cast("int")
    both = lows.unionByName(top)
    return both.select(*by, "threshold", ((tp + F.col("tn")) / (F.col("all_pos") + F.col("all_neg"))).alias("accuracy"), ((f_pos * seen_pos + f_neg * seen_neg) / (seen_pos + seen_neg)).alias("macro_f1"))


def best_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of the greatest (macro F1, accuracy), the lowest of equals."""
    best = F.max_by(F.struct("threshold", "accuracy", "macro_f1"), F.struct("macro_f1", "accuracy", -F.col("threshold"))).alias("best")
    return threshold_sweep(scores, by).groupBy(*by).agg(best).select(*by, "best.*")


def sample_stdev(c: Column) -> Column:
    """Sample deviation; of one value 0, of none null."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def best_so_far(history: DataFrame, by: list[str], order: str, metric: str, patience: int) -> DataFrame:
    """Per step: is it a new strict best, steps since the last one, and has training stopped by then?"""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("step", F.row_number().over(w)).withColumn("improved", F.coalesce(F.col(metric) > before, F.col(metric).isNotNull()))
    last = F.max(F.when(F.col("improved"), F.col("step"))).over(w)
    waited = marked.withColumn("waited", F.col("step") - F.coalesce(last, F.lit(0)))
    return waited.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(w) == 1)


def failure_runs(events: DataFrame, by: list[str], order: str, failed: str, accepted: str) -> DataFrame:
    """Length of the current run of failures after each event: an acceptance resets it, other events leave it."""
    w = Window.partitionBy(*by).orderBy(order)
    island = events.withColumn("_run", F.sum(F.col(accepted).cast("int")).over(w))
    inner = Window.partitionBy(*by, "_run").orderBy(order)
    return island.withColumn("run", F.sum((F.col(failed) & ~F.col(accepted)).cast("int")).over(inner)).drop("_run")
