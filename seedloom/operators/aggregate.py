"""Summaries of a grid of runs, and of a serving endpoint's metrics page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import sample_stdev


# Methods that judge, the names of the kinds of run, and the form of a summary.
JUDGES = ["first_person_rule", "oneshot_judge", "fewshot_judge"]
JUDGED, TRAINED = "direct_judge", "trained_classifier"
FIELDS = ["dataset", "display_name", "method", "run_type", "seeds", "n", "accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd"]
HEADING = ["| Dataset | Method | Run type | n | Accuracy | Macro F1 | Seeds |", "|---|---|---|---:|---:|---:|---|"]
SEVERAL, SINGLE, NONE = "{mean:.2f} +/- {sd:.2f}", "{mean:.2f} (n=1)", "-"


def run_type(method: Column) -> Column:
    return F.when(method.isin(JUDGES), JUDGED).otherwise(TRAINED)


def grid_summary(results: DataFrame, datasets: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """One row per dataset and method of ``results`` (dataset, method, seed, accuracy, macro_f1): the seeds that have an
    accuracy, their number, and means and sample deviations in percent; cells without results have none. ``datasets`` and
    ``methods`` are those of the grid; without them, those that the results name."""
    axes = [
        results.select(c).filter(f"{c} is not null").distinct() if names is None else results.sparkSession.createDataFrame([(n,) for n in names], f"{c} string")
        for c, names in (("dataset", datasets), ("method", methods))
    ]
    grid = axes[0].crossJoin(axes[1])  # names of datasets and methods: a fixed small grid
    acc, f1 = F.col("accuracy") * 100, F.col("macro_f1") * 100
    seeds = F.sort_array(F.collect_list(F.when(F.col("accuracy").isNotNull(), F.struct("seed", "accuracy"))))
    return grid.join(results, ["dataset", "method"], "left").groupBy("dataset", "method").agg(
        F.array_join(F.transform(seeds, lambda s: s["seed"].cast("string")), " ").alias("seeds"),
        F.count("accuracy").alias("n"),
        F.round(F.avg(acc), 6).alias("accuracy_mean"), F.round(sample_stdev(acc), 6).alias("accuracy_sd"),
        F.round(F.avg(f1), 6).alias("macro_f1_mean"), F.round(sample_stdev(f1), 6).alias("macro_f1_sd"),
    ).select("dataset", "method", run_type(F.col("method")).alias("run_type"), "seeds", "n", "accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd")


def markdown_lines(rows: list[dict]) -> list[str]:
    """A summary as a Markdown table; ``rows`` as collected from ``grid_summary``."""

    def cell(row: dict, name: str) -> str:
        mean = row[f"{name}_mean"]
        if mean is None:
            return NONE
        return (SEVERAL if row["n"] > 1 else SINGLE).format(mean=mean, sd=row[f"{name}_sd"])

    return HEADING + [f"| {r.get('display_name') or r['dataset']} | `{r['method']}` | {r['run_type']} | {r['n']} | {cell(r, 'accuracy')} | {cell(r, 'macro_f1')} | {r['seeds']} |" for r in rows]


def endpoint_load(lines: DataFrame, model: str | None) -> DataFrame:
    """(kind, load) of the running and waiting requests in a metrics page; rows that name the model win over all."""
    parts = r"^vllm:num_requests_(running|waiting)(?:\{(.*)\})?\s+([0-9.eE+-]+)\s*$"
    fields = [F.regexp_extract("line", parts, i) for i in (1, 2, 3)]
    rows = lines.select(fields[0].alias("kind"), fields[1].alias("names"), fields[2].try_cast("double").alias("value")).filter("kind <> '' and value is not null")
    mine = F.col("names").contains(f'"{model}"') if model else F.lit(False)
    chosen = F.when(F.count_if(mine) > 0, F.sum(F.when(mine, F.col("value")))).otherwise(F.sum("value"))
    return rows.groupBy("kind").agg(chosen.alias("load"))
