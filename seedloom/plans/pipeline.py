"""Stages of a benchmark run over a folder layout root/dataset/method/seed_N, from the command line or a driver.

    python -m seedloom.plans.pipeline SETTINGS --stage all

A run is one dataset, method and seed. Its folder holds the generated rows, the rows trained on, a document about their
generation, and ``results`` with metrics and predictions. Runs that are there already are left alone.
"""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import metrics as m
from ..operators.aggregate import JUDGED, TRAINED, grid_summary
from ..operators.provider import ChatEndpoint, Provider, endpoint_page, has_capacity
from ..operators.sampling import seed_pool, stratified
from ..operators.train import calibrated, predictions, trained
from ..sources import config as c
from ..sources import files, jsonl
from . import methods

STAGES = ("prepare", "generate", "train_eval", "direct_judge", "eval", "aggregate", "all")
LABELS = t.LABELS
# What a document about generation calls a run that has all its rows, and one that ran out of attempts.
COMPLETE, SHORT = "complete", "incomplete_rubric_budget"
INSTRUCTIONS = [
    "Decide whether the text tells where its writer lives.",
    "Decide whether the text names a person together with a health matter.",
    "Decide whether the text holds a number that identifies its writer.",
]


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    config: c.Config
    root: str
    dataset: str
    method: str
    seed: int
    provider: Provider | None = None
    overwrite: bool = False
    dry_run: bool = False

    @property
    def folder(self) -> str:
        return str(jsonl.run_folder(self.root, self.dataset, self.method, self.seed))

    @property
    def of(self) -> c.Dataset:
        return self.config.datasets[self.dataset]

    def pool(self) -> DataFrame:
        """The run's seed pool (label, rank, text)."""
        return self.spark.read.schema("label string, rank int, text string").json(self.of.pool(self.seed, self.config.of("seed_pool", "per_label")))


def prepare(spark: SparkSession, folder: str, seeds: list[int], per_label: int = 5, overwrite: bool = False, pool_root: str | None = None) -> dict:
    """Validate the splits in ``folder`` and write seed pools, a profile and the label map; existing ones are kept.

    With ``pool_root`` every seed's pool is written in a folder of its own below it.
    """
    done = jsonl.read_document(f"{folder}/prepare_meta.json")
    if done and not overwrite:
        return done
    splits = {name: jsonl.load_validated(spark, f"{folder}/{name}.jsonl") for name in ("train", "valid", "test")}
    rows = splits["train"].withColumn("row_id", F.md5(F.concat_ws(":", "label", "text").cast("binary"))).withColumn("dataset", F.lit(folder)).dropDuplicates(["row_id"])
    pool = seed_pool(rows, seeds, per_label, ["dataset"])
    lacking = pool.groupBy("seed", "label").count().filter(F.col("count") < per_label).limit(1).collect()
    if lacking:
        raise ValueError(f"too few rows for a seed pool: {lacking[0].asDict()}")
    if pool_root is None:
        jsonl.write_jsonl(pool.select("seed", "label", "rank", "text"), f"{folder}/seed_pools")
    else:
        for seed in seeds:
            jsonl.write_jsonl(pool.filter(F.col("seed") == seed).select("label", "rank", "text").coalesce(1), f"{pool_root}/seed_{seed}_k{per_label}")
    counts = {name: {r["label"]: r["count"] for r in df.groupBy("label").count().collect()} for name, df in splits.items()}
    meta = {"splits": {n: {"n": sum(k.values()), "label_counts": {x: k.get(x, 0) for x in LABELS}} for n, k in counts.items()}, "seeds": seeds, "per_label": per_label, "label_map": c.label_map(f"{folder}/label_map.json")}
    jsonl.write_document(f"{folder}/label_map.json", meta["label_map"])
    jsonl.write_document(f"{folder}/prepare_meta.json", meta)
    return meta


# --- generation

def _fewshot(k: int) -> Callable:
    def made(run: Run, pool: DataFrame, limits: methods.Limits) -> tuple[DataFrame, dict]:
        return methods.fewshot(pool.filter(F.col("rank") <= k), run.provider, limits), {"examples_per_label": k}

    return made


def _duplicate(run: Run, pool: DataFrame, limits: methods.Limits) -> tuple[DataFrame, dict]:
    return methods.duplicate(pool, limits), {}


def _paraphrase(run: Run, pool: DataFrame, limits: methods.Limits) -> tuple[DataFrame, dict]:
    per_seed = max(1, math.ceil(limits.size / max(1, pool.count())))
    batch, factor = (run.config.of("generation", f"paraphrase_{k}") for k in ("batch_size", "attempt_factor"))
    rows, report = methods.paraphrased(pool, run.provider, limits, per_seed, batch, factor, run.seed)
    by_seed = [r.asDict() for r in report.orderBy("seed_id").collect()]  # a row per text of the pool
    missing = sum(r["padding"] for r in by_seed)
    return rows, {"per_seed": per_seed, "padding_total": missing, "padding_rate": missing / max(1, limits.size), "padding_by_seed": by_seed}


def _instruct(run: Run, pool: DataFrame, limits: methods.Limits) -> tuple[DataFrame, dict]:
    return methods.instruct(pool, run.config.values.get("instructions") or INSTRUCTIONS, run.provider, limits, run.provider), {}


def _contrastive(run: Run, pool: DataFrame, limits: methods.Limits) -> tuple[DataFrame, dict]:
    settings = run.config.values.get("rubric_guided_contrastive_synthesis") or {}
    rubrics = methods.extracted_rubrics(pool, run.provider, settings.get("rubric_extraction_calls", 25), settings.get("rubric_extraction_k", 1), run.seed)
    pairs = methods.contrastive(rubrics, pool, run.provider, limits, run.provider).checkpoint()
    counts = {r["reason"] or "accepted_pairs": r["count"] for r in pairs.groupBy("reason").count().collect()}  # a row per reason
    rows = pairs.filter("reason is null").select(F.explode(F.array(F.struct(F.col("sensitive_text").alias("text"), F.lit(LABELS[1]).alias("label")), F.struct(F.col("nonsensitive_text").alias("text"), F.lit(LABELS[0]).alias("label")))).alias("x")).select("x.*")
    rate = 2 * counts.get("accepted_pairs", 0) / max(1, limits.size)
    enough = rate >= settings.get("min_completion_rate", 0.95)
    status = COMPLETE if rate >= 1 else SHORT
    return rows, {"stats": counts, "completion_rate": rate, "generation_status": status, "allow_incomplete_training_data": enough}


BUILT_IN: dict[str, Callable] = {
    "duplicate": _duplicate, "oneshot": _fewshot(1), "fewshot": _fewshot(5), "paraphrase": _paraphrase,
    "self_instruct_faithful_neutral": _instruct, "rubric_guided_contrastive_synthesis": _contrastive,
}


def _method(run: Run) -> Callable:
    """The method's function of (run, pool, limits): one named in the settings as 'module:function', else a built-in one."""
    target = run.config.values["custom_methods"].get(run.method)
    if target:
        return methods.custom(target)
    if run.method not in BUILT_IN:
        raise ValueError(f"unknown method: {run.method}")
    return BUILT_IN[run.method]


def _labels(rows: DataFrame) -> set[str]:
    return {r["label"] for r in rows.filter(F.col("label").isin(*LABELS)).select("label").distinct().collect()}


def generate(run: Run) -> dict | None:
    """Write the run's rows and, if they suffice, hand them to training; the document about them, or None if left alone.

    Rows suffice if they are as many as asked for, or if the method allows fewer and both labels occur.
    """
    out, train, about = f"{run.folder}/generated.jsonl", f"{run.folder}/train.jsonl", f"{run.folder}/generation_meta.json"
    size = run.config.of("generation", "n_samples")
    if not run.overwrite and files.exists(run.spark, train):
        there, meta = jsonl.count_lines(run.spark, train), jsonl.read_document(about)
        if there >= size:
            return None
        if meta and c.allows_incomplete(run.method, meta) and there >= int(meta.get("min_required_items", 1)) and set(LABELS) <= _labels(jsonl.read_jsonl(run.spark, train)):
            return None
    if run.dry_run:
        return None
    for path in (out, train, about):
        files.remove(run.spark, path)
    limits = methods.Limits(size=size, attempts=run.config.of("generation", "attempt_cap"))
    made = _method(run)(run, run.pool(), limits)
    rows, meta = made if isinstance(made, tuple) else (made, {})
    jsonl.write_jsonl(rows.select("text", "label"), out)
    n = jsonl.count_lines(run.spark, out)
    meta = {"method": run.method, "seed": run.seed, "target_samples": size, "num_written": n, **meta}
    jsonl.write_document(about, meta)
    if n < size and not (c.allows_incomplete(run.method, meta) and n and set(LABELS) <= _labels(jsonl.read_jsonl(run.spark, out))):
        raise RuntimeError(f"{run.method} wrote {n} of {size} rows: {out}")
    files.copy(run.spark, out, train)
    return meta


# --- training and judging

def _sampled(rows: DataFrame, size: int, seed: int, trim: bool) -> DataFrame:
    """A stratified sample of ``size`` rows; all of them for a size of 0."""
    if not size:
        return rows
    keyed = rows.withColumn("row_id", F.md5(F.concat_ws(":", "label", "text").cast("binary"))).withColumn("all", F.lit(1))
    return stratified(keyed, size, seed, ["all"], trim).drop("row_id", "all")


def _write_results(folder: str, best: dict, history: list, config: dict, rows: DataFrame | None) -> dict:
    """Metrics, their twin under the older name, and the predictions."""
    result = {"best": best, "history": history, "config": config}
    for name in ("metrics", "adv_results"):
        jsonl.write_document(f"{folder}/{name}.json", result)
    if rows is not None:
        jsonl.write_jsonl(rows, f"{folder}/predictions.jsonl")
    return result


def train_eval(train: DataFrame, valid: DataFrame, test: DataFrame, folder: str, method: str, seed: int, train_data: str = "", calibrate: bool = True, keep_predictions: bool = True, other_test: DataFrame | None = None) -> dict:
    """Fit on the bootstrap sample of the seed, calibrate on the validation split, and write metrics and predictions of the
    test split. ``other_test``: a split of another dataset, of which metrics are added."""
    model = trained(train, seed=seed)
    threshold = calibrated(model, valid) if calibrate else None
    out = predictions(model, test, threshold)
    best: dict[str, Any] = {"threshold": threshold}
    for name, rows in (("in", out), ("cross", predictions(model, other_test, threshold) if other_test is not None else None)):
        if rows is not None:
            row = m.judged(rows.withColumn("all", F.lit(1)), ["all"]).first()
            best |= {f"{name}_test_acc": row.accuracy, f"{name}_test_f1": row.macro_f1, f"{name}_test_n": row.n_eval}
    history = [{"iteration": i, "loss": x} for i, x in enumerate(model.stages[-1].summary.objectiveHistory)]
    kept = out.select("text", "true_label", "pred_label", "correct", "logits", "probs", "margin", F.lit(threshold).cast("double").alias("threshold")) if keep_predictions else None
    return _write_results(folder, best, history, {"method": method, "seed": seed, "run_type": TRAINED, "train_data": train_data}, kept)


def evaluated(folder: str) -> bool:
    """Has a run a test accuracy?"""
    for place in (folder, f"{folder}/results"):
        if ((jsonl.read_document(f"{place}/metrics.json") or {}).get("best") or {}).get("in_test_acc") is not None:
            return True
    return False


def train(run: Run) -> dict | None:
    """Train on the run's rows, or for the official method on the training split."""
    results = f"{run.folder}/results"
    if files.exists(run.spark, f"{results}/metrics.json") and not run.overwrite or run.dry_run:
        return None
    data = run.of.split("train") if run.method == "official_train" else f"{run.folder}/train.jsonl"
    if not files.exists(run.spark, data):
        raise FileNotFoundError(f"no rows to train on: {data}")
    valid, test = (jsonl.load_validated(run.spark, run.of.split(s)) for s in ("valid", "test"))
    size = lambda s: run.config.of("trainer", f"eval_{s}_size")
    draw = run.config.of("trainer", "eval_subsample_seed")
    other = run.config.values["trainer"].get("cross_test")
    result = train_eval(
        jsonl.load_validated(run.spark, data), _sampled(valid, size("valid"), draw, True), _sampled(test, size("test"), draw, True), results, run.method, run.seed, data,
        run.config.of("trainer", "calibrate_threshold"), run.config.of("artifacts", "keep_predictions"), jsonl.load_validated(run.spark, other) if other else None,
    )
    if not run.config.of("artifacts", "keep_model_weights"):
        files.remove_model_files(run.spark, results)
    return result


def judge(run: Run) -> dict | None:
    """Judge the test split by the first-person rule, or by the provider with examples of the run's pool."""
    results = f"{run.folder}/results"
    if files.exists(run.spark, f"{results}/metrics.json") and not run.overwrite or run.dry_run:
        return None
    draw, size = (run.config.of("trainer", k) for k in ("eval_subsample_seed", "eval_test_size"))
    test = _sampled(jsonl.load_validated(run.spark, run.of.split("test")), size, draw, False)
    rows = test.withColumn("row_id", F.md5(F.concat_ws(":", "label", "text").cast("binary")))
    about = {"eval_test_size": size, "eval_subsample_seed": draw}
    if run.method == "first_person_rule":
        pred = F.when(t.has_word(F.col("text"), t.FIRST_PERSON), LABELS[1]).otherwise(LABELS[0])
        out = rows.select("text", F.col("label").alias("true_label"), pred.alias("pred_label"), (F.col("label") == pred).alias("correct"), F.lit(False).alias("parse_failed"), pred.alias("raw_response"))
    else:
        k = 1 if run.method == "oneshot_judge" else 5
        tries = 1 + run.config.of("direct_judge", "max_retries")
        about |= {"k_per_label": k, "max_retries": tries - 1, "seed_pool": run.of.pool(run.seed, run.config.of("seed_pool", "per_label"))}
        out = methods.judged_by(rows, run.pool(), run.provider, tries, k, run.seed).drop("row_id").checkpoint()
    row = m.judged(out.withColumn("all", F.lit(1)), ["all"]).first()
    best = {"in_test_acc": row.accuracy, "in_test_f1": row.macro_f1, "parse_failed": row.parse_failed, "n_eval": row.n_eval}
    return _write_results(results, best, [], {"method": run.method, "run_type": JUDGED, "seed": run.seed, **about}, out)


def check(run: Run) -> None:
    if not run.dry_run and not evaluated(run.folder):
        raise ValueError(f"no test accuracy in {run.folder}")


def aggregate(spark: SparkSession, root: str, datasets: dict[str, str] | None = None, names: list[str] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """Summary of all runs below ``root``; ``datasets`` (name to display name), ``names`` of methods and ``seeds`` limit it
    to a grid, every cell of which is then a row."""
    results = jsonl.run_results(spark, root)
    if seeds is not None:
        wanted = [(method, s) for method in names or [] for s in c.seeds_of(method, seeds)]
        results = results.join(F.broadcast(spark.createDataFrame(wanted, "method string, seed bigint")), ["method", "seed"], "left_semi")  # a row a run of the grid
    chosen = list(datasets) if datasets is not None else None
    summary = grid_summary(results, chosen, names)
    jsonl.write_summary(summary, root, datasets, chosen, names)
    return summary


# --- stages

def _each(runs: list[Run], step: Callable[[Run], object], at_once: int) -> None:
    """All runs, some at a time, each of small jobs; after all have ended, the first error is raised."""
    with ThreadPoolExecutor(max(1, at_once)) as threads:
        ended = [threads.submit(step, run) for run in runs]
    for one in ended:
        one.result()


def run_stages(spark: SparkSession, config: c.Config, stage: str, datasets: str = "all", chosen: str = "all", seeds: list[int] | None = None, provider: Provider | None = None, overwrite: bool = False, dry_run: bool = False, at_once: int = 1) -> list[str]:
    """Do one stage, or all, for the selected datasets, methods and seeds; the steps as lines 'step dataset method seed'."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    root, seeds = config.output_root, seeds or config.seeds
    allowed = list(config.datasets)
    found = jsonl.discovered(root, allowed) if stage == "aggregate" else []
    names = jsonl.selected(datasets, allowed, sorted({d for d, _ in found}, key=allowed.index) or allowed)
    usual = config.values["methods"]["direct_judge"] if stage == "direct_judge" else config.values["methods"]["train"]
    if stage == "aggregate":
        usual = [x for x in config.methods if any(mm == x for d, mm in found if d in names)] or config.methods
    listed = jsonl.selected(chosen, config.methods, usual)
    done: list[str] = []

    def step(name: str, action: Callable[[Run], object], wanted: Callable[[str], bool], of: Callable[[str], list[int]] = lambda _: seeds) -> None:
        runs = [Run(spark, config, root, d, x, s, provider, overwrite, dry_run) for d in names for x in listed if wanted(x) for s in of(x)]
        done.extend(f"{name} {r.dataset} {r.method} {r.seed}" for r in runs)
        _each(runs, action, at_once)

    own = lambda x: c.seeds_of(x, seeds)
    if stage in ("prepare", "all"):
        for d in names:
            done.append(f"prepare {d}")
            if not dry_run:
                prepare(spark, str(config.datasets[d].split_dir), seeds, config.of("seed_pool", "per_label"), overwrite, str(config.datasets[d].pool_root))
    if stage in ("generate", "all"):
        step("generate", generate, lambda x: x in c.GENERATED_METHODS or x in config.values["custom_methods"] or x in BUILT_IN)
    if stage in ("train_eval", "all"):
        step("train_eval", train, lambda x: x not in c.JUDGE_METHODS, own)
    if stage in ("direct_judge", "all"):
        step("direct_judge", judge, lambda x: x in c.JUDGE_METHODS, own)
    if stage in ("eval", "all"):
        step("eval", check, lambda x: True, own)
    if stage in ("aggregate", "all"):
        done.append("aggregate")
        if not dry_run:
            aggregate(spark, root, {d: config.datasets[d].display_name for d in names}, listed, seeds)
    return done


def check_capacity(spark: SparkSession, url: str, model: str | None) -> None:
    """An error if the endpoint at ``url`` is busy; one that shows no figures counts as free."""
    from ..operators.aggregate import endpoint_load
    from ..operators.provider import fetched_page

    lines = fetched_page(endpoint_page(url))
    if lines is not None and not has_capacity(endpoint_load(spark.createDataFrame([(x,) for x in lines] or [("",)], "line string"), model)):
        raise RuntimeError(f"the endpoint is busy: {url}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("settings")
    parser.add_argument("--stage", choices=STAGES, default="all")
    for name in ("datasets", "methods"):
        parser.add_argument(f"--{name}", default="all", help="comma-separated names, or all")
    parser.add_argument("--seeds", nargs="+", type=int)
    parser.add_argument("--n-samples", type=int)
    parser.add_argument("--at-once", type=int, default=1, help="runs at a time")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    config = c.load_config(args.settings)
    if args.n_samples:
        config = replace(config, values={**config.values, "generation": {**config.values["generation"], "n_samples": args.n_samples}})
    spark = SparkSession.builder.getOrCreate()
    made = config.values["generation"]
    provider = ChatEndpoint(made["url"], made["model"], float(made["temperature"]))
    if not args.dry_run and args.stage in ("generate", "direct_judge", "all"):
        check_capacity(spark, provider.url, provider.model)
    for line in run_stages(spark, config, args.stage, args.datasets, args.methods, args.seeds, provider, args.overwrite, args.dry_run, args.at_once):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
