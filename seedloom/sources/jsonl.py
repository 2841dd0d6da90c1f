"""JSON-lines files, meta documents, label maps and summaries at the edges of the engine."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LABELS, strip
from ..operators.aggregate import FIELDS, markdown_lines
from . import files

EXAMPLE = "text string, label string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = EXAMPLE) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_physical_lines(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """(file, line_no, row, broken) of files with the numbers of their physical lines, blank ones left out.

    A file is read in splits, in the order of which its lines come; each split's lines are counted, and numbered from the
    count of the splits before it. So a file may be of any size.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    placed = spark.read.text(path).select("value", file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"))
    first = placed.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    below = first.withColumn("below", F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n"))  # a row a split
    numbered = placed.join(below, ["file", "start"]).withColumn("line_no", (F.col("below") + F.col("at") - F.col("first") + 1).cast("int"))
    lines = numbered.filter(strip(F.col("value")) != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.select("file", "line_no", row.alias("row"), F.try_parse_json("value").isNull().alias("broken"))


def violations(rows: DataFrame) -> DataFrame:
    """Rows without text or with a label outside the domain."""
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    return rows.filter(blank | ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)))


def load_validated(spark: SparkSession, path: str) -> DataFrame:
    """Rows with stripped texts; an empty file or a refused row is an error."""
    rows = read_jsonl(spark, path)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    if bad := violations(rows).limit(1).collect():
        raise ValueError(f"refused row in {path}: {bad[0].asDict()}")
    return rows.withColumn("text", strip(F.col("text")))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, "append")


def load_pool(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a seed pool with the order of their names, so Non-sensitive rows come first."""
    rows = read_jsonl(spark, folder).withColumn("file", F.input_file_name())
    if rows.isEmpty():
        raise ValueError(f"empty seed pool {folder}")
    return rows


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank; 0 if there is no such file."""
    if not files.exists(spark, path):
        return 0
    return spark.read.text(path).filter(strip(F.col("value")) != "").count()


def write_document(path: str | Path, payload: object) -> None:
    """A JSON document, put in place by a rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_suffix(path.suffix + ".tmp")
    draft.write_text(json.dumps(payload, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(draft, path)


def read_document(path: str | Path) -> dict | None:
    """A JSON document; None if it is missing or unreadable."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def label_ids(keys: list[str] | None = None) -> dict[str, int]:
    """Label to id: the position in the map's order of keys, whatever its values are."""
    return {name: i for i, name in enumerate(keys or LABELS)}


def run_folder(root: str, dataset: str, method: str, seed: int) -> Path:
    return Path(root) / dataset / method / f"seed_{seed}"


def discovered(root: str, allowed: list[str]) -> list[tuple[str, str]]:
    """(dataset, method) folders below ``root`` whose dataset is allowed, sorted."""
    base = Path(root)
    found = [(d.name, m.name) for d in sorted(base.iterdir()) if d.is_dir() and d.name in allowed for m in sorted(d.iterdir()) if m.is_dir()] if base.is_dir() else []
    return found


def selected(value: str, allowed: list[str], default: list[str]) -> list[str]:
    """Names of a comma-separated selection, 'all' meaning the default; unknown names are an error."""
    names = default if value.strip() == "all" else [x.strip() for x in value.split(",") if x.strip()]
    if unknown := sorted(set(names) - set(allowed)):
        raise ValueError(f"unknown values: {', '.join(unknown)}")
    return names


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, method, seed, accuracy, macro_f1) of all metrics documents in the run layout, in a run's folder or its
    ``results``; none without such documents."""
    shape = "best struct<in_test_acc: double, in_test_f1: double>"
    places = [f"{root}/*/*/seed_*/{inner}metrics.json" for inner in ("", "results/")]
    there = [p for p in places if files.matches(spark, p)]
    if not there:
        return spark.createDataFrame([], "dataset string, method string, seed bigint, accuracy double, macro_f1 double")
    path = r"/([^/]+)/([^/]+)/seed_(\d+)/(?:results/)?metrics\.json$"
    rows = spark.read.schema(shape).option("multiLine", True).json(there).select("best", F.input_file_name().alias("p"))
    part = lambda i: F.regexp_extract("p", path, i)
    return rows.select(part(1).alias("dataset"), part(2).alias("method"), part(3).cast("bigint").alias("seed"), F.col("best.in_test_acc").alias("accuracy"), F.col("best.in_test_f1").alias("macro_f1"))


def write_summary(summary: DataFrame, folder: str, names: dict[str, str] | None = None, datasets: list[str] | None = None, methods: list[str] | None = None) -> None:
    """summary.csv, summary.json and summary.md of a grid summary, which has a row per dataset and method, in the order of
    the lists, else by name. ``names``: what datasets are shown as."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    frame = summary.toPandas()
    frame["display_name"] = [(names or {}).get(x, x) for x in frame["dataset"]]
    place = {c: {x: i for i, x in enumerate(given or sorted(set(frame[c])))} for c, given in (("dataset", datasets), ("method", methods))}
    frame = frame.sort_values(["dataset", "method"], key=lambda c: c.map(place[c.name]))[FIELDS]
    frame.to_csv(base / "summary.csv", index=False)
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    write_document(base / "summary.json", rows)
    (base / "summary.md").write_text("\n".join(["# Summary", "", *markdown_lines(rows)]) + "\n", encoding="utf-8")
