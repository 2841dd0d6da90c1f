"""Shared plumbing of the training-data operators: tables, durable intermediates, 3-gram sets."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The characters that Unicode lists as White_Space.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = re.compile(f"[{UNICODE_SPACE}]+")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table; with ``columns`` only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local, as in tests, a temporary folder is made and set; on a cluster such
    a folder would be one machine's, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="seedloom-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _target(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = _target(spark, path)
    system.delete(target, True)


class Workspace:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._seedloom_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no pending result reads any more."""
        for df in tables:
            delete(self.spark, df._seedloom_path)

    def clear(self) -> None:
        """Delete all its tables."""
        delete(self.spark, self.root)


def normalise(text: str | None) -> str:
    """Lower case; every run of Unicode white space becomes one space; no trimming. Null gives ''."""
    return "" if text is None else _SPACE_RUN.sub(" ", text.lower())


def gram_codes(text: str | None) -> np.ndarray:
    """Sorted distinct 3-character strings of the normalised text, each as one exact integer.

    A code point needs 21 bits, so three of them fit one 64-bit integer without loss.
    """
    points = np.frombuffer(normalise(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    grams.sort()
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Shared share of two sets given as sorted distinct arrays; 0 if either is empty."""
    if not len(left) or not len(right):
        return 0.0
    both = np.concatenate((left, right))
    both.sort(kind="mergesort")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(left) + len(right) - shared)
