"""Files of a run and of a release: copies, removal, walks and scans. Paths are those of any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files of a trained model, what a release holds and which folders it leaves out.
MODEL_FILES = ["*.safetensors", "*.bin", "*.pt", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.json", "merges.txt"]
RELEASE_SUFFIXES = [".md", ".py", ".sh", ".toml", ".yaml", ".yml"]
RELEASE_NAMES = [".gitignore", "uv.lock"]
LEFT_OUT = [".git", ".serena", ".venv", "__pycache__", "build", "data", "dist", "outputs"]


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def matches(spark: SparkSession, pattern: str) -> bool:
    system, place = _place(spark, pattern)
    return bool(system.globStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    system, place = _place(spark, path)
    system.delete(place, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder over another, unless they are the same."""
    (a, source_), (b, target_) = _place(spark, source), _place(spark, target)
    if a.makeQualified(source_).equals(b.makeQualified(target_)):
        return
    b.delete(target_, True)
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.FileUtil.copy(a, source_, b, target_, False, spark.sparkContext._jsc.hadoopConfiguration())


def remove_model_files(spark: SparkSession, folder: str) -> int:
    """Delete the files of a trained model in a folder; how many there were."""
    removed = 0
    for pattern in MODEL_FILES:
        system, place = _place(spark, f"{folder}/{pattern}")
        for status in system.globStatus(place) or []:
            system.delete(status.getPath(), True)
            removed += 1
    return removed


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the release's files whose names begin with a dot, which file sources pass over; a few."""
    system, place = _place(spark, root)
    jvm, found, rows = spark.sparkContext._jvm, system.listFiles(place, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith(".") and path.getName() in RELEASE_NAMES:
            stream = system.open(path)
            rows.append((path.toString(), bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return spark.createDataFrame(rows, "path string, content binary")


def release_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, line) of all files of a release below ``root``: those of the listed kinds, outside left-out folders.

    ``path`` is relative to ``root``. Bytes that are no UTF-8 become replacement characters.
    """
    system, place = _place(spark, root)
    base = system.makeQualified(place).toString().removeprefix("file:").rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    raw = raw.unionByName(_hidden(spark, root)).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    files = raw.withColumn("path", F.substring("path", len(base) + 2, 1 << 20)).withColumn("parts", F.split("path", "/"))
    name = F.element_at("parts", -1)
    kind = F.regexp_extract(name, r"(\.[^.]+)$", 1).isin(RELEASE_SUFFIXES) & ~name.rlike(r"^\.[^.]*$") | name.isin(RELEASE_NAMES)
    inside = ~F.arrays_overlap("parts", F.array(*map(F.lit, LEFT_OUT)))
    text = F.decode(F.col("content"), "UTF-8")
    return files.filter(kind & inside).select("path", F.posexplode(F.split(text, "\n")).alias("at", "line")).select("path", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def findings(lines: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, line_no, pattern, match) of all matches in lines (path, line_no, line)."""
    found = F.array(*(F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all("line", F.lit(f"({rx})"), F.lit(1)).alias("m")) for name, rx in patterns))
    each = lines.select("path", "line_no", F.explode(found).alias("f"))
    return each.select("path", "line_no", "f.pattern", F.explode("f.m").alias("match"))


def release_scan(spark: SparkSession, root: str, patterns: list[tuple[str, str]]) -> int:
    """Print what a release must not hold; 1 if there is any, else 0."""
    hits = findings(release_files(spark, root), patterns).orderBy("path", "line_no", "pattern").toLocalIterator()
    status = 0
    for r in hits:
        print(f"{r.path}:{r.line_no}: {r.pattern}: {r.match}")
        status = 1
    return status
