"""The acceptance loop as a stream: micro-batches of generated rows against the accepted ones so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t


def accept_batch(batch: DataFrame, path: str, epoch: int) -> None:
    """Write the rows (id, text, label) of a batch whose normalised text is new to a folder of its epoch below ``path``.

    A batch that is delivered again overwrites its own folder and compares with earlier epochs only, so results don't
    depend on retries.
    """
    spark = batch.sparkSession
    keyed = batch.filter("text is not null").withColumn("key", F.md5(t.normalise(F.col("text")).cast("binary")))
    first = keyed.groupBy("key").agg(F.min("id").alias("id"))
    fresh = keyed.join(first, ["key", "id"], "left_semi").dropDuplicates(["key"])
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        known = spark.read.schema("key string, epoch bigint").parquet(path).filter(F.col("epoch") < epoch)
        fresh = fresh.join(known.select("key"), "key", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def accept_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run ``accept_batch`` over a stream of rows (id, text, label) until what is there has been read."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: accept_batch(batch, path, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
