"""Filling containers of fixed capacity (problem 6): bounded-space online best fit, leftovers merged at the end."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace, table
from .token_counts import TOKENIZER, token_counts

#: Windows that a partition keeps open per capacity.
OPEN_WINDOWS = 256
#: Items of a partition, on average: contents of containers follow from the items alone, not from the session.
PART_ITEMS = 8_192
#: Capacities that are packed in one pass over the items; more take further passes.
PASS = 256
#: Partitions whose leftovers are merged by one task in a round.
MERGE = 16


class Packer:
    """Bounded-space best fit: at most ``limit`` open windows, of which the fullest is closed when no one fits."""

    def __init__(self, capacity: int, limit: int = OPEN_WINDOWS) -> None:
        self.capacity, self.limit, self.windows = capacity, limit, 0
        self.open: list[tuple[int, int]] = []  # (room left, window), sorted

    def place(self, size: int) -> int:
        """The window of an item of at most the capacity."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)
            room, window = self.capacity, self.windows
            self.windows += 1
        if room > size:
            insort(self.open, (room - size, window))
        return window


def _pieces(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, size): the whole item, or full pieces and a rest if it exceeds the capacity."""
    for piece, start in enumerate(range(0, n, capacity)):
        yield piece, start, min(capacity, n - start)


def packed(sizes: DataFrame, packs: DataFrame, id_col: str, size_col: str = "n_tokens", limit: int = OPEN_WINDOWS) -> DataFrame:
    """(pack_name, container_id, id, piece_no, start_token, n_tokens): a container for every item and capacity.

    ``packs``: pack_name, capacity_tokens; null or non-positive capacities are ignored, packs of one capacity are filled
    alike. Items without a positive size get no container. Only an item above the capacity is split, into full pieces
    and one rest. Each partition packs its items as they come with ``limit`` open windows; the windows still open at its
    end are packed into each other, ``MERGE`` partitions per task and round, biggest first. Ids may repeat: every row is
    packed.
    """
    spark = sizes.sparkSession
    work = Workspace(spark, "packing")
    wanted = packs.filter("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # one number per distinct capacity reaches the driver
    capacities = [r.capacity for r in wanted.select("capacity").distinct().orderBy("capacity").collect()]
    kind = dict(sizes.dtypes)[id_col]
    items = sizes.filter(F.col(size_col) > 0).select(id_col, F.col(size_col).cast("bigint").alias("n"))
    parts = max(1, -(-items.count() // PART_ITEMS))
    # an order that doesn't depend on the run: by id, and rows are short here
    items = items.repartition(parts, F.col(id_col), F.col("n")).sortWithinPartitions(F.xxhash64(id_col), id_col, "n")
    schema = f"`{id_col}` {kind}, capacity bigint, part int, window bigint, piece_no bigint, start_token bigint, n_tokens bigint"

    def placing(chosen: list[int]):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            packers = [Packer(c, limit) for c in chosen]
            for batch in batches:
                at, rows = [], []
                for i, n in enumerate(batch.column(1).to_pylist()):
                    for packer in packers:
                        for piece, start, size in _pieces(n, packer.capacity):
                            at.append(i)
                            rows.append((packer.capacity, packer.place(size), piece, start, size))
                capacity, window, piece, start, size = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(capacity, pa.int64()), pa.array([part] * len(at), pa.int32()), *(pa.array(x, pa.int64()) for x in (window, piece, start, size))], [id_col, "capacity", "part", "window", "piece_no", "start_token", "n_tokens"])

        return place

    whole = spark.createDataFrame([], f"pack_name string, container_id string, `{id_col}` {kind}, piece_no bigint, start_token bigint, n_tokens bigint")
    for first in range(0, len(capacities), PASS):
        placed = work.keep(items.mapInArrow(placing(capacities[first : first + PASS]), schema), "placed")
        filled = placed.groupBy("capacity", "part", "window").agg(F.sum("n_tokens").alias("fill"))
        named = placed.join(_merged(work, filled, limit), ["capacity", "part", "window"]).join(wanted, "capacity")
        whole = whole.union(named.select("pack_name", "container_id", id_col, "piece_no", "start_token", "n_tokens"))
    return whole


def _merged(work: Workspace, filled: DataFrame, limit: int) -> DataFrame:
    """(capacity, part, window, container_id): windows that aren't full go into each other, round by round.

    A round hands to one task, per capacity, the ``limit`` windows with the most room of each of ``MERGE`` partitions, to be
    packed into each other, fullest first; of the outcome again ``limit`` windows go on to the next round. So a task
    never holds more than ``MERGE * limit`` windows, however many partitions there are.
    """

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(int(pdf["capacity"].iloc[0]), len(pdf) + 1)
        pdf = pdf.sort_values(["fill", "part", "window"], ascending=[False, True, True])
        slot = [packer.place(int(f)) for f in pdf["fill"]]
        lead = {}
        for s, p, w in zip(slot, pdf["part"], pdf["window"], strict=True):
            lead.setdefault(s, (p, w))
        return pd.DataFrame({"capacity": pdf["capacity"], "part": pdf["part"], "window": pdf["window"], "fill": pdf["fill"], "to_part": [lead[s][0] for s in slot], "to_window": [lead[s][1] for s in slot]})

    def loosest(windows: DataFrame, span: int) -> DataFrame:
        """Of every ``span`` partitions the ``limit`` windows with the most room."""
        by = Window.partitionBy("capacity", F.floor(F.col("part") / span).cast("int")).orderBy("fill", "part", "window")
        return windows.filter(F.col("fill") < F.col("capacity")).withColumn("at", F.row_number().over(by)).filter(F.col("at") <= limit).drop("at")

    place = filled.select("capacity", "part", "window", F.col("part").alias("to_part"), F.col("window").alias("to_window"))
    parts = (filled.agg(F.max("part")).first()[0] or 0) + 1
    loose, span = loosest(filled, 1), 1
    while span < parts:
        span *= MERGE
        group = F.floor(F.col("part") / span).cast("int").alias("group")
        step = loose.select("*", group).groupBy("capacity", "group").applyInPandas(repack, "capacity bigint, part int, window bigint, fill bigint, to_part int, to_window bigint")
        step = work.keep(step, "merged")
        moved = step.select("capacity", F.col("part").alias("to_part"), F.col("window").alias("to_window"), F.col("to_part").alias("new_part"), F.col("to_window").alias("new_window"))
        joined = place.join(moved, ["capacity", "to_part", "to_window"], "left")
        place = work.keep(joined.select("capacity", "part", "window", F.coalesce("new_part", "to_part").alias("to_part"), F.coalesce("new_window", "to_window").alias("to_window")), "windows")
        merged = step.groupBy("capacity", F.col("to_part").alias("part"), F.col("to_window").alias("window")).agg(F.sum("fill").alias("fill"))
        loose = loosest(merged, span)
    return place.select("capacity", "part", "window", F.concat_ws("-", "capacity", "to_part", "to_window").alias("container_id"))


def pack_documents(documents: DataFrame, packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers for all non-blank documents, sized in tokens of a public tokenizer; see ``packed``."""
    sizes = Workspace(documents.sparkSession, "sizes").keep(token_counts(documents, "doc_id", "text", tokenizer=tokenizer), "sizes")
    return packed(sizes, packs, "doc_id")


def p6_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "pack_sizes"))


def p6_fill_report(spark, sf_dir):
    """Per capacity: containers, documents, split documents, tokens, and the filled share of all room."""
    packs = table(spark, sf_dir, "pack_sizes")
    placed = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), packs)
    boxes = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("fill")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"))
    splits = placed.groupBy("pack_name").agg(F.sum(F.expr("cast(piece_no = 0 as int)")).alias("documents"), F.sum(F.expr("cast(piece_no = 1 as int)")).alias("split_documents"))
    room = F.col("containers") * F.col("capacity_tokens")
    return boxes.join(splits, "pack_name").join(packs, "pack_name").select("pack_name", "capacity_tokens", "containers", "documents", "split_documents", "tokens", (F.col("tokens") / room).alias("filled_share"))
