"""New batches against all accepted history (problem 1): a pivot-distance table that is appended to.

The metric is the size of the symmetric difference, d(x, y) = |x| + |y| - 2 |x & y|, on sets of 3-grams; similarity t
or more means d(x, y) <= (1 - t) / (1 + t) * (|x| + |y|). A hash splits the gram universe into ``PIVOTS`` disjoint
parts, so d is the sum of the metrics d_j of the parts. The fixed pivot of each part is the empty set, the distance to
it is c_j(x), the number of grams of x in the part, and the triangle inequality in every part gives

    d(x, y) >= sum_j |c_j(x) - c_j(y)|,

so a pair whose pivot distances differ by more than the bound can't be similar. The whole universe with the same pivot
gives | |x| - |y| | <= d(x, y), the condition on sizes. The table holds c_j as a cyclic code of ``CODE`` bits whose
Hamming distance never exceeds |c_j(x) - c_j(y)|: pruning then is a few XORs, and loses nothing.

Distances between unlike texts lie in a narrow band (mean 0.89, deviation 0.03 as 1 - similarity), so no single pivot
distance, and no range of it, separates one text from the mass of others. Therefore the table is also cut into
cells, the blocks of ``fingerprint``, and pairs are formed in cells (``cells``). In a crowded cell the first accepted
member is a further pivot: Hamming distances H of codes are a metric below d, so similar x and y fulfil

    |H(x, pivot) - H(y, pivot)| <= H(x, y) <= d(x, y),

and the pairs are formed by ranges of that distance, within which the sizes and codes prune.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, delete, exists, table
from .cells import CODE, FINGERPRINT_BANDS, PIVOTS, pivot_codes, rounds, share, signed, tidy
from .fingerprint import Summary, verified


def _pivot_code(hashed: np.ndarray, least: np.ndarray) -> np.ndarray:
    return pivot_codes(hashed, np.zeros(len(hashed), np.int64), 1)[0].view(np.int64)


def _triangle(distance: Column, a: Column, b: Column, threshold: float) -> Column:
    return distance <= F.lit(share(threshold)) * (a + b) + F.lit(1e-9)


PIVOT_TABLE = Summary(PIVOTS * CODE // 64, _pivot_code, _triangle)

#: Number of a batch that is probed but not accepted: later than all.
LAST = 2**62
_KEYS = FINGERPRINT_BANDS.columns
_COLUMNS = {
    "cells": f"id bigint, batch bigint, n int, same bigint, code binary, {', '.join(f'{k} binary' for k in _KEYS)}, part int",
    "records": "id bigint, text string",
}


class BatchIndex:
    """The pivot-distance table of all accepted records, in a folder that grows by one part per accepted table.

    ``probe`` finds the rows of a new batch that repeat an accepted one, ``append`` accepts rows, ``add`` does both for one
    or several new batches and signs them once. History is never signed again: its pivot codes and the keys of its cells
    are stored, its texts lie in buckets of the id, to which pairs are shuffled. Of history only its members in cells of a
    small new batch are shuffled, and the identities of its sets. Pairs are pruned by the triangle inequality where their
    cell meets, of each text the nearest one is verified first, others only where that fails. A crowded cell is first asked
    for its pivot, and for texts that this leaves open by ranges of the pivot distance.

    Records of one gram set form a class, of which the first is stored; a class that is stored isn't stored again.
    Null texts, texts under three characters and rows without id repeat nothing and are accepted without an entry.
    An index is written by one session at a time; ``buckets`` is fixed when its first rows are accepted.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.70, buckets: int | None = None) -> None:
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"seedloom_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _stored(self, kind: str) -> DataFrame | None:
        """The table of cells or records, registered if need be; None before anything is accepted."""
        name = f"{self.name}_{kind}"
        if not self.spark.catalog.tableExists(name):
            if not exists(self.spark, f"{self.path}/layout"):
                return None
            self.buckets = self.spark.read.parquet(f"{self.path}/layout").first().buckets
            by = f"CLUSTERED BY (id) INTO {self.buckets} BUCKETS" if kind == "records" else ""
            self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS[kind]}) USING parquet {by} LOCATION '{self.path}/{kind}'")
        return self.spark.table(name)

    def _signed(self, work: Workspace, df: DataFrame, id_col: str, text_col: str, number: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, first, signed) of new rows: (id, batch, n, same), the same with per gram set only the least id of its first
        batch, and rows with codes and keys."""
        numbered = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), number.cast("bigint").alias("batch"))
        made = work.keep(signed(numbered.filter("id is not null and batch is not null"), FINGERPRINT_BANDS, {"batch": "bigint"}), "signed")
        rows = work.keep(made.select("id", "batch", "n", "same"), "rows")
        at = F.min(F.struct("batch", "id")).alias("at")
        return rows, rows.groupBy("same", "n").agg(at).select("at.id", "at.batch", "n", "same"), made

    def _fresh(self, work: Workspace, rows: DataFrame, first: DataFrame, copies: DataFrame, made: DataFrame) -> DataFrame:
        """What is signed, without the rows that aren't the first of their class and without classes that are stored."""
        other = rows.join(first.select("same", "n", F.col("id").alias("own"), F.col("batch").alias("at")), ["same", "n"]).filter("id <> own or batch <> at")
        out = work.keep(other.select("id", "batch", "same").union(copies.select("id", "batch", "same")), "out")
        return made.join(out, ["id", "batch", "same"], "left_anti")

    def _accept(self, fresh: DataFrame, df: DataFrame, id_col: str, text_col: str) -> int:
        """Store new classes; gives the number of their part."""
        # registers an index that is there, which else would be overwritten, and takes its number of buckets over
        cells, _ = self._stored("cells"), self._stored("records")
        part = 0 if cells is None else (cells.agg(F.max("part")).first()[0] or 0) + 1
        if cells is None:
            self.spark.createDataFrame([(self.buckets,)], "buckets int").write.parquet(f"{self.path}/layout")
        self._append(fresh.withColumn("part", F.lit(part)).write, "cells")
        # both sides are shuffled once, to the buckets
        own = self.spark.table(f"{self.name}_cells").filter(F.col("part") == part).select("id").repartition(self.buckets, "id")
        texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartition(self.buckets, "id")
        records = texts.hint("merge").join(own, "id").dropDuplicates(["id"]).select("id", "text")
        self._append(records.write.bucketBy(self.buckets, "id"), "records")
        return part

    def _append(self, writer, kind: str) -> None:
        writer.mode("append").option("compression", "zstd").option("path", f"{self.path}/{kind}").saveAsTable(f"{self.name}_{kind}")

    def append(self, batch: DataFrame, id_col: str = "row_id", text_col: str = "text", number: int = 0) -> None:
        """Accept the rows of a batch."""
        work = Workspace(self.spark, "append")
        with tidy(self.spark):
            rows, first, made = self._signed(work, batch, id_col, text_col, F.lit(number))
            self._accept(self._fresh(work, rows, first, self._copies(first), made), batch, id_col, text_col)
        work.clear()

    def probe(self, batch: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
        """Ids of the rows of ``batch`` that repeat an accepted row."""
        return self._run(batch, id_col, text_col, F.lit(LAST), False)

    def add(self, batches: DataFrame, id_col: str = "row_id", text_col: str = "text", batch_col: str = "batch_no") -> DataFrame:
        """Accept new batches, told apart by ``batch_col``, and give the ids of their rows that repeat a row of a smaller
        batch, be it accepted before or now. Their numbers follow those accepted before."""
        return self._run(batches, id_col, text_col, F.col(batch_col), True)

    def _run(self, df: DataFrame, id_col: str, text_col: str, number: Column, accept: bool) -> DataFrame:
        work, out = Workspace(self.spark, "batch"), Workspace(self.spark, "repeats")
        with tidy(self.spark):
            rows, first, made = self._signed(work, df, id_col, text_col, number)
            copies = work.keep(self._copies(first), "copies")
            fresh = self._fresh(work, rows, first, copies, made)
            if accept:
                part = self._accept(fresh, df, id_col, text_col)
                members = self._stored("cells").withColumn("fresh", F.col("part") == part)
                mine = self._stored("records")
            else:
                members, mine = work.keep(fresh, "fresh").withColumn("fresh", F.lit(True)), df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
                if (cells := self._stored("cells")) is not None:
                    members = members.unionByName(cells.drop("part").withColumn("fresh", F.lit(False)))
            work.drop(made)
            near = self._near(work, members, mine)
            linked = copies.select("id", "batch", "same").union(near.join(first, "id").select("id", "batch", "same")).distinct().withColumn("linked", F.lit(True))
            known = first.join(linked, ["id", "batch", "same"], "left").select("same", "n", F.col("batch").alias("first"), "linked")
            hit = rows.join(known, ["same", "n"]).filter((F.col("batch") > F.col("first")) | F.col("linked"))
            found = out.keep(hit.select(F.col("id").alias(id_col)).distinct(), "repeats")
        work.clear()
        return found

    def _copies(self, first: DataFrame) -> DataFrame:
        """The classes whose very gram set is stored."""
        cells = self._stored("cells")
        return first.limit(0) if cells is None else first.join(cells.select("same", "n"), ["same", "n"], "left_semi").select(first.columns)

    def _near(self, work: Workspace, members: DataFrame, mine: DataFrame) -> DataFrame:
        """Ids of the fresh classes that are similar to a member of a smaller batch."""
        tables, crowded = rounds(work, members, FINGERPRINT_BANDS, self.threshold)
        found = self._confirmed(work, tables, mine)
        if crowded:
            # what a pivot or a nearest one has confirmed needs no further partner, but may be one
            known = found.withColumn("known", F.lit(True))
            still = work.keep(members.join(known, "id", "left").withColumn("fresh", F.col("fresh") & F.col("known").isNull()).select("id", "batch", "n", "fresh", "code", *crowded), "open")
            tables, _ = rounds(work, still, FINGERPRINT_BANDS, self.threshold, crowded)
            work.drop(still)
            found = found.union(self._confirmed(work, tables, mine)).distinct()
        return found

    def _confirmed(self, work: Workspace, tables: list[DataFrame], mine: DataFrame) -> DataFrame:
        """Classes b with a pair of the wanted similarity. One similar record is enough, so the nearest is tried first."""
        history, others = self._stored("records"), mine.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        if history is None:
            return mine.select("id").limit(0)
        pairs = work.keep(reduce(DataFrame.union, tables).distinct(), "pairs")
        nearest = work.keep(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("at")).select(F.col("at.a").alias("a"), "b"), "nearest")
        first = work.keep(verified(nearest, history, self.threshold, others).select(F.col("b").alias("id")), "found")
        rest = work.keep(pairs.select("a", "b").join(first.withColumnRenamed("id", "b"), "b", "left_anti").join(nearest, ["a", "b"], "left_anti"), "rest")
        more = work.keep(verified(rest, history, self.threshold, others).select(F.col("b").alias("id")).distinct(), "found")
        return first.union(more)

    def drop(self) -> None:
        """Delete the index."""
        for kind in _COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
        delete(self.spark, self.path)


def repeats_of_earlier(df: DataFrame, id_col: str = "row_id", text_col: str = "text", batch_col: str = "batch_no", threshold: float = 0.70) -> DataFrame:
    """Ids of the rows that repeat, exactly or nearly, a row of an earlier batch.

    A ``BatchIndex`` accepts the first batch, which is history, and is then given the others, in one ``add``, as they have
    all arrived; feeding them one by one gives the same rows.

    Null texts, texts under three characters and rows without id or batch repeat nothing; rows of one batch don't count
    as repeats of each other; further columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    index = BatchIndex(spark, f"{Workspace(spark, 'batch-history').root}/index", threshold)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(batch_col).cast("bigint").alias("batch"))
    first = rows.agg(F.min("batch")).first()[0]
    if first is None:
        return rows.select(F.col("id").alias(id_col)).limit(0)
    index.append(rows.filter(F.col("batch") == first), "id", "text", first)
    found = index.add(rows.filter(F.col("batch") > first), "id", "text", "batch")
    index.drop()
    return found.withColumnRenamed("id", id_col)


def p1_found(spark, sf_dir):
    return repeats_of_earlier(table(spark, sf_dir, "synthetic_data", "row_id", "batch_no", "text"))
