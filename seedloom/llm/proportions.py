"""Samples of given category proportions (problem 4): quotas by min-cost flow over cross-classified cells."""

from __future__ import annotations

import math
import random
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import table
from .draw import draw

#: Cells whose counts the driver handles, at most; more are refused, none is left out.
MAX_CELLS = 200_000
SEED = 7


class Flow:
    """A network with capacities and costs; ``send`` moves units at least cost, one level of cost after another."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []  # the reverse arc follows each
        self.out: list[list[int]] = []
        self.nodes: dict[object, int] = {}

    def node(self, name: object) -> int:
        if name not in self.nodes:
            self.nodes[name] = len(self.out)
            self.out.append([])
        return self.nodes[name]

    def arc(self, a: object, b: object, capacity: int, cost: int) -> int:
        for start, end, units, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[self.node(start)].append(len(self.to))
            self.to.append(self.node(end))
            self.left.append(units)
            self.cost.append(price)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.left[arc + 1]

    def _costs(self, source: int) -> list[float]:
        """Least cost of every node from the source; label-correcting, as reverse arcs cost less than nothing."""
        best: list[float] = [math.inf] * len(self.out)
        best[source] = 0
        queue, waiting = deque([source]), {source}
        while queue:
            node = queue.popleft()
            waiting.discard(node)
            for k in self.out[node]:
                if self.left[k] and best[node] + self.cost[k] < best[self.to[k]]:
                    best[self.to[k]] = best[node] + self.cost[k]
                    if self.to[k] not in waiting:
                        waiting.add(self.to[k])
                        queue.append(self.to[k])
        return best

    def send(self, source: object, sink: object, units: int) -> int:
        """Units that reach the sink, at most ``units``. All paths of the least cost are filled at once, level by level,
        so the work grows with the number of different path costs and not with the number of paths."""
        first, last = self.node(source), self.node(sink)
        sent = 0
        while sent < units:
            best = self._costs(first)
            if best[last] == math.inf:
                break
            while sent < units:
                level = self._levels(first, best)
                if level[last] < 0:
                    break
                sent += self._fill(first, last, units - sent, best, level)
        return sent

    def _tight(self, node: int, k: int, best: list[float]) -> bool:
        return self.left[k] > 0 and best[self.to[k]] == best[node] + self.cost[k]

    def _levels(self, first: int, best: list[float]) -> list[int]:
        level = [-1] * len(self.out)
        level[first] = 0
        queue = deque([first])
        while queue:
            node = queue.popleft()
            for k in self.out[node]:
                if level[self.to[k]] < 0 and self._tight(node, k, best):
                    level[self.to[k]] = level[node] + 1
                    queue.append(self.to[k])
        return level

    def _fill(self, first: int, last: int, units: int, best: list[float], level: list[int]) -> int:
        """A blocking flow of the arcs on least-cost paths, depth first without recursion."""
        tried = [0] * len(self.out)
        sent, path, node = 0, [], first
        while sent < units:
            if node == last:
                step = min(units - sent, *(self.left[k] for k in path))
                for k in path:
                    self.left[k] -= step
                    self.left[k ^ 1] += step
                sent += step
                path, node = [], first
                continue
            arcs = self.out[node]
            while tried[node] < len(arcs):
                k = arcs[tried[node]]
                if level[self.to[k]] == level[node] + 1 and self._tight(node, k, best):
                    path.append(k)
                    node = self.to[k]
                    break
                tried[node] += 1
            else:
                if not path:
                    break
                node = self.to[path.pop() ^ 1]
                tried[node] += 1
        return sent


def _whole(shares: list[float], total: int, seed: int) -> list[int]:
    """Integers that add up to ``total`` and are each share * total rounded up or down, at random without bias."""
    exact = [s * total for s in shares]
    start = random.Random(seed).random()
    edges, at = [math.floor(start + 1e-9)], start
    for x in exact:
        at += x
        edges.append(math.floor(at + 1e-9))
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def _margins(cells: list[dict], units: list[int]) -> dict[tuple[str, object], int]:
    """Sums of the units by row and by column category."""
    sums: dict[tuple[str, object], int] = {}
    for c, n in zip(cells, units, strict=True):
        for margin in (("row", c["row"]), ("column", c["column"])):
            sums[margin] = sums.get(margin, 0) + n
    return sums


def quotas(cells: list[dict], total: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """(quota, shortfall) per cell; a cell has a row and a column category, share, floor and available rows.

    A cell wants its share of ``total``, and no less than its floor. In the first network those wants go from the row
    margins through the cells to the column margins, over arcs of the rows available and, at a cost, over slack arcs
    beside them, so the flow of a cell's slack arc is what it falls short of. In the second, ``total`` units take the same
    way, by availability: floors first, then shares, then, at growing cost, more than the share of a cell and more than
    a margin, so that what a cell lacks is made up for within its own row or column where possible.
    """
    targets = _whole([c["share"] for c in cells], total, seed)
    wanted = [max(math.ceil(round(c["share"] * total, 6)), c["floor"]) for c in cells]
    net, slack = Flow(), []
    for (kind, name), units in _margins(cells, wanted).items():
        net.arc(*(("source", (kind, name)) if kind == "row" else ((kind, name), "sink")), units, 0)
    for i, (c, w) in enumerate(zip(cells, wanted, strict=True)):
        net.arc(("row", c["row"]), i, c["available"], 0)
        slack.append(net.arc(("row", c["row"]), i, w, 1))
        net.arc(i, ("column", c["column"]), w, 0)
    net.send("source", "sink", sum(wanted))
    net_, taken = Flow(), []
    for (kind, name), units in _margins(cells, targets).items():
        ends = ("source", (kind, name)) if kind == "row" else ((kind, name), "sink")
        net_.arc(*ends, units, 0)
        net_.arc(*ends, total, 2)
    for c, t in zip(cells, targets, strict=True):
        a, b = ("row", c["row"]), ("column", c["column"])
        floor = min(c["floor"], c["available"])
        share = max(0, min(t, c["available"]) - floor)
        taken.append([net_.arc(a, b, floor, -1000), net_.arc(a, b, share, 0), net_.arc(a, b, c["available"] - floor - share, 5)])
    net_.send("source", "sink", total)
    return [sum(net_.used(k) for k in arcs) for arcs in taken], [net.used(k) for k in slack]


def _planned(spark: SparkSession, df: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The targets with available rows, quota and shortfall of each cell."""
    counted = df.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("available"))
    joined = targets.filter("dataset is not null and label is not null").join(counted, ["dataset", "label"], "left").na.fill(0, ["available"])
    found = joined.select("dataset", "label", "target_share", "min_rows", "sample_rows", "available").orderBy("dataset", "label").limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    cells = [{"row": r.dataset, "column": r.label, "share": r.target_share or 0.0, "floor": r.min_rows or 0, "available": r.available} for r in found]
    total = max((r.sample_rows or 0 for r in found), default=0)
    quota, short = quotas(cells, total, seed) if cells else ([], [])
    schema = T.StructType([*joined.select("dataset", "label", "target_share", "min_rows", "sample_rows").schema, *(T.StructField(n, T.LongType()) for n in ("available", "quota", "shortfall"))])
    rows = [(r.dataset, r.label, r.target_share, r.min_rows, r.sample_rows, r.available, q, s) for r, q, s in zip(found, quota, short, strict=True)]
    return spark.createDataFrame(rows, schema)


def proportional_sample(df: DataFrame, targets: DataFrame, id_col: str = "row_id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report): rows of ``df`` whose shares by dataset and label follow ``targets``.

    ``targets``: dataset, label, target_share, min_rows, sample_rows (the same on all rows). The report has a row per
    target with the rows available, the quota drawn, its share of the sample, and the rows that are missing to the
    target or the floor. Labels are taken as they stand; rows in no target cell, or with a null dataset or label, are
    not drawn. A cell with too few rows gives all it has, and others fill up the sample as far as they can. Ids may
    repeat or be null. Empty targets give an empty sample; an empty table gives a report of shortfalls.
    """
    spark = df.sparkSession
    plan = _planned(spark, df, targets, seed)
    order = [F.col(c) for c in (id_col, "dataset", "label")]
    sample = draw(df, ["dataset", "label"], plan.select("dataset", "label", "quota"), order, seed)
    drawn = F.sum("quota").over(Window.partitionBy())
    return sample, plan.withColumn("reached_share", F.col("quota") / F.nullif(drawn, F.lit(0)))


def _each(spark: SparkSession, sf_dir: str):
    wanted = table(spark, sf_dir, "label_targets")
    for name in ("synthetic_data", "test"):
        yield name, table(spark, sf_dir, name, "row_id", "dataset", "label"), wanted.filter(F.col("table_name") == name)


def p4_found(spark, sf_dir):
    """Target cells that the slack arcs show as short."""
    parts = [_planned(spark, df, targets, SEED).filter("shortfall > 0").select(F.lit(name).alias("table_name"), "dataset", "label") for name, df, targets in _each(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_sample(spark, sf_dir):
    parts = [proportional_sample(df, targets)[0].select(F.lit(name).alias("table_name"), "row_id", "dataset", "label") for name, df, targets in _each(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_shares(spark, sf_dir):
    parts = [proportional_sample(df, targets)[1].withColumn("table_name", F.lit(name)) for name, df, targets in _each(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


P4_FOUND_SQL = """
WITH counted AS (
  SELECT 'synthetic_data' AS table_name, dataset, label, count(*) AS n FROM synthetic_data GROUP BY ALL
  UNION ALL SELECT 'test', dataset, label, count(*) FROM test GROUP BY ALL)
SELECT t.table_name, t.dataset, t.label
FROM label_targets t LEFT JOIN counted c
  ON c.table_name = t.table_name AND c.dataset = t.dataset AND c.label = t.label
WHERE coalesce(c.n, 0) < t.target_share * t.sample_rows OR coalesce(c.n, 0) < t.min_rows
"""
