"""MinHash fingerprints of 3-gram sets, blocks of them, and the candidate pairs that share a block.

A fingerprint has ``BLOCKS * ROWS`` MinHash components. ``ROWS`` neighbouring components form a block, and one bit of
each component forms the bit string whose Hamming distance stands for dissimilarity. Two sets of similarity s agree in
a component with probability s, so they share a block with probability 1 - (1 - s**ROWS)**BLOCKS: 0.981 at s = 0.70,
0.998 at 0.75, above 0.9999 at 0.80. (If they differ in fewer components than there are blocks, the pigeonhole
principle makes a shared block certain.) The Hamming bound keeps a pair of s = 0.70 with more than four standard
deviations to spare, about 0.9999.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace, gram_codes, jaccard

BLOCKS = 32
ROWS = 6
#: Largest Hamming distance of a candidate: mean 28.8 and deviation 4.9 at similarity 0.70.
MAX_HAMMING = 50
#: A block of at most so many classes is joined with itself; a larger one takes the leader path, which is as exact.
DIRECT_BLOCK = 256
#: Classes of a large block that one task handles together, on average.
SLICE = 4096
#: A list of shared blocks up to this length is broadcast, 16 bytes each.
SHORT_LIST = 1_000_000
#: Edges that one task joins to components, at most; more take distributed rounds, with the same outcome.
ONE_TASK = 200_000
#: Gram sets that a task keeps while it checks pairs.
HELD = 2_000

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**32, BLOCKS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BLOCKS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = (_RNG.integers(1, 2**63, (BLOCKS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SEED = _RNG.integers(1, 2**63, BLOCKS, dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hamming(words: list[str], left: str, right: str) -> Column:
    distance = F.lit(0)
    for word in words:
        distance = distance + F.bit_count(F.col(f"{left}.{word}").bitwiseXOR(F.col(f"{right}.{word}")))
    return distance


@dataclass(frozen=True)
class Summary:
    """A few 64-bit words per gram set, and what two of them say about the similarity of the sets."""

    words: int
    #: (hashed grams, least hash of each component) -> words
    compute: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: (Hamming distance of the words, size, other size, threshold) -> may the similarity reach the threshold?
    allows: Callable[[Column, Column, Column, float], Column]

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]

    def near(self, left: str, right: str, threshold: float) -> Column:
        """What every pair of the wanted similarity fulfils: the sizes allow it and so do the words."""
        a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
        distance = hamming(self.columns, left, right)
        return (a >= F.lit(threshold) * b) & (b >= F.lit(threshold) * a) & self.allows(distance, a, b, threshold)


def _component_bits(hashed: np.ndarray, least: np.ndarray) -> np.ndarray:
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31), bitorder="little").view(np.int64)


FINGERPRINT = Summary(BLOCKS * ROWS // 64, _component_bits, lambda distance, a, b, threshold: distance <= MAX_HAMMING)


def hashed_grams(codes: np.ndarray) -> np.ndarray:
    return _scramble(codes.view(np.uint64) * _GOLD)


def components_and_keys(hashed: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(identity of the set, least hash of each component, block keys) of a non-empty set of hashed grams."""
    identity = _scramble(hashed + np.uint64(len(hashed))).sum(dtype=np.uint64)
    low = (hashed >> np.uint64(32)).astype(np.uint32)
    least = (low[:, None] * _MUL + _ADD).min(axis=0)
    keys = _scramble((least.reshape(BLOCKS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _SEED)
    return int(identity.view(np.int64)), least, keys.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, carry: dict[str, str] | None = None, summary: Summary = FINGERPRINT) -> DataFrame:
    """One row per text with at least one 3-gram: id, carried columns, gram count ``n``, set identity ``same``,
    summary words ``f0..`` and block ``keys``. Texts that are null or shorter than three characters are similar to
    nothing."""
    carry = carry or {}
    words = summary.columns
    schema = ", ".join(
        ["id bigint", *(f"`{k}` {v}" for k, v in carry.items()), "n int", "same bigint", *(f"{w} bigint" for w in words), "keys array<bigint>"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, bits, keys, at = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = gram_codes(text)
                if len(codes):
                    hashed = hashed_grams(codes)
                    s, least, k = components_and_keys(hashed)
                    at.append(i)
                    n.append(len(codes))
                    same.append(s)
                    bits.append(summary.compute(hashed, least))
                    keys.append(k)
            if not at:
                continue
            take = pa.array(at)
            columns = [batch.column(0).take(take), *(batch.column(2 + j).take(take) for j in range(len(carry)))]
            stacked = np.stack(bits)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * BLOCKS)
            columns += [pa.array(n, pa.int32()), pa.array(same, pa.int64()), *(pa.array(stacked[:, w]) for w in range(len(words)))]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys))))
            yield pa.RecordBatch.from_arrays(columns, ["id", *carry, "n", "same", *words, "keys"])

    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *(F.col(k).cast(v).alias(k) for k, v in carry.items()))
    return chosen.filter(F.col("id").isNotNull()).mapInArrow(run, schema)


@dataclass
class Blocks:
    """Classes by block: ``small`` has the blocks of up to ``DIRECT_BLOCK`` classes, ``large`` the others with their size ``m``."""

    small: DataFrame
    large: DataFrame
    any_large: bool


def blocks(work: Workspace, classes: DataFrame) -> Blocks:
    """One row per class and block that it shares with another. Blocks are counted first, which combines a hot block's
    rows before the shuffle, so that no task ever gathers a large block, and leaves out the blocks of one class, which
    are most. The list of the others is broadcast if it is short; else ids and keys are joined with it, and the classes
    with what is left."""
    fields = [F.col(c) for c in classes.columns if c != "keys"]
    counts = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    shared = work.keep(counts.filter("m > 1"), "shared-blocks")
    known, large = shared.agg(F.count(F.lit(1)), F.max("m")).first()
    if known <= SHORT_LIST:
        rows = classes.select(F.explode("keys").alias("key"), *fields).join(F.broadcast(shared), "key")
    else:
        rows = classes.select(F.explode("keys").alias("key"), "id").join(shared, "key").join(classes.drop("keys"), "id")
    rows = rows.select("key", "m", *fields)
    parts = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Blocks(rows.filter(F.col("m") <= DIRECT_BLOCK).drop("m").repartition(parts, "key"), rows.filter(F.col("m") > DIRECT_BLOCK), (large or 0) > DIRECT_BLOCK)


def slices() -> Column:
    """Number of slices that a large block is cut into."""
    return F.ceil(F.col("m") / SLICE).cast("int")


def slice_of() -> Column:
    return F.pmod(F.xxhash64("id"), slices()).cast("int")


def direct_pairs(blocked: Blocks, threshold: float, also: Callable[[str, str], Column], summary: Summary = FINGERPRINT) -> DataFrame:
    """Distinct candidate pairs (a, b, Hamming distance) of the small blocks; both sides of the join share one shuffle."""
    small = blocked.small
    joined = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & also("a", "b") & summary.near("a", "b", threshold))
    return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming(summary.columns, "a", "b").alias("apart")).distinct()


def leader_pairs(blocked: Blocks, threshold: float, order: list[str], summary: Summary = FINGERPRINT, also: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Candidate pairs (a, b, Hamming distance) of large blocks: each class with the block's first one, and with the one before it in its
    slice of the block."""
    fields = [c for c in blocked.large.columns if c not in ("key", "m")]
    ordered = [*order, *(c for c in fields if c not in order)]
    first = blocked.large.groupBy("key").agg(F.min(F.struct(*ordered)).alias("first"))
    by = Window.partitionBy("key", "slice").orderBy(*order)
    rows = blocked.large.withColumn("slice", slice_of()).withColumn("before", F.lag(F.struct(*ordered)).over(by)).join(first, "key")
    both = rows.select(F.explode(F.array("first", "before")).alias("a"), F.struct(*ordered).alias("b")).filter("a is not null")
    wanted = summary.near("a", "b", threshold) & (also("a", "b") if also else F.col("a.id") != F.col("b.id"))
    return both.filter(wanted).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming(summary.columns, "a", "b").alias("apart")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, others: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose exact 3-gram similarity reaches the threshold. ``texts``: (id, text) of the ids a and,
    without ``others``, b; ``others``: (b, tb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            found = codes.get(text)
            if found is None:
                if len(codes) > HELD:
                    codes.clear()
                found = codes[text] = gram_codes(text)
            return found

        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            kept = pa.array([i for i, (left, right) in enumerate(pairs) if jaccard(of(left), of(right)) >= threshold], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")) if others is None else others
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, least id connected with it) of at most ``ONE_TASK`` edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["id", "root"])


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (id, root), root being the smallest id; nodes without edge are absent.

    Alternating large-star and small-star steps; each step is an aggregation and a join, and the edge set is
    written to the shared folder after every round. Only two numbers per round reach the driver.
    """
    current = work.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    if current.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return work.keep(current.coalesce(1).mapInArrow(_united, "id bigint, root bigint"), "components")
    seen = None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select("u", "v", "m")
        step = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        after = work.keep(step, "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(current)
        current = after
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
