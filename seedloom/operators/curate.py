"""Exact and near-duplicate gates with deterministic greedy acceptance.

Accepting items in order of arrival, unless they are too similar to one accepted before, gives the lexicographically
first maximal independent set of the similarity graph. ``greedy_accept`` finds it in rounds over the edges.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t


def ensure_checkpoint(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names. Where it names none, a local session gets a temporary one; on a
    cluster that would be one machine's, so it is an error."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix=f"seedloom-{uuid.uuid4().hex[:6]}-"))


def first_by_key(rows: DataFrame, by: list[str], order: str, key: Column) -> DataFrame:
    """The first row of every exact key within its group. An aggregation, so a hot key is combined before the shuffle."""
    keyed = rows.withColumn("_key", F.md5(key.cast("binary")))
    best = keyed.groupBy(*by, "_key").agg(F.min(order).alias(order))
    return keyed.join(best, [*by, "_key", order], "left_semi").drop("_key")


def greedy_accept(items: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Ids accepted when items arrive in order of ``key`` and an item is refused if an accepted one is its neighbour.

    ``edges``: (a, b) with a before b. Each round accepts the items none of whose earlier neighbours is open, refuses the
    neighbours of those, and goes on with the edges among open items; items without edges are accepted outright.
    """
    spark = items.sparkSession
    ensure_checkpoint(spark)
    open_edges = edges.select("a", "b").distinct().checkpoint()
    refused = None
    while not open_edges.isEmpty():
        later = open_edges.select(F.col("b").alias("a")).distinct()
        free = open_edges.select("a").distinct().join(later, "a", "left_anti")
        hit = open_edges.join(free, "a", "left_semi").select("b").distinct().checkpoint()
        refused = hit if refused is None else refused.union(hit)
        gone = hit.select(F.col("b").alias("x")).union(free.select(F.col("a").alias("x")))
        open_edges = open_edges.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti").checkpoint()
    if refused is None:
        return items.select(key)
    return items.select(key).join(refused.withColumnRenamed("b", key), key, "left_anti")


def _room(threshold: float) -> float:
    """Tokens that two sequences of lengths m and n may differ in, as a share of m + n: F1 is 2 LCS / (m + n)."""
    return 1 - threshold


def rouge_edges(items: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., a, b, f1) of all pairs of items (by.., id, tokens) with ROUGE-L F1 of ``threshold`` or more, a < b.

    Items with the same tokens count as one, of the smallest id. Candidates meet by parts of their tokens from a threshold of
    ``BY_PARTS`` on, else by segments; neither loses a pair, and survivors are verified.
    """
    texts = items.filter("size(tokens) > 0").select(*by, "id", F.concat_ws("\x1f", "tokens").alias("text"))
    firsts = texts.groupBy(*by, "text").agg(F.min("id").alias("id"))
    split = F.split("text", "\x1f")
    tokenised = firsts.select(*by, "id", split.alias("tokens"))
    pairs = (_by_parts if threshold >= BY_PARTS else _by_segments)(tokenised, by, threshold)
    sides = [firsts.select(F.col("id").alias(x), split.alias(f"t{x}")) for x in "ab"]
    scored = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("f1", sim.rouge_l(F.col("ta"), F.col("tb"))).filter(F.col("f1") >= threshold)
    return scored.select(*by, "a", "b", "f1")


#: Threshold from which the parts of a text are long enough to be rare: about 1 / (2 - 2 * threshold) tokens, ten at 0.95.
BY_PARTS = 0.9
#: Texts whose parts one task holds at a time.
BATCH = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _part_counts(n: int, threshold: float) -> list[int]:
    """Numbers of parts, one more than tokens may be unmatched, for partners of all possible lengths of a text of ``n`` tokens."""
    shortest, longest = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
    least, most = (math.floor(_room(threshold) * (n + m) + 1e-9) for m in (shortest, longest))
    return list(range(least + 1, most + 2))


def _part_keys(tokens: pa.ListArray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, bits): the keys of the parts of each row's tokens; bits, by row, is the parity of its tokens in 64 classes."""
    words = tokens.flatten().dictionary_encode()
    codes = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words.dictionary.to_pylist()), dtype=np.uint64)
    hashes = codes[words.indices.to_numpy(zero_copy_only=False)]
    sizes = np.diff(tokens.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts)
    counts = {n: _part_counts(n, threshold) for n in set(sizes.tolist())}
    each = [counts[n] for n in sizes.tolist()]
    rows = np.repeat(np.arange(len(each)), list(map(len, each)))
    parts = np.array([k for ks in each for k in ks], dtype=np.int64)
    # every token once for each number of parts of its row; its part follows from the token alone
    lengths = sizes[rows]
    ends = np.cumsum(lengths)
    own = hashes[np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - lengths), lengths)]
    base = np.cumsum(parts) - parts
    part = np.repeat(base, lengths) + ((own >> np.uint64(8)) % np.repeat(parts, lengths).astype(np.uint64)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, own = part[order], own[order]
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rank = np.arange(len(part)) - np.repeat(heads, np.diff(np.r_[heads, len(part)]))
    powers = np.cumprod(np.full(rank.max() + 1, _ODD))
    keys = np.zeros(int(parts.sum()), dtype=np.uint64)  # a part without tokens is one too
    keys[part[heads]] = np.add.reduceat((own ^ own >> np.uint64(29)) * powers[rank], heads)
    number = np.arange(len(keys)) - np.repeat(base, parts)
    keys = (keys ^ keys >> np.uint64(32)) * _ODD + (np.repeat(parts, parts) * 65_537 + number).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.repeat(rows, parts), keys.view(np.int64), bits.view(np.int64)


def _by_parts(firsts: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., a, b): candidates among texts (by.., id, tokens) of different tokens.

    At most d = (1 - t)(m + n) tokens of two sequences are outside their common subsequence. Deal all tokens there are to
    d + 1 parts: in one part nothing is outside, so both texts have the same tokens there in the same order. Texts are
    joined on their parts for every d that a possible partner leads to. Each token outside changes the parity of one of 64
    classes, so pairs with more than d different parities are left out before they are written.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows, keys, bits = _part_keys(batch.column("tokens"), threshold)
                kept = batch.select([*by, "id"]).take(pa.array(rows))
                sizes = np.diff(batch.column("tokens").offsets.to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes[rows]), pa.array(bits[rows]), pa.array(keys)], [*by, "id", "n", "bits", "key"])

    kinds = [f"`{c}` {firsts.schema[c].dataType.simpleString()}" for c in (*by, "id")]
    keyed = firsts.mapInArrow(cut, ", ".join([*kinds, "n int, bits bigint, key bigint"]))
    other = keyed.select(*by, "key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bits_b"))
    most = F.floor(F.lit(_room(threshold)) * (F.col("n") + F.col("m")) + F.lit(1e-9))
    near = (F.abs(F.col("n") - F.col("m")) <= most) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b"))) <= most)
    met = keyed.withColumnRenamed("id", "a").join(other, [*by, "key"]).filter((F.col("a") < F.col("b")) & near)
    return met.select(*by, "a", "b").distinct()


def _by_segments(firsts: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., a, b): candidates among texts (by.., id, tokens) of different tokens.

    At most d = (1 - t)(m + n) tokens of two sequences are outside their common subsequence. Cut the shorter one, or of
    equal ones the earlier, into d + 1 segments: one stays whole, and stands in the other, shifted by as many places as edits before it allow. So items
    are joined on (length, segment number, segment) with the windows of possible places.
    """
    firsts = firsts.withColumn("n", F.size("tokens"))
    t_ = threshold
    most = F.floor(F.lit(_room(t_)) * (F.col("n") + F.col("m")) + F.lit(1e-9)).cast("int")
    longest = F.floor(F.col("n") * F.lit((2 - t_) / t_) + F.lit(1e-9)).cast("int")

    def bounds(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
        """Start, from 0, and size of segment ``i`` of ``parts`` nearly equal ones."""
        short, rest = F.floor(length / parts), length % parts
        start = i * short + F.greatest(F.lit(0), i - (parts - rest))
        return start.cast("int"), (short + (i >= parts - rest).cast("int")).cast("int")

    # of each possible partner length m >= n, the segments of the shorter item
    own = firsts.select(*by, "id", "n", "tokens", F.explode(F.sequence("n", longest)).alias("m")).withColumn("d", most)
    own = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = bounds(F.col("n"), F.col("d") + 1, F.col("i"))
    own = own.select(*by, "id", "n", "m", "i", F.md5(F.concat_ws("\x1f", F.slice("tokens", start + 1, F.greatest(size, F.lit(0)))).cast("binary")).alias("seg"))
    # of each possible partner length n <= m, the windows of the longer item where a segment may stand
    shortest = F.ceil(F.col("m") * F.lit(t_ / (2 - t_)) - F.lit(1e-9)).cast("int")
    probe = firsts.select(*by, F.col("id").alias("other"), F.col("n").alias("m"), "tokens").withColumn("n", F.explode(F.sequence(shortest, F.col("m")))).filter("n > 0")
    probe = probe.withColumn("d", most).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = bounds(F.col("n"), F.col("d") + 1, F.col("i"))
    probe = probe.withColumn("start", start).withColumn("size", size)
    # of d edits, with m - n more insertions than deletions, deletions shift a segment to the left, insertions to the right
    back, ahead = F.floor((F.col("d") - F.col("m") + F.col("n")) / 2), F.floor((F.col("d") + F.col("m") - F.col("n")) / 2)
    low, high = F.greatest(F.lit(0), F.col("start") - back), F.least(F.col("m") - F.col("size"), F.col("start") + ahead)
    places = F.when(high >= low, F.sequence(low.cast("int"), F.greatest(low, high).cast("int")))
    probe = probe.withColumn("at", F.explode(places)).select(
        *by, "other", "n", "m", "i", F.md5(F.concat_ws("\x1f", F.slice("tokens", F.col("at") + 1, F.col("size"))).cast("binary")).alias("seg")
    )
    met = own.join(probe, [*by, "n", "m", "i", "seg"]).filter("id <> other and (n < m or id < other)")
    return met.select(*by, F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_duplicate_accept(items: DataFrame, by: list[str], threshold: float = 0.95) -> DataFrame:
    """Ids accepted in order of id when items too similar to an accepted one of their group are refused.

    ``items``: (by.., id, text). Of equal token sequences only the first can be accepted, so the graph is built on
    those; items without tokens are never accepted.
    """
    tokenised = items.select(*by, "id", t.tokens(F.col("text")).alias("tokens")).filter("size(tokens) > 0")
    firsts = first_by_key(tokenised, by, "id", F.concat_ws("\x1f", "tokens"))
    ensure_checkpoint(items.sparkSession)
    firsts = firsts.checkpoint()
    return greedy_accept(firsts, rouge_edges(firsts, by, threshold))


def best_reference(items: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """(by.., id, best) greatest ROUGE-L F1 of each item over the references of its group; 0 without references.

    ``references`` (by.., ref) are few per group: a seed pool. Whether an item is like one of many texts is for
    ``like_known``, which doesn't pair all of them.
    """
    few = references.groupBy(*by).agg(F.collect_set(t.tokens(F.col("ref"))).alias("refs"))
    paired = items.join(few, by, "left").select(*by, "id", t.tokens(F.col("text")).alias("tokens"), F.explode_outer("refs").alias("ref"))
    return paired.groupBy(*by, "id").agg(F.coalesce(F.max(sim.rouge_l(F.col("tokens"), F.col("ref"))), F.lit(0.0)).alias("best"))


def like_reference(items: DataFrame, references: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., id) of items (by.., id, text) with ROUGE-L F1 of ``threshold`` or more to one of the references of its group.

    ``references`` as in ``best_reference``. Only those are scored that the lengths and the tokens missing on either side allow.
    """
    few = references.groupBy(*by).agg(F.collect_set(t.tokens(F.col("ref"))).alias("refs"))
    paired = items.select(*by, "id", t.tokens(F.col("text")).alias("tokens")).join(F.broadcast(few), by)  # few per group, few groups

    def possible(ref: Column) -> Column:
        most = F.floor(F.lit(_room(threshold)) * (F.size("tokens") + F.size(ref)) + F.lit(1e-9))
        missing = F.size(F.array_except("tokens", ref)) + F.size(F.array_except(ref, F.col("tokens")))
        return F.when(F.abs(F.size("tokens") - F.size(ref)) <= most, missing <= most).otherwise(F.lit(False))

    open_ = paired.select(*by, "id", "tokens", F.explode(F.filter("refs", possible)).alias("ref"))
    return open_.filter(sim.rouge_l(F.col("tokens"), F.col("ref")) >= threshold).select(*by, "id").distinct()


def like_known(items: DataFrame, known: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., id) of items (by.., id, text) with ROUGE-L F1 of ``threshold`` or more to a known text (by.., ref).

    Both are put into one table whose edges are found by segments, so only texts that share a stretch meet.
    """
    mine = items.select(*by, F.concat(F.lit("1:"), F.col("id").cast("string")).alias("id"), t.tokens(F.col("text")).alias("tokens"))
    theirs = known.select(*by, t.tokens(F.col("ref")).alias("tokens")).distinct()
    theirs = theirs.select(*by, F.concat(F.lit("0:"), F.md5(F.concat_ws("\x1f", "tokens").cast("binary"))).alias("id"), "tokens")
    key = F.md5(F.concat_ws("\x1f", "tokens").cast("binary"))
    # items of equal tokens share their edges: one stands for all, a known text before an item
    both = mine.unionByName(theirs).filter("size(tokens) > 0").withColumn("same", key)
    firsts = both.groupBy(*by, "same").agg(F.min("id").alias("first"))
    placed = both.join(firsts, [*by, "same"])
    equal = placed.filter("first like '0:%'").select(*by, "id")
    edges = rouge_edges(both.select(*by, "id", "tokens"), by, threshold).filter("a like '0:%'").select(*by, F.col("b").alias("first"))
    near = placed.join(edges.distinct(), [*by, "first"], "left_semi").select(*by, "id")
    hit = equal.union(near).filter("id like '1:%'").distinct().withColumn("id", F.substring("id", 3, 1 << 20))
    named = items.select(*by, "id", F.col("id").cast("string").alias("_id"))
    return named.join(hit.withColumnRenamed("id", "_id"), [*by, "_id"], "left_semi").select(*by, "id")


def first_failing(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition, of refusal, holds; null if none does."""
    reason = F.lit(None).cast("string")
    for name, refused in reversed(gates):
        reason = F.when(F.coalesce(refused, F.lit(False)), name).otherwise(reason)
    return reason
