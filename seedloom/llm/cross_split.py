"""Records that evaluation splits share with the training split (problem 3): a scan with bitmaps and an exact check.

The bitmap of a text has one bit for each of the parts that a hash splits the 3-grams into, set if the text has a gram of the
part. A part that only one of two texts has holds a 3-gram that the other hasn't, so the Hamming distance of two bitmaps is
at most the number of such grams. A pair of similarity t has at most (1 - t) / (1 + t) * (n + m) of those, so bitmaps
further apart than that rule a pair out without loss; all others are compared exactly. Bitmaps grow with their text, so
that those of long texts aren't full; one of twice the parts is folded onto the other's. Every training text meets the
bitmaps of all evaluation texts of a possible size, so the cost grows with training times evaluation texts. Where in the texts
the shared 3-grams stand doesn't matter, so words in another order and scattered edits of single characters are found
as copies are.

Verbatim passages can't select the pairs: words swapped in pairs leave no passage of 16 characters whole at a
similarity of 0.75. Passages of 3 characters can without loss, but 48,000 evaluation texts gave each training text
35,000 places to look at, more work than all bitmaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, gram_codes, jaccard, normalise, table
from .fingerprint import hashed_grams

#: 3-grams of the texts of one shard: bounds a worker's memory to about 200 MB.
SHARD_PASSAGES = 10_000_000
#: Training and evaluation texts whose bitmaps are compared together: their distances stay in a core's cache.
ROWS, COLUMNS = 32, 4096
#: Bits of the shortest bitmap, and bits a gram of the longer ones, at least.
LEAST, PER_GRAM = 512, 1.25
#: Share of a bitmap that all pairs are compared by; the rest is for those that it leaves.
LEAD = 5 / 8
#: Words whose distances fit the 16 bits that they are summed in.
MOST_WORDS = 1000
#: Allowance for rounding in bounds.
EPS = 1e-6
#: Characters of a verbatim passage, in a text of at least twelve of them; a shorter text is cut into sixteen, of at
#: least three characters.
PASSAGE, LONG, PASSAGES, SHORTEST = 16, 12, 16, 3


def passages(text: str) -> list[tuple[int, str]]:
    """(start, passage) of a normalised text, in which a space is put first, contiguous from its start to its end.

    With ``coverage`` this tells how much of a text another one holds verbatim; it selects no pairs.
    """
    text = f" {text}"
    width = PASSAGE if len(text) > LONG * PASSAGE else max(SHORTEST, len(text) // PASSAGES)
    return [(at, text[at : at + width]) for at in range(0, len(text), width)]


def coverage(parts: list[tuple[int, str]], scanned: str) -> float:
    """Share of the passages' characters whose matched intervals in ``scanned``, overlaps merged, cover them."""
    covered = total = end = 0
    for start, part in parts:
        total += len(part)
        if part in scanned:
            covered += start + len(part) - max(start, end)
            end = start + len(part)
    return covered / total


def _doublings(sizes: np.ndarray) -> np.ndarray:
    """How often the shortest bitmap is doubled for texts of so many grams."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) * PER_GRAM / LEAST))).astype(np.int64)


def bitmap(codes: np.ndarray) -> bytes:
    """The bitmap of a non-empty set of grams."""
    width = LEAST << int(_doublings(np.array([len(codes)]))[0])
    flags = np.zeros(width, np.uint8)
    flags[(hashed_grams(codes) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, norm, bits) per distinct text with at least one 3-gram: its smallest id, its number of 3-grams, the text
    normalised, and its bitmap, which bounds distances from below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalise(t) for t in batch.column(1).to_pylist()]
            sizes, bits = [], []
            for norm in norms:
                codes = gram_codes(norm)
                sizes.append(len(codes))
                bits.append(bitmap(codes) if len(codes) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(norms, pa.string()), pa.array(bits, pa.binary())], ["id", "n", "norm", "bits"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and length(text) >= 3")
    one = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("copy")).agg(F.min("id").alias("id"), F.first("text").alias("text"))
    return one.select("id", "text").mapInArrow(run, "id bigint, n int, norm string, bits binary").filter("n > 0")


class _Bitmaps:
    """The bitmaps of texts in the order of their sizes, at every width up to their own."""

    def __init__(self, sizes: np.ndarray, values: list[bytes]) -> None:
        self.doublings = _doublings(sizes)
        self.first, self.words = {}, {}
        wider = np.empty((0, 0), np.uint64)
        for c in range(int(self.doublings.max(initial=0)), -1, -1):
            low, high = np.searchsorted(self.doublings, (c, c + 1))
            own = np.frombuffer(b"".join(values[low:high]), np.uint64).reshape(-1, (LEAST << c) // 64)
            folded = np.bitwise_or(*np.split(wider, 2, axis=1)) if len(wider) else own[:0]
            wider = np.concatenate([own, folded])
            self.first[c], self.words[c] = int(low), np.ascontiguousarray(wider.T)

    def block(self, c: int, start: int, end: int) -> np.ndarray:
        """(words, texts) of neighbouring texts that have ``c`` doublings or more, folded to ``c``."""
        return self.words[c][:, start - self.first[c] : end - self.first[c]]


def _bits(rows: pa.Table) -> _Bitmaps:
    """Of rows in the order of n."""
    return _Bitmaps(rows["n"].to_numpy().astype(np.int64), rows["bits"].to_pylist())


class _Shard:
    """The evaluation records of one shard, by size."""

    def __init__(self, path: str, threshold: float) -> None:
        import pyarrow.fs
        import pyarrow.parquet as pq

        system, place = pyarrow.fs.FileSystem.from_uri(path)
        rows = pq.read_table(place, filesystem=system).sort_by("n")
        self.share = (1 - threshold) / (1 + threshold)
        self.threshold = threshold
        self.ids, self.texts = rows["id"].to_numpy(), rows["norm"].to_pylist()
        self.sizes, self.bits = rows["n"].to_numpy().astype(np.int64), _bits(rows)
        self.codes: dict[int, np.ndarray] = {}

    def candidates(self, sizes: np.ndarray, bits: _Bitmaps) -> Iterator[tuple[int, np.ndarray]]:
        """Per text position the positions of all records that may reach the threshold; ``sizes`` ascend."""
        xor, count, sums = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8), np.empty((ROWS, COLUMNS), np.uint16)
        for top in range(0, len(sizes), ROWS):
            mine = sizes[top : top + ROWS]
            first = int(np.searchsorted(self.sizes, self.threshold * mine[0] - EPS))
            last = int(np.searchsorted(self.sizes, mine[-1] / self.threshold + EPS, side="right"))
            found: list[list[np.ndarray]] = [[] for _ in mine]
            for at in range(first, last, COLUMNS):
                end = min(at + COLUMNS, last)
                c = int(min(bits.doublings[top], self.bits.doublings[at]))
                own, other = bits.block(c, top, top + len(mine)), self.bits.block(c, at, end)
                place = np.s_[: len(mine), : end - at]
                apart = sums[place]
                apart.fill(0)
                for x, y in zip(own[: min(int(LEAD * len(own)), MOST_WORDS)], other, strict=False):
                    np.bitwise_xor(x[:, None], y, out=xor[place])
                    np.bitwise_count(xor[place], out=count[place])
                    np.add(apart, count[place], out=apart)
                # the bound of the largest texts first, then that of each pair, then by whole bitmaps
                text, record = np.divmod(np.flatnonzero(apart <= int(self.share * (mine[-1] + self.sizes[end - 1]) + EPS)), end - at)
                most = self.share * (mine[text] + self.sizes[at + record]) + EPS
                near = apart[text, record] <= most
                text, record, most = text[near], record[near], most[near]
                near = np.bitwise_count(own[:, text] ^ other[:, record]).sum(axis=0, dtype=np.int64) <= most
                text, record = text[near], record[near] + at
                for i in np.unique(text):
                    found[i].append(record[text == i])
            for i, parts in enumerate(found):
                if parts:
                    yield top + i, np.concatenate(parts)

    def codes_of(self, record: int) -> np.ndarray:
        if record not in self.codes:
            if len(self.codes) > 20_000:
                self.codes.clear()
            self.codes[record] = gram_codes(self.texts[record])
        return self.codes[record]


def _pairs(left: list[int], right: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["train_id", "eval_id"])


def _scan(shards: list[tuple[str, int, int]], threshold: float):
    def matched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("n")
        sizes, bits = rows["n"].to_numpy().astype(np.int64), _bits(rows)
        ids, texts = rows["id"].to_numpy(), rows["norm"]
        for path, low, high in shards:
            if not np.any((sizes >= threshold * low - EPS) & (sizes * threshold <= high + EPS)):
                continue
            shard = _Shard(path, threshold)
            left: list[int] = []
            right: list[int] = []
            for text, records in shard.candidates(sizes, bits):
                codes = gram_codes(texts[text].as_py())
                same = [int(shard.ids[r]) for r in records.tolist() if jaccard(codes, shard.codes_of(r)) >= threshold]
                left += [int(ids[text])] * len(same)
                right += same
                if len(left) > 100_000:
                    yield _pairs(left, right)
                    left, right = [], []
            yield _pairs(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 64 << 20:
                yield from matched(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from matched(pa.Table.from_batches(held))

    return run


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.70) -> DataFrame:
    """All pairs (train_id, eval_id) of a training and an evaluation record of 3-gram similarity ``threshold`` or more.

    ``evaluation`` holds all evaluation splits, with ids that are unique over them. Both sides are scanned once per
    distinct text and in ranges of their number of 3-grams, so a training text meets only the records of a possible
    size; each task reads the shards it needs from the shared folder. Null texts and texts under three
    characters pair with nothing; further columns are ignored; either side empty gives an empty result.
    """
    spark = train.sparkSession
    work = Workspace(spark, "cross-split")
    scanned = work.keep(_prepared(train, id_col, text_col), "train")
    cut = work.keep(_prepared(evaluation, id_col, text_col), "evaluation")
    total = cut.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(total / SHARD_PASSAGES))
    written = work.keep(cut.repartitionByRange(count, "n", "id"), "shards")
    sizes = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    shards = [(r.path, r.low, r.high) for r in sizes.orderBy("low", "path").collect()]  # one row per shard
    # ranges of the size keep the shards of a task few; two tasks a core even out their different costs
    spread = scanned.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "n", "id")
    pairs = work.keep(spread.mapInArrow(_scan(shards, threshold), "train_id bigint, eval_id bigint"), "pairs")
    return _expanded(pairs, train, evaluation, id_col, text_col)


def _expanded(pairs: DataFrame, train: DataFrame, evaluation: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of distinct texts become pairs of records."""
    copy = F.md5(F.col(text_col).cast("binary")).alias("copy")
    for side, df in (("train_id", train), ("eval_id", evaluation)):
        members = df.select(F.col(id_col).cast("bigint").alias("member"), copy).filter("member is not null and copy is not null")
        least = members.groupBy("copy").agg(F.min("member").alias(side))
        pairs = pairs.join(members.join(least, "copy").select(side, "member"), side).drop(side).withColumnRenamed("member", side)
    return pairs.select("train_id", "eval_id").distinct()


def _splits(spark, sf_dir):
    both = [table(spark, sf_dir, s, "row_id", "text", "source").withColumn("eval_split", F.lit(s)) for s in ("valid", "test")]
    return table(spark, sf_dir, "train", "row_id", "text"), both[0].unionByName(both[1])


def p3_found(spark, sf_dir):
    train, evaluation = _splits(spark, sf_dir)
    pairs = cross_split_overlaps(train, evaluation)
    split = evaluation.select(F.col("row_id").alias("eval_id"), "eval_split")
    return pairs.join(split, "eval_id").select(F.col("train_id").alias("train_row_id"), F.col("eval_id").alias("eval_row_id"), "eval_split")


def p3_overlap_report(spark, sf_dir):
    """Per evaluation split and source: records, records with an overlap, and overlapping pairs."""
    train, evaluation = _splits(spark, sf_dir)
    per = cross_split_overlaps(train, evaluation).groupBy(F.col("eval_id").alias("row_id")).agg(F.count(F.lit(1)).alias("k"))
    counts = [F.count(F.lit(1)).alias("records"), F.count("k").alias("overlapping_records"), F.coalesce(F.sum("k"), F.lit(0)).alias("pairs")]
    return evaluation.join(per, "row_id", "left").groupBy("eval_split", "source").agg(*counts)
