"""Cells of texts that share a block of their fingerprints: all members of a cell meet in one task, which prunes their pairs.

Every text is signed once: its pivot code (``pivot_codes``), and of each of its blocks a key of 32 bits. Keys only choose
what meets, so a clash costs a comparison and no result. ``rounds`` deals the members of a few blocks at a time to tasks
by key, with size and code beside the id, so a pair is formed, pruned by size and code and left out again within a task:
unlike texts share cells in numbers that grow with the square of the table, and none of those pairs is ever written. What a
round has shuffled is deleted before the next one starts (``tidy``), so disk holds the keys of a few blocks, not of all.
Members travel as one binary value a batch and task, column by column.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint
from .base import Workspace, gram_codes
from .fingerprint import _scramble, hashed_grams

PIVOTS = 96
CODE = 4
WORDS = PIVOTS * CODE // 64
#: Blocks that one round deals.
GROUP = 4
#: Bytes of the members that one task of a round takes, on average.
PART = 32 << 20
#: Grams that are signed together, which bounds a worker's memory.
SIGNED = 1_000_000
#: Members whose pairs are formed together.
CHUNK = 1 << 15
#: Pairs of a cell that are kept per member; a cell of more is a crowded one.
KEPT = 64
#: Keys of so many new texts select what older texts of an index are dealt.
FEW = 50_000
#: Allowance for rounding in bounds.
EPS = 1e-9

#: Row c: the code of a count with c as its remainder by 2 * CODE; codes of neighbouring counts differ in one bit.
_CYCLE = np.array([[(c > b) ^ (c > b + CODE) for b in range(CODE)] for c in range(2 * CODE)], dtype=np.uint8)
_MEMBER = 4 + 4 + 8 + 8 + 1 + 8 * WORDS


def direct() -> int:
    """Members of the largest cell of which all pairs are formed at once."""
    return 8 * fingerprint.DIRECT_BLOCK


def share(threshold: float) -> float:
    """The most that similar sets may be apart, as a share of both sizes."""
    return (1 - threshold) / (1 + threshold)


def pivot_codes(hashed: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, WORDS) words: per row the cyclic codes of its numbers of grams in each part."""
    counts = np.bincount(row * PIVOTS + (hashed % np.uint64(PIVOTS)).astype(np.int64), minlength=rows * PIVOTS)
    return np.packbits(_CYCLE[counts % (2 * CODE)].reshape(rows, -1), axis=1, bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Bands:
    """Hash functions of the components, and of the blocks that are made of ``mix.shape[1]`` neighbouring ones."""

    mul: np.ndarray
    add: np.ndarray
    mix: np.ndarray
    seed: np.ndarray

    @property
    def columns(self) -> list[str]:
        """Columns of keys, each of the blocks of one round."""
        return [f"k{i}" for i in range(len(self.seed) // GROUP)]

    def keys(self, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(rows, blocks) keys of the rows whose grams begin at ``starts``."""
        low = (hashed >> np.uint64(32)).astype(np.uint32)
        ends = np.append(starts[1:], len(low))
        held = np.empty((int((ends - starts).max()), len(self.mul)), np.uint32)
        keys = np.empty((len(starts), len(self.seed)), np.uint32)
        for i, (at, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            own = held[: end - at]
            np.multiply(low[at:end, None], self.mul, out=own)
            own += self.add
            least = own.min(axis=0).reshape(self.mix.shape).astype(np.uint64)
            keys[i] = _scramble((least * self.mix).sum(axis=1, dtype=np.uint64) + self.seed) >> np.uint64(32)
        return keys


FINGERPRINT_BANDS = Bands(fingerprint._MUL, fingerprint._ADD, fingerprint._MIX, fingerprint._SEED)


def signed(df: DataFrame, bands: Bands, carry: dict[str, str]) -> DataFrame:
    """Per row (id, text, carried columns) with at least one 3-gram: id, carried columns, number of grams ``n``, set identity
    ``same``, pivot ``code`` and the keys of its blocks."""
    schema = ", ".join(["id bigint", *(f"{k} {v}" for k, v in carry.items()), "n int", "same bigint", "code binary", *(f"{k} binary" for k in bands.columns)])

    def part(batch: pa.RecordBatch, at: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in codes])
        starts = np.cumsum(sizes) - sizes
        hashed = hashed_grams(np.concatenate(codes))
        row = np.repeat(np.arange(len(sizes)), sizes)
        same = np.add.reduceat(_scramble(hashed + sizes.astype(np.uint64)[row]), starts)
        keys = bands.keys(hashed, starts)
        take = pa.array(at)
        columns = [batch.column(0).take(take), *(batch.column(2 + j).take(take) for j in range(len(carry)))]
        columns += [pa.array(sizes, pa.int32()), pa.array(same.view(np.int64)), _binary(pivot_codes(hashed, row, len(sizes)))]
        columns += [_binary(np.ascontiguousarray(keys[:, i : i + GROUP])) for i in range(0, keys.shape[1], GROUP)]
        return pa.RecordBatch.from_arrays(columns, ["id", *carry, "n", "same", "code", *bands.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, grams = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = gram_codes(text)
                if len(own):
                    at.append(i)
                    codes.append(own)
                    grams += len(own)
                    if grams > SIGNED:
                        yield part(batch, at, codes)
                        at, codes, grams = [], [], 0
            if at:
                yield part(batch, at, codes)

    return df.select("id", "text", *carry).mapInArrow(run, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _rows_of(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, what a query has shuffled is deleted as soon as the query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _dealt(parts: int, only: np.ndarray | None, old_only: np.ndarray | None):
    """Members (id, batch, n, fresh, code, keys of a round) as one binary value per batch and task. ``only``: keys that
    matter, sorted; ``old_only``: flags by the upper 24 bits of the keys, of those that matter for members that aren't fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = _rows_of(batch.column(5), np.uint32)
            keys, row = each.ravel(), np.repeat(np.arange(batch.num_rows), each.shape[1])
            fresh = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
            wanted = np.ones(len(keys), bool)
            if only is not None:
                wanted = only[np.minimum(np.searchsorted(only, keys), len(only) - 1)] == keys
            if old_only is not None:
                wanted &= (fresh[row] == 1) | old_only[keys >> np.uint32(8)]
            keys, row = keys[wanted], row[wanted]
            part = ((keys.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, row, part = keys[order], row[order], part[order]
            columns = [keys, batch.column(2).to_numpy().astype(np.int32)[row], batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], fresh[row], _rows_of(batch.column(4), np.uint64)[row]]
            filled, first = np.unique(part, return_index=True)
            bounds = [*first.tolist(), len(part)]
            values = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(values, pa.binary())], ["part", "members"])

    return run


class _Members:
    """The members that a task was dealt, by key and size."""

    def __init__(self, values: list[bytes], threshold: float) -> None:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for value in values:
            m, at = len(value) // _MEMBER, 0
            for column, kind, width in zip(columns, ("<u4", "<i4", "<i8", "<i8", "u1", "<u8"), (1, 1, 1, 1, 1, WORDS), strict=True):
                column.append(np.frombuffer(value, kind, m * width, at))
                at += m * width * np.dtype(kind).itemsize
        key, n, ids, batch, fresh, code = (np.concatenate(c) for c in columns)
        order = np.lexsort((n, key))
        self.key, self.n, self.id, self.batch, self.fresh = (c[order] for c in (key, n.astype(np.int64), ids, batch, fresh.astype(bool)))
        self.code = code.reshape(-1, WORDS)[order]
        self.threshold, self.share = threshold, share(threshold)
        self.starts = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))
        self.sizes = np.diff(np.append(self.starts, len(self.key)))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.code[x] ^ self.code[y]).sum(axis=1, dtype=np.int32)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that may reach the threshold, with the distance of their codes."""
        n, m = self.n[a], self.n[b]
        fit = np.minimum(n, m) >= self.threshold * np.maximum(n, m) - EPS
        a, b = a[fit], b[fit]
        apart = self.apart(a, b)
        fit = apart <= self.share * (self.n[a] + self.n[b]) + EPS
        return a[fit], b[fit], apart[fit]

    def direct(self, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, distance) of the pairs in the marked cells of which b is fresh and a of a smaller batch."""
        inside = np.repeat(among, self.sizes)
        own = np.flatnonzero(inside & self.fresh)
        # pairs are met from their smaller member; where few are fresh, from the fresh ones in both directions
        both = 2 * len(own) < int(inside.sum())
        at_all = own if both else np.flatnonzero(inside)
        for top in range(0, len(at_all), CHUNK):
            for way in (1, -1) if both else (1,):
                x, step = at_all[top : top + CHUNK], 0
                while len(x):
                    step += way
                    y = x + step
                    x = x[(y >= 0) & (y < len(self.key))]
                    y = x + step
                    n, m = self.n[x], self.n[y]
                    fit = (self.key[x] == self.key[y]) & (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - EPS)
                    x, y = x[fit], y[fit]
                    later = self.batch[x] > self.batch[y]
                    a, b = np.where(later, y, x), np.where(later, x, y)
                    wanted = (self.batch[x] != self.batch[y]) & self.fresh[b]
                    if way < 0:
                        wanted &= ~self.fresh[y]
                    yield self.near(a[wanted], b[wanted])

    def pivot(self, cell: int) -> int:
        """The first member of a cell."""
        at = np.arange(self.starts[cell], self.starts[cell] + self.sizes[cell])
        return int(at[np.lexsort((self.id[at], self.batch[at]))[0]])

    def led(self, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a cell's pivot."""
        at, pivot = np.arange(self.starts[cell], self.starts[cell] + self.sizes[cell]), self.pivot(cell)
        b = at[self.fresh[at] & (self.batch[at] > self.batch[pivot])]
        return self.near(np.full(len(b), pivot), b)

    def ringed(self, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of a cell, by ranges of the distance to its pivot: similar ones can't differ more in it than they are apart."""
        at = np.arange(self.starts[cell], self.starts[cell] + self.sizes[cell])
        far = self.apart(at, np.full(len(at), self.pivot(cell)))
        order = np.argsort(far, kind="stable")
        at, far = at[order], far[order]
        own = np.flatnonzero(self.fresh[at])
        most = self.share * (1 + 1 / self.threshold) * self.n[at[own]] + EPS
        low, high = np.searchsorted(far, far[own] - most), np.searchsorted(far, far[own] + most, side="right")
        for x, first, last in zip(at[own].tolist(), low.tolist(), high.tolist(), strict=True):
            a = at[first:last]
            a = a[self.batch[a] < self.batch[x]]
            yield self.near(a, np.full(len(a), x))


def _table(members: _Members, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(members.id[a]), pa.array(members.id[b]), pa.array(apart.astype(np.int32)), pa.nulls(len(a), pa.int64())], ["a", "b", "apart", "crowded"])


def _gathered(members: _Members, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for pairs in found:
        if len(pairs[0]):
            held.append(pairs)
            size += len(pairs[0])
        if size > 100_000:
            yield _table(members, *(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _table(members, *(np.concatenate(c) for c in zip(*held, strict=True)))


def _met(threshold: float, most: int, kept: int, again: bool):
    """Pairs of the cells of a task. Of a crowded cell only those of its pivot, and its key; ``again``: all pairs of crowded
    cells."""

    def limited(members: _Members, among: np.ndarray, crowded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cell_of, counts = np.repeat(np.arange(len(among)), members.sizes), np.zeros(len(among), np.int64)
        held = []
        for a, b, apart in members.direct(among):
            np.add.at(counts, cell_of[a], 1)
            fit = counts[cell_of[a]] <= kept * members.sizes[cell_of[a]]
            held.append((a[fit], b[fit], apart[fit]))
        crowded |= counts > kept * members.sizes
        for a, b, apart in held:
            fit = ~crowded[cell_of[a]]
            yield a[fit], b[fit], apart[fit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [v for batch in batches for v in batch.column(1).to_pylist()]
        if not values:
            return
        members = _Members(values, threshold)
        values.clear()
        if again:
            yield from _gathered(members, (pairs for cell in range(len(members.sizes)) for pairs in members.ringed(cell)))
            return
        crowded = members.sizes > most
        yield from _gathered(members, limited(members, (members.sizes > 1) & ~crowded, crowded))
        yield from _gathered(members, (members.led(cell) for cell in np.flatnonzero(crowded).tolist()))
        keys = pa.array(members.key[members.starts[crowded]].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int32()), keys], ["a", "b", "apart", "crowded"])

    return run


def fresh_keys(members: DataFrame, column: str) -> np.ndarray:
    """Flags by the upper 24 bits of the keys that fresh members have."""
    flags = np.zeros(1 << 24, bool)
    for row in members.filter("fresh").select(column).toLocalIterator():
        flags[np.frombuffer(row[0], np.uint32) >> np.uint32(8)] = True
    return flags


def rounds(work: Workspace, members: DataFrame, bands: Bands, threshold: float, crowded: dict[str, np.ndarray] | None = None, whole: bool = False) -> tuple[list[DataFrame], dict[str, np.ndarray]]:
    """(tables of (a, b, apart), keys of crowded cells by round) of ``members`` (id, batch, n, fresh, code, keys).

    A pair shares a cell, b is fresh, a of a smaller batch, and neither sizes nor codes rule their similarity out. It
    comes once for each round that finds it. Of cells that are ``crowded``, with over ``direct`` members or ``KEPT`` pairs a
    member, the first call pairs only the first member with the others; a second one, given their keys, forms all their pairs.
    ``whole``: no cell is crowded.
    """
    spark = members.sparkSession
    total, fresh = members.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
    tables, keys = [], {}
    for column in bands.columns:
        only = None if crowded is None else crowded.get(column)
        if crowded is not None and only is None:
            continue
        old_only = fresh_keys(members, column) if fresh <= min(FEW, total // 4) else None
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * GROUP * _MEMBER // PART))
        most, kept = (2**62, 2**40) if whole else (direct(), KEPT)
        dealt = members.select("id", "batch", "n", "fresh", "code", column).mapInArrow(_dealt(parts, only, old_only), "part int, members binary")
        met = dealt.repartitionById(parts, F.col("part")).mapInArrow(_met(threshold, most, kept, only is not None), "a bigint, b bigint, apart int, crowded bigint")
        met = work.keep(met, f"round-{column}")
        found = [r.crowded for r in met.filter("crowded is not null").select("crowded").distinct().collect()]  # few cells are
        if found:
            keys[column] = np.sort(np.array(found, np.int64).astype(np.uint32))
        tables.append(met.filter("crowded is null").select("a", "b", "apart"))
    return tables, keys
