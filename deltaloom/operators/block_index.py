"""The block index of old versions, and the probes of new ones against it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytesops import as_array, common_prefix, divided_up, next_power_of_two, slice_bytes


def _offsets(length: Column, block: int, step: int) -> Column:
    """0, step, ... as long as a whole block follows; none in shorter data."""
    last = F.greatest(length - block, F.lit(0)).cast("int")
    return F.when(length >= block, F.sequence(F.lit(0), last, F.lit(step)))


def aligned_blocks(pairs: DataFrame, block: int, column: str = "old") -> DataFrame:
    """pair_id, old_off and block of each whole block; a ragged tail is left out. [X1]"""
    each = pairs.select(
        "pair_id",
        F.col(column).alias("__all"),
        F.explode(_offsets(F.length(column), block, block)).alias("__at"),
    )
    return each.select(
        "pair_id",
        F.col("__at").cast("long").alias("old_off"),
        slice_bytes(F.col("__all"), F.col("__at"), block).alias("block"),
    )


def block_index(pairs: DataFrame, block: int, column: str = "old") -> DataFrame:
    """pair_id, block and the least offset at which the block stands. [X3, D4]

    Hash aggregation on both sides of one shuffle: of equal blocks in a task one row is left.
    """
    return aligned_blocks(pairs, block, column).groupBy("pair_id", "block").agg(
        F.min("old_off").alias("old_off")
    )


def index_geometry(lengths: DataFrame, block: int) -> DataFrame:
    """entries, buckets, slots and table_bytes of a table of 8-slot buckets, half full. [X4]"""
    entries = F.floor(F.col("length") / block).cast("long")
    buckets = F.when(F.col("length") < block, F.lit(1)).otherwise(
        F.greatest(F.lit(1), next_power_of_two(divided_up(2 * entries, 8)))
    ).cast("long")
    return lengths.select(
        "*",
        entries.alias("entries"),
        buckets.alias("buckets"),
        (buckets * 8).alias("slots"),
        (buckets * 64).alias("table_bytes"),
    )


_of_byte = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PROBED = 1 << 20  # offsets that are probed at a time
_MARKS = 1 << 22  # bits of the filter in front of the index, at most


def block_hashes(data: np.ndarray, block: int) -> np.ndarray:
    """A hash of the block that begins at each offset, put together from those of half its size."""
    if len(data) < block:
        return np.zeros(0, np.uint64)
    part, size, power = _of_byte[data], 1, int(_BASE)
    out, done = None, 0
    while True:
        if block & size:
            out = part if out is None else out[: len(part) - done] * np.uint64(power) + part[done:]
            done += size
        if 2 * size > block:
            return out[: len(data) - block + 1]
        part, size, power = part[:-size] * np.uint64(power) + part[size:], 2 * size, power * power % 2**64


class Index:
    """The aligned blocks of an old version by hash, each at its least offset. [X3]"""

    def __init__(self, old: np.ndarray, block: int) -> None:
        self.old, self.block = old, block
        hashes = np.zeros(len(old) // block, np.uint64)
        blocks = old[: len(hashes) * block].reshape(-1, block)
        for j in range(block):
            hashes = hashes * _BASE + _of_byte[blocks[:, j]]
        self.hashes, first = np.unique(hashes, return_index=True)
        self.offsets = first.astype(np.int64) * block
        self.marks = np.zeros(min(_MARKS, 1 << max(6, (8 * len(hashes)).bit_length())), dtype=bool)
        self.marks[self._mark(self.hashes)] = True

    def _mark(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) & np.uint64(len(self.marks) - 1)).astype(np.int64)

    def probe(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets in new whose block is indexed, rising, and the offsets of that block in old. [X5, X6]

        Blocks are compared byte by byte. Two blocks of old that share a hash, of which one
        isn't found, would cost a larger patch.
        """
        at, of, block = [], [], self.block
        for start in range(0, max(0, len(new) - block + 1) if len(self.hashes) else 0, _PROBED):
            hashes = block_hashes(new[start : start + _PROBED + block - 1], block)
            near = np.flatnonzero(self.marks[self._mark(hashes)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
            same = self.hashes[place] == hashes[near]
            near, old = near[same] + start, self.offsets[place[same]]
            for j in range(block):
                same = self.old[old + j] == new[near + j]
                if not same.all():
                    near, old = near[same], old[same]
            at.append(near)
            of.append(old)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *at]), np.concatenate([none, *of])


def _probed(spans: DataFrame, block: int, missing: bool) -> DataFrame:
    kinds = {"pair_id": pa.string(), "chunk_idx": pa.int32(), "pos": pa.int64()} | ({} if missing else {"old_off": pa.int64()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, first, size, old, new in zip(*(batch[c] for c in _SPAN), strict=True):
                index, new, size = Index(as_array(old.as_py()), block), as_array(new.as_py()), size.as_py()
                found = []
                for i, start in enumerate(range(0, len(new), size)):
                    own = new[start : start + size]
                    at, of = index.probe(own)
                    if missing:
                        at = np.setdiff1d(np.arange(max(0, len(own) - block + 1)), at, assume_unique=True)
                    found.append((np.full(len(at), first.as_py() + i, np.int32), at, of))
                if found:
                    columns = [np.concatenate(x) for x in zip(*found, strict=True)][: len(kinds) - 1]
                    names = pa.array([pair.as_py()] * len(columns[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], list(kinds))

    return spans.select(*_SPAN).mapInArrow(
        probe, "pair_id string, chunk_idx int, pos long" + ("" if missing else ", old_off long")
    )


_SPAN = ("pair_id", "chunk_idx", "size", "old", "bytes")


def hits(spans: DataFrame, block: int) -> DataFrame:
    """pair_id, chunk_idx, pos and old_off of each probe that the index of old holds. [X5]

    spans: chunks that lie together, with their old version (``chunking.spans``). Every offset
    of a chunk is probed where the chunk is, and only hits become rows.
    """
    return _probed(spans, block, missing=False)


def misses(spans: DataFrame, block: int) -> DataFrame:
    """The probes that the index doesn't hold."""
    return _probed(spans, block, missing=True)


def prefix_match(needles: DataFrame, index: DataFrame, block: int) -> DataFrame:
    """pair_id, start and len of the indexed match of each needle. [X7, X8, D5]

    needles: pair_id, old, needle. The block at the needle's start is looked up; a hit is
    extended forward only. A miss, or data shorter than a block, gives (0, 0).
    """
    head = F.when(F.length("needle") >= block, slice_bytes(F.col("needle"), 0, block))
    found = needles.withColumn("block", head).join(index, ["pair_id", "block"], "left")
    after = F.col("old_off") + block
    more = common_prefix(
        slice_bytes(F.col("old"), after, F.length("old")),
        slice_bytes(F.col("needle"), block, F.length("needle")),
    )
    return found.select(
        "pair_id",
        F.coalesce("old_off", F.lit(0)).cast("long").alias("start"),
        F.coalesce(block + more, F.lit(0)).cast("long").alias("len"),
    )
