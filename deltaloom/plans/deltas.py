"""diff, patch and cycle over pairs (pair_id, old, new), each one lazy plan. [F4, F13, V1-V3]

A null pair_id, old or new gives no patch. A pair_id must not be repeated: patches of two
pairs of one id would be mixed, so ``diff`` fails on them. An empty new version has one empty
chunk.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import block_index, chunking, codec, controls, cover, patchfile, scan
from ..schema import HEADER, RECORD, DiffOptions


def _whole(pairs: DataFrame) -> DataFrame:
    there = pairs.where(F.col("pair_id").isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull())
    return there.select(F.col("pair_id").cast("string").alias("pair_id"), "old", "new")


def matches(pairs: DataFrame, options: DiffOptions = DiffOptions(), mode: str = "exact") -> DataFrame:
    """Matches of each chunk; mode is exact (the scan) or relational (the cover)."""
    pairs = _whole(pairs)
    spans = chunking.spans(pairs, options.chunk_size)
    if mode == "relational":
        taken = cover.greedy_cover(block_index.hits(spans, options.block_size), options.block_size)
        return cover.cover_matches(pairs, chunking.chunks(pairs, options.chunk_size), taken)
    if mode != "exact":
        raise ValueError(f"no such mode: {mode}")
    return scan.exact_matches(spans, options.block_size)


def rebased(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with offsets of the whole new version instead of the chunk's. [F4]"""
    starts = chunks.select("pair_id", "chunk_idx", "new_start")
    return (
        matches.join(starts, ["pair_id", "chunk_idx"])
        .withColumn("add_new_start", F.col("add_new_start") + F.col("new_start"))
        .withColumn("copy_end", F.col("copy_end") + F.col("new_start"))
        .drop("new_start")
    )


def records(pairs: DataFrame, options: DiffOptions = DiffOptions(), mode: str = "exact") -> DataFrame:
    """Patch records, one row for each chunk; the form for versions of any number of chunks."""
    chunks = chunking.chunks(_whole(pairs), options.chunk_size)
    codes = codec.encode_controls(controls.controls(matches(pairs, options, mode)))
    return codec.compress_chunks(chunks, codes, options.zstd_level)


def diff(pairs: DataFrame, options: DiffOptions = DiffOptions(), mode: str = "exact") -> DataFrame:
    """pair_id and patch."""
    return patchfile.assemble(records(pairs, options, mode))


def patch(patches: DataFrame, olds: DataFrame) -> DataFrame:
    """pair_id and new, from patches (pair_id, patch) and olds (pair_id, old)."""
    return codec.joined_chunks(codec.apply_chunks(patchfile.parse(patches), olds))


def cycle(pairs: DataFrame, options: DiffOptions = DiffOptions(), mode: str = "exact") -> DataFrame:
    """pair_id, new_size, patch_size, ratio (null for an empty version) and ok. [V2, V3, D14]

    ok: the patch gives new again, by length and SHA-256. Patches are made once: what a record
    takes comes along with the chunk that it gives.
    """
    parts = codec.apply_chunks(patchfile.parse(diff(pairs, options, mode)), pairs)
    sizes = F.sum(F.col("data_len") + struct.calcsize(RECORD)) + struct.calcsize(HEADER)
    rebuilt = codec.joined_chunks(parts, "new", sizes.alias("patch_size")).select(
        "pair_id", "patch_size", F.length("new").alias("got_size"), F.sha2("new", 256).alias("got")
    )
    whole = _whole(pairs).select(
        "pair_id", F.length("new").cast("long").alias("new_size"), F.sha2("new", 256).alias("wanted")
    )
    same = (F.col("got") == F.col("wanted")) & (F.col("got_size") == F.col("new_size"))
    return whole.join(rebuilt, "pair_id", "left").select(
        "pair_id",
        "new_size",
        "patch_size",
        F.when(F.col("new_size") > 0, F.col("patch_size") / F.col("new_size")).alias("ratio"),
        F.coalesce(same, F.lit(False)).alias("ok"),
    )
