"""Patches as one value: assembly, parsing and validation. [D10, IO4-IO6]"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import batches
from ..functions.bytesops import little_endian
from ..schema import CHUNK_ROW, HEADER, MAGIC, RECORD, VERSION, PatchDecodeError, WrongMagic, WrongVersion
from .codec import record_bytes


def assemble(records: DataFrame) -> DataFrame:
    """pair_id and patch, from patch records. Two records of one chunk fail the query. [IO4]"""

    record = record_bytes(*(F.col(c) for c in ("old_start", "new_start", "new_len", "raw_len", "data")))
    whole = (
        records.select("pair_id", "chunk_idx", "new_len", record.alias("record"))
        .groupBy("pair_id")
        .agg(
            F.sum("new_len").alias("size"),
            F.count("*").alias("n"),
            F.size(F.collect_set("chunk_idx")).alias("kinds"),
            F.expr("listagg(record) WITHIN GROUP (ORDER BY chunk_idx)").alias("records"),
        )
    )
    twice = F.raise_error(F.concat(F.lit("repeated pair_id: "), F.col("pair_id")))
    head = F.concat(F.lit(struct.pack("<II", MAGIC, VERSION)), little_endian(F.col("size"), 8), little_endian(F.col("n"), 4))
    patch = F.when(F.col("n") == F.col("kinds"), F.concat(head, "records")).otherwise(twice.cast("binary"))
    return whole.select("pair_id", patch.alias("patch"))


def parse_patch(patch: bytes) -> tuple[int, list[tuple]]:
    """new_size and the records of a patch; bytes after the last are ignored. [IO5, IO6]"""

    def numbers(layout: str, at: int) -> tuple:
        if at + struct.calcsize(layout) > len(patch):
            raise PatchDecodeError("truncated patch")
        return struct.unpack_from(layout, patch, at)

    if (magic := numbers("<I", 0)[0]) != MAGIC:
        raise WrongMagic(f"wrong magic: {magic:#x}")
    if (version := numbers("<I", 4)[0]) != VERSION:
        raise WrongVersion(f"wrong version: {version:#x}")
    _, _, new_size, count = numbers(HEADER, 0)
    at, out = struct.calcsize(HEADER), []
    for _ in range(count):
        *fields, size = numbers(RECORD, at)
        at += struct.calcsize(RECORD)
        if at + size > len(patch):
            raise PatchDecodeError("truncated chunk data")
        out.append((*fields, size, patch[at : at + size]))
        at += size
    return new_size, out


def parse(patches: DataFrame, permissive: bool = False) -> DataFrame:
    """pair_id, chunk_idx, new_size and the fields of each record of patches (pair_id, patch).

    A patch that can't be read fails the query, or, if permissive, gives one row with its
    error and nulls.
    """
    fields = [x.split()[0] for x in CHUNK_ROW.split(", ")]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for key, data in zip(part["pair_id"], part["patch"], strict=True):
                try:
                    new_size, records = parse_patch(data.as_py() or b"")
                except PatchDecodeError as e:
                    if not permissive:
                        raise
                    yield key.as_py(), None, None, *[None] * len(fields), str(e)
                    continue
                for i, r in enumerate(records):
                    yield key.as_py(), i, new_size, *r, None

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), _PARSED)

    keyed = patches.select(F.col("pair_id").cast("string").alias("pair_id"), "patch")
    parsed = keyed.mapInArrow(read, f"pair_id string, chunk_idx int, new_size long, {CHUNK_ROW}, error string")
    return parsed if permissive else parsed.drop("error")


_PARSED = pa.schema(
    [("pair_id", pa.string()), ("chunk_idx", pa.int32()), ("new_size", pa.int64())]
    + [(x, pa.int64()) for x in ("old_start", "new_start", "new_len", "raw_len", "data_len")]
    + [("data", pa.binary()), ("error", pa.string())]
)


def broken(records: DataFrame) -> DataFrame:
    """pair_ids of parsed patches whose chunks overlap, leave gaps or miss the size."""
    order = Window.partitionBy("pair_id").orderBy("chunk_idx")
    before = F.coalesce(F.lag(F.col("new_start") + F.col("new_len")).over(order), F.lit(0))
    whole = (
        records.withColumn("fits", F.col("new_start") == before)
        .groupBy("pair_id")
        .agg(F.bool_and("fits").alias("fits"), F.sum("new_len").alias("n"), F.max("new_size").alias("size"))
    )
    return whole.where(~F.col("fits") | (F.col("n") != F.col("size"))).select("pair_id")
