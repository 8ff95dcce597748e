"""The control stream, its compression, and its application to old bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batches
from ..functions.bytesops import as_array, little_endian
from ..schema import PatchDecodeError


def varint(x: int) -> bytes:
    """Seven bits in each byte, low ones first; the high bit says that more follow. [C3]"""
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


class Stream:
    """Reads a control stream. [C3, A1]"""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, what: str) -> int:
        out = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise PatchDecodeError(f"truncated {what}")
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    def take(self, n: int, what: str) -> bytes:
        if self.at + n > len(self.data):
            raise PatchDecodeError(f"truncated {what}")
        self.at += n
        return self.data[self.at - n : self.at]


def encode_controls(controls: DataFrame) -> DataFrame:
    """pair_id, chunk_idx, seq and code of each control. [C1]

    An optional column copy_from (long) holds an old offset from which the literal bytes are
    copied instead of being stored.
    """

    @F.arrow_udf("binary")
    def encode(add: pa.Array, length: pa.Array, same: pa.Array, copy: pa.Array, seek: pa.Array, old: pa.Array) -> pa.Array:
        out = []
        # A row at a time: a batch as Python's values would take its memory several times.
        for row in zip(add, length, same, copy, seek, old, strict=True):
            a, n, zero, c, s, at = (x.as_py() for x in row)
            head = varint(2 * n + 1) if zero else varint(2 * n) + a
            body = varint(2 * len(c)) + c if at is None else varint(2 * len(c) + 1) + varint(at)
            out.append(head + body + varint(2 * s if s >= 0 else -2 * s - 1))
        return pa.array(out, pa.binary())

    old = F.col("copy_from") if "copy_from" in controls.columns else F.lit(None)
    code = encode("add", "add_length", "same", "copy", "seek", old.cast("long"))
    return controls.select("pair_id", "chunk_idx", "seq", code.alias("code"))


def compress_chunks(chunks: DataFrame, codes: DataFrame, level: int) -> DataFrame:
    """Patch records, one for each chunk: its controls in order, compressed. [D8, D9, C5]"""
    stream = F.expr("listagg(code) WITHIN GROUP (ORDER BY seq)")
    streams = codes.groupBy("pair_id", "chunk_idx").agg(stream.alias("stream"))
    packed = chunks.select(
        F.col("pair_id").cast("string").alias("pair_id"), "chunk_idx", "new_start", "new_len"
    ).join(streams, ["pair_id", "chunk_idx"], "left")

    @F.arrow_udf("struct<raw_len:long,data:binary>")
    def pack(streams: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        sizes, out = [], []
        for stream in streams:
            raw = stream.as_py() or b""
            sizes.append(len(raw))
            out.append(packer.compress(raw))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["raw_len", "data"])

    return packed.withColumn("packed", pack("stream")).select(
        "pair_id",
        "chunk_idx",
        F.lit(0).cast("long").alias("old_start"),
        "new_start",
        "new_len",
        F.col("packed.raw_len").alias("raw_len"),
        F.length("packed.data").cast("long").alias("data_len"),
        F.col("packed.data").alias("data"),
    )


def decompress(data: bytes, raw_len: int) -> bytes:
    """The bytes of one whole frame; damage and what follows the frame are errors. [C7]"""
    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, raw_len), allow_extra_data=False)
    except zstandard.ZstdError as e:
        raise PatchDecodeError(f"invalid data: {e}") from e
    if len(out) != raw_len:
        raise PatchDecodeError(f"invalid data: {len(out)} bytes, not {raw_len}")
    return out


def apply_stream(stream: bytes, old: bytes, old_start: int, new_len: int) -> bytes:
    """New bytes of one chunk. Anything out of range is an error. [A1-A6]"""
    source, read, at, out = as_array(old), Stream(stream), old_start, []
    while read.at < len(stream):
        tag = read.number("add tag")
        n = tag >> 1
        if not 0 <= at <= at + n <= len(source):
            raise PatchDecodeError("an add range lies outside old")
        own = source[at : at + n]
        if not tag & 1:
            own = own + np.frombuffer(read.take(n, "add data"), dtype=np.uint8)
        out.append(own.tobytes())
        at += n
        tag = read.number("copy tag")
        n = tag >> 1
        if tag & 1:
            place = read.number("old position")
            if place + n > len(source):
                raise PatchDecodeError("a copy range lies outside old")
            out.append(source[place : place + n].tobytes())
        else:
            out.append(read.take(n, "copy data"))
        code = read.number("seek")
        at += code >> 1 if not code & 1 else -(code >> 1) - 1
    new = b"".join(out)
    if len(new) != new_len:
        raise PatchDecodeError(f"a chunk has {len(new)} bytes, not {new_len}")
    return new


TOGETHER = 1 << 26  # bytes of new whose chunks share one copy of old


def apply_chunks(records: DataFrame, olds: DataFrame) -> DataFrame:
    """pair_id, chunk_idx, new_start, data_len and bytes, rebuilt from records and old. [A1, A7]

    olds: pair_id, old. Each chunk needs its record and old only, so chunks are independent;
    those that lie together in new share a copy of old.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for pair, old, own in zip(*(part[c] for c in ("pair_id", "old", "records")), strict=True):
                pair, base = pair.as_py(), old.as_py()
                for r in own.as_py():
                    new = apply_stream(decompress(r["data"], r["raw_len"]), base, r["old_start"], r["new_len"])
                    yield pair, r["chunk_idx"], r["new_start"], len(r["data"]), new

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), _REBUILT)

    fields = ("chunk_idx", "new_start", "old_start", "new_len", "raw_len", "data")
    part = F.floor(F.col("new_start") / TOGETHER)
    parts = records.groupBy("pair_id", part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias("records"))
    joined = parts.join(olds.select(F.col("pair_id").cast("string").alias("pair_id"), "old"), "pair_id")
    return joined.select("pair_id", "old", "records").mapInArrow(
        rebuild, "pair_id string, chunk_idx int, new_start long, data_len long, bytes binary"
    )


_REBUILT = pa.schema(
    [("pair_id", pa.string()), ("chunk_idx", pa.int32()), ("new_start", pa.int64()), ("data_len", pa.int64()), ("bytes", pa.binary())]
)


def joined_chunks(chunks: DataFrame, column: str = "new", *more: Column) -> DataFrame:
    """pair_id, the bytes of its chunks in order, and more aggregates of them. [A7, IO8]

    A version is one value here; larger ones are kept as rows of chunks by new_start.
    """

    whole = F.expr("listagg(bytes) WITHIN GROUP (ORDER BY new_start, chunk_idx)")
    return chunks.groupBy("pair_id").agg(whole.alias(column), *more)


def record_bytes(old_start: Column, new_start: Column, new_len: Column, raw_len: Column, data: Column) -> Column:
    """A record with its five numbers in front. [IO4]"""

    numbers = (little_endian(x, 8) for x in (old_start, new_start, new_len, raw_len, F.length(data).cast("long")))
    return F.concat(*numbers, data)
