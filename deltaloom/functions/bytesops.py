"""Functions on bytes: Arrow UDFs where SQL has none, else column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text; positions everywhere count bytes, not characters."""
    return F.encode(text, "UTF-8")


def slice_bytes(data: Column, start: Column | int, length: Column | int) -> Column:
    """length bytes from offset start (from 0). [F10, A3, A4]"""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.substring(data, (start + 1).cast("int"), length.cast("int"))


def as_array(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=np.uint8)


def _pairwise(function, kind: pa.DataType, spark_kind: str):
    """A UDF of two binary columns, null where either is."""

    @F.arrow_udf(spark_kind)
    def udf(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [
            function(as_array(a), as_array(b)) if a is not None and b is not None else None
            for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)
        ]
        return pa.array(out, kind)

    return udf


def prefix_of(a: np.ndarray, b: np.ndarray) -> int:
    """Compared in steps that grow, so that a short prefix of long data costs little."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 4 * step
    return n


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int(np.count_nonzero(a[:n] == b[:n]))


def _minus(a: np.ndarray, b: np.ndarray) -> bytes:
    n = min(len(a), len(b))
    return (a[:n] - b[:n]).tobytes()


def _plus(a: np.ndarray, b: np.ndarray) -> bytes:
    n = min(len(a), len(b))
    return (a[:n] + b[:n]).tobytes()


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix. [X9, M2]"""
    return _pairwise(prefix_of, pa.int64(), "long")(a, b)


def equal_bytes(a: Column, b: Column) -> Column:
    """How many bytes are equal at the same place, up to the shorter. [F12, M1]"""
    return _pairwise(_equal, pa.int64(), "long")(a, b)


def wrapping_minus(a: Column, b: Column) -> Column:
    """a - b modulo 256, byte by byte, up to the shorter. [F9, M6]"""
    return _pairwise(_minus, pa.binary(), "binary")(a, b)


def wrapping_plus(a: Column, b: Column) -> Column:
    """a + b modulo 256, byte by byte, up to the shorter. [A2, M6]"""
    return _pairwise(_plus, pa.binary(), "binary")(a, b)


def zigzag(x: Column) -> Column:
    """Signed to unsigned, small magnitudes to small numbers. [C4]"""
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned number, seven bits in each. [C3]"""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def divided_up(a: Column, b: Column | int) -> Column:
    """a / b, rounded up. [M7]"""
    return F.floor((a + b - 1) / b).cast("long")


def next_power_of_two(x: Column) -> Column:
    """The least power of two that isn't below x; 1 for 0. [M7]"""
    bits = F.length(F.bin(F.greatest(x, F.lit(1)) - 1))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def _scaled(n: Column, unit: int, digits: int) -> Column:
    """Digits are rounded half to even, as of exact values; Java's formats round half up."""
    return F.format_string(f"%.{digits}f", F.bround(n / float(unit), digits))


def format_size(n: Column) -> Column:
    """A size for people: MiB with one digit, KiB with none, bytes. [M8]"""
    return (
        F.when(n >= 1 << 20, F.concat(_scaled(n, 1 << 20, 1), F.lit(" MiB")))
        .when(n >= 1 << 10, F.concat(_scaled(n, 1 << 10, 0), F.lit(" KiB")))
        .otherwise(F.format_string("%d B", n))
    )


def format_size_fine(n: Column) -> Column:
    """As format_size with one more digit, and bytes up to the limits themselves. [M9]"""
    return (
        F.when(n > 1 << 20, F.concat(_scaled(n, 1 << 20, 2), F.lit(" MiB")))
        .when(n > 1 << 10, F.concat(_scaled(n, 1 << 10, 1), F.lit(" KiB")))
        .otherwise(F.format_string("%d B", n))
    )


def little_endian(x: Column, size: int) -> Column:
    """The low size bytes of a long, the lowest first."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))
