"""New versions made from old ones by edit scripts, for tests. [V7, D15]"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def run_script(old: bytes, script: bytes) -> bytes:
    """Pairs of bytes (i, j): below 128 repeat j bytes from i on, as far as there are any;
    below 150 append j, i - 128 times; else swap the byte at j with the next. Places are
    taken modulo the length. An odd last byte is ignored; old must not be empty.
    """
    if not old and len(script) > 1:
        raise ValueError("an edit script needs a version that isn't empty")
    data = bytearray(old)
    for i, j in zip(script[::2], script[1::2], strict=False):
        size = len(data)
        if i < 128:
            data += data[i % size : i % size + j]
        elif i < 150:
            data += bytes([j]) * (i - 128)
        else:
            a, b = j % size, (j + 1) % size
            data[a], data[b] = data[b], data[a]
    return bytes(data)


def scripted(old: Column, script: Column) -> Column:
    """run_script as a column; null if either is."""

    @F.arrow_udf("binary")
    def udf(olds: pa.Array, scripts: pa.Array) -> pa.Array:
        rows = zip(olds.to_pylist(), scripts.to_pylist(), strict=True)
        return pa.array([None if o is None or s is None else run_script(o, s) for o, s in rows], pa.binary())

    return udf(old, script)
