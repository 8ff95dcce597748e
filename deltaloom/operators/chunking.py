"""Chunks of a new version: fixed size, the last may be short. [D2, F1]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytesops import divided_up, slice_bytes


def chunk_count(length: Column, size: int | None) -> Column:
    """Empty data has one empty chunk, so that a patch of it can be read again."""
    if size is None:
        return F.lit(1).cast("long")
    return F.greatest(F.lit(1), divided_up(length, size)).cast("long")


def chunks(pairs: DataFrame, size: int | None, column: str = "new") -> DataFrame:
    """pair_id, chunk_idx, new_start, new_len and bytes of each chunk; null data has none."""
    length = F.length(column).cast("long")
    step = F.lit(size).cast("long") if size else F.greatest(length, F.lit(1))
    numbered = pairs.where(F.col(column).isNotNull()).select(
        "pair_id",
        F.col(column).alias("__all"),
        length.alias("__length"),
        step.alias("__step"),
        F.explode(F.sequence(F.lit(0), (chunk_count(length, size) - 1).cast("int"))).alias("chunk_idx"),
    )
    start = F.col("chunk_idx") * F.col("__step")
    new_len = F.least(F.col("__step"), F.col("__length") - start)
    return numbered.select(
        "pair_id",
        "chunk_idx",
        start.alias("new_start"),
        new_len.alias("new_len"),
        slice_bytes(F.col("__all"), start, new_len).alias("bytes"),
    )


TOGETHER = 1 << 26  # bytes of new whose chunks share one copy of old


def spans(pairs: DataFrame, size: int | None) -> DataFrame:
    """pair_id, chunk_idx of the first chunk, size of a chunk, old, and bytes of chunks together.

    A span holds whole chunks, up to TOGETHER bytes or one chunk. So an old version is there
    once for each span, not for each chunk, and where new is one span nothing is shuffled.
    """
    pairs = pairs.withColumn("size", F.lit(size).cast("long") if size else F.greatest(F.length("new").cast("long"), F.lit(1)))
    chunks = F.greatest(F.lit(1), F.floor(F.lit(TOGETHER) / F.col("size"))).cast("long")
    last = F.floor((F.greatest(F.length("new"), F.lit(1)) - 1) / (chunks * F.col("size"))).cast("int")
    there = pairs.where(F.col("old").isNotNull() & F.col("new").isNotNull())
    numbered = there.withColumn("span", F.explode(F.sequence(F.lit(0), last)))
    start, step = F.col("span") * chunks * F.col("size"), chunks * F.col("size")
    return numbered.select(
        F.col("pair_id").cast("string").alias("pair_id"),
        (F.col("span") * chunks).cast("int").alias("chunk_idx"),
        "size",
        "old",
        slice_bytes(F.col("new"), start, F.least(step, F.lit((1 << 31) - 1))).alias("bytes"),
    )
