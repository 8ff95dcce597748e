"""Matches to controls: bytes to add to old ones, literal bytes, and a seek. [F8-F11, D7]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytesops import slice_bytes, varint_length, wrapping_minus, zigzag


def seek(order) -> Column:
    """From the end of a match's old bytes to the next one's; 0 for the last. [F11]"""
    after = F.col("add_old_start") + F.col("add_length")
    return F.coalesce(F.lead("add_old_start").over(order) - after, F.lit(0)).cast("long")


def controls(matches: DataFrame) -> DataFrame:
    """pair_id, chunk_idx, seq, add_length, same, add, copy and seek of each match.

    same: all differences are 0, and add is then empty. [C2]
    """
    order = Window.partitionBy("pair_id", "chunk_idx").orderBy("seq")
    with_old = slice_bytes(F.col("new_part"), 0, F.col("add_length"))
    literal = slice_bytes(
        F.col("new_part"), F.col("add_length"), F.length("new_part") - F.col("add_length")
    )
    made = matches.select(
        "pair_id",
        "chunk_idx",
        "seq",
        "add_length",
        (with_old == F.col("old_part")).alias("same"),
        wrapping_minus(with_old, F.col("old_part")).alias("delta"),
        literal.alias("copy"),
        seek(order).alias("seek"),
    )
    add = F.when(F.col("same"), F.lit(b"")).otherwise(F.col("delta"))
    return made.withColumn("delta", add).withColumnRenamed("delta", "add")


def encoded_length(same: Column, add_length: Column, copy_length: Column, seek: Column) -> Column:
    """Bytes that a control takes in the stream. [C1, C3]"""
    add = varint_length(2 * add_length) + F.when(same, F.lit(0)).otherwise(add_length)
    return add + varint_length(2 * copy_length) + copy_length + varint_length(zigzag(seek))
