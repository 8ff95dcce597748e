"""A cover of new versions by indexed runs, with window functions and a fold over a chunk's runs.

Patches from it are valid and larger than those of the exact scan: runs are taken from left
to right, and no bytes are added with differences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytesops import slice_bytes


def runs(hits: DataFrame, block: int) -> DataFrame:
    """pair_id, chunk_idx, pos, len and old_off of hits joined along their diagonal.

    Hits of one diagonal old_off - pos that touch or overlap form a run.
    """
    on_diagonal = Window.partitionBy("pair_id", "chunk_idx", "diagonal").orderBy("pos")
    apart = F.col("pos") - F.lag("pos").over(on_diagonal) > block
    return (
        hits.withColumn("diagonal", F.col("old_off") - F.col("pos"))
        .withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("fresh").over(on_diagonal))
        .groupBy("pair_id", "chunk_idx", "diagonal", "run")
        .agg(F.min("pos").alias("pos"), (F.max("pos") - F.min("pos") + block).alias("len"))
        .select("pair_id", "chunk_idx", "pos", "len", (F.col("diagonal") + F.col("pos")).alias("old_off"))
    )


def greedy_cover(hits: DataFrame, block: int) -> DataFrame:
    """The runs that are taken, from left to right, where they begin after the one before.

    The runs of a chunk come together in a row; its bytes bound their number.
    """

    @F.arrow_udf("array<int>")
    def taken(places: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for starts, sizes in zip(places.to_pylist(), lengths.to_pylist(), strict=True):
            kept, free = [], 0
            for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
                if start >= free:
                    kept.append(i)
                    free = start + size
            out.append(kept)
        return pa.array(out, pa.list_(pa.int32()))

    each = runs(hits, block).groupBy("pair_id", "chunk_idx").agg(
        F.array_sort(F.collect_list(F.struct("pos", "len", "old_off"))).alias("runs")
    )
    kept = each.withColumn("kept", taken(F.col("runs.pos"), F.col("runs.len")))
    return kept.select("pair_id", "chunk_idx", F.inline(F.transform("kept", lambda i: F.get("runs", i))))


def cover_matches(pairs: DataFrame, chunks: DataFrame, cover: DataFrame) -> DataFrame:
    """The cover as matches: runs are copied from old, what lies between is literal.

    Ends and numbers come from the runs alone; bytes join once for each chunk.
    """
    run = F.struct("pos", "len", "old_off")
    of_chunk = cover.groupBy("pair_id", "chunk_idx").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    # Each chunk starts with an empty run at 0, whose seek leads to the first.
    zero = F.lit(0).cast("long")
    lead = F.array(F.struct(zero.alias("pos"), zero.alias("len"), zero.alias("old_off")))
    full = (
        chunks.where("new_len > 0")
        .withColumn("pair_id", F.col("pair_id").cast("string"))
        .join(of_chunk, ["pair_id", "chunk_idx"], "left")
        .join(pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "old"), "pair_id")
        .withColumn("runs", F.when(F.col("runs").isNull(), lead).otherwise(F.concat(lead, F.col("runs"))))
    )
    each = full.select("pair_id", "chunk_idx", "new_len", "old", "bytes", "runs", F.posexplode("runs").alias("seq", "run"))
    end = F.coalesce(F.get("runs", F.col("seq") + 1)["pos"], F.col("new_len"))
    pos, length, old_off = F.col("run.pos"), F.col("run.len"), F.col("run.old_off")
    return each.select(
        "pair_id",
        "chunk_idx",
        "seq",
        old_off.alias("add_old_start"),
        pos.alias("add_new_start"),
        length.alias("add_length"),
        end.alias("copy_end"),
        slice_bytes(F.col("old"), old_off, length).alias("old_part"),
        slice_bytes(F.col("bytes"), pos, end - pos).alias("new_part"),
    )


def tiling(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """pair_id, chunk_idx and tiled of each chunk that isn't empty.

    tiled: its matches leave no gap, don't overlap, and end with the chunk.
    """
    order = Window.partitionBy("pair_id", "chunk_idx").orderBy("seq")
    before = F.coalesce(F.lag("copy_end").over(order), F.lit(0))
    joined = F.col("add_new_start") == before
    whole = F.col("copy_end") >= F.col("add_new_start") + F.col("add_length")
    of_chunk = (
        matches.withColumn("fits", joined & whole)
        .groupBy("pair_id", "chunk_idx")
        .agg(F.bool_and("fits").alias("fits"), F.max("copy_end").alias("end"))
    )
    checked = chunks.where("new_len > 0").join(of_chunk, ["pair_id", "chunk_idx"], "left")
    right = F.coalesce(F.col("fits") & (F.col("end") == F.col("new_len")), F.lit(False))
    return checked.select("pair_id", "chunk_idx", right.alias("tiled"))


def untiled(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that aren't tiled."""
    return tiling(matches, chunks).where("NOT tiled").drop("tiled")
