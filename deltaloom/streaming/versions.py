"""New versions from a stream, each against the version that is known of its name.

The reference of this work has no event time, so none is used here: a micro-batch of new
versions is a batch of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import deltas
from ..schema import DiffOptions


def write_patches(
    versions: DataFrame, known: DataFrame, path: str, checkpoint: str, options: DiffOptions = DiffOptions()
) -> StreamingQuery:
    """Patch records of streamed versions (name, content), each against the latest of its name.

    The latest is that of an earlier batch, else of known (name, content), else empty. A
    batch's records go to ``path/batch=N`` and its versions to ``path.versions/batch=N``, which
    a repeated batch overwrites: each batch is there once. Two versions of one name in a batch
    have no order, so they fail it.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("a batch holds two versions of one name")
        names = batch.select("name")
        olds = known.select("name", "content", F.lit(-1).alias("batch"))
        if number:
            earlier = batch.sparkSession.read.parquet(f"{path}.versions").where(F.col("batch") < number)
            olds = olds.unionByName(earlier.select("name", "content", "batch"))
        latest = olds.join(names, "name", "left_semi").groupBy("name").agg(F.max_by("content", "batch").alias("old"))
        pairs = batch.select("name", F.col("content").alias("new")).join(latest, "name", "left")
        pairs = pairs.select(F.col("name").alias("pair_id"), F.coalesce("old", F.lit(b"")).alias("old"), "new")
        deltas.records(pairs, options).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.select("name", "content").write.mode("overwrite").parquet(f"{path}.versions/batch={number}")

    return (
        versions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
