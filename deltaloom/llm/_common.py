"""What several operators share: tables, settled results and the number of parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN = "deltaloom-"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """The rows of df as a written table in the shared folder for checkpoints.

    Its plan is a scan of those files: a lost executor costs a read, and the optimizer sees
    nothing of what came before. Tables that a result reads stay until the folder's owner
    clears it, like reliable checkpoints; others go by ``discard``.
    """
    path = f"{shared_folder(df.sparkSession)}/{_OWN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[settled] = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for settled in tables:
        path = settled.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(settled))
        path.getFileSystem(settled.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes and rows of an Arrow batch, of which a task holds several at once.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is settled within goes to Python in small batches; the session's settings hold again afterwards."""
    before = {k: spark.conf.get(k) for k in _BATCH}
    try:
        for k, v in _BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given.

    Only a local session, whose tasks all run here, may have none: it gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return _own_folder()
    return found


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix=_OWN)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
