"""python -m deltaloom.cli diff OLD NEW PATCH | patch OLD PATCH OUTPUT | cycle OLD NEW"""

from __future__ import annotations

import argparse
import hashlib
import os
import struct
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytesops import format_size
from .operators import codec, patchfile
from .plans import deltas
from .schema import HEADER, MAGIC, VERSION, DiffOptions
from .sources.versions import read_files, write_file


def _content(spark: SparkSession, path: str, column: str) -> DataFrame:
    return read_files(spark, path).select(F.lit("file").alias("pair_id"), F.col("content").alias(column))


def _pair(spark: SparkSession, older: str, newer: str) -> DataFrame:
    return _content(spark, older, "old").join(_content(spark, newer, "new"), "pair_id")


def diff(spark: SparkSession, older: str, newer: str, patch: str, options: DiffOptions) -> None:
    records = deltas.records(_pair(spark, older, newer), options).persist()
    n, size = records.agg(F.count("*"), F.coalesce(F.sum("new_len"), F.lit(0))).first()
    fields = (F.col(c) for c in ("old_start", "new_start", "new_len", "raw_len", "data"))
    rows = records.select("chunk_idx", codec.record_bytes(*fields).alias("record"))
    write_file(rows, "record", ["chunk_idx"], patch, struct.pack(HEADER, MAGIC, VERSION, size, n))
    records.unpersist()


def patch(spark: SparkSession, older: str, patch: str, output: str) -> None:
    records = patchfile.parse(_content(spark, patch, "patch"))
    if patchfile.broken(records).count():
        raise ValueError("the patch's chunks don't make up its new version")
    write_file(codec.apply_chunks(records, _content(spark, older, "old")), "bytes", ["new_start", "chunk_idx"], output)


def cycle(spark: SparkSession, older: str, newer: str, options: DiffOptions) -> None:
    """Makes and applies a patch by files, and reports its size, ratio, times and speeds. [V2-V4, V6, IO9]"""
    with tempfile.TemporaryDirectory() as folder:
        made, again = (os.path.join(folder, x) for x in ("patch", "new"))
        began = time.perf_counter()
        diff(spark, older, newer, made, options)
        diffed = time.perf_counter()
        patch(spark, older, made, again)
        patched = time.perf_counter()
        new_size, patch_size = os.path.getsize(newer), os.path.getsize(made)
        if new_size != os.path.getsize(again):
            raise ValueError("the patch gives a new version of another size")
        if _digest(newer) != _digest(again):
            raise ValueError("the patch doesn't give the new version")
    sizes = spark.range(1).select(*[format_size(F.lit(n)).alias(c) for c, n in (("patch", patch_size), ("new", new_size))]).first()
    of = "-" if not new_size else f"{100 * patch_size / new_size:.3f}%"
    took, back = diffed - began, patched - diffed
    speed = os.path.getsize(older) / took / (1 << 20)  # by the old version's size, which is indexed
    print(
        f"{'zstd':12} {'patch ' + sizes['patch']:20} {of + ' of ' + sizes['new']:27} "
        f"{f'dtime {took:.3f}s':20} {f'ptime {back:.3f}s':20} {f'{speed:.2f} MiB/s':20}".rstrip()
    )


def _digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def _at_least_one(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="deltaloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, files in (("diff", "older newer patch"), ("patch", "older patch output"), ("cycle", "older newer")):
        command = commands.add_parser(name)
        for f in files.split():
            command.add_argument(f)
        if name != "patch":
            command.add_argument("--block-size", type=int, default=32)
            command.add_argument("--scan-chunk-mb", type=int, default=1)
            command.add_argument("--threads", type=_at_least_one)
            command.add_argument("--max", action="store_true")
            command.add_argument("--ram", action="store_true", help="accepted; Spark chooses where the index lies")
    a = parser.parse_args(args)
    try:
        options = None
        if a.command != "patch":
            options = DiffOptions(a.block_size, a.scan_chunk_mb << 20, 22 if a.max else 3)
    except ValueError as e:
        parser.error(str(e))
    threads = getattr(a, "threads", None) or "*"
    spark = SparkSession.builder.master(f"local[{threads}]").config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "diff":
        diff(spark, a.older, a.newer, a.patch, options)
    elif a.command == "patch":
        patch(spark, a.older, a.patch, a.output)
    else:
        cycle(spark, a.older, a.newer, options)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
