"""Versions and patches as files and tables. [IO1, IO3, IO5, IO8]"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytesops import slice_bytes, text_bytes


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, length and content of each file; content is read if used.

    name is the path below the folder that is read, for a single file its own name, and for a
    pattern the whole path: no two files have one name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark's scan leaves out files of no bytes; only its list of files has them.
    names = [(re.sub("^([^:/]+):///", r"\1:/", unquote(x)),) for x in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string")
    empty = listed.join(files.select("path"), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    files = files.select("path", "length", "content").unionByName(empty)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    below = F.col("path").startswith(folder + "/")
    name = F.when(below, F.expr(f"substring(path, {len(folder) + 2})")).when(
        F.col("path") == folder, F.substring_index("path", "/", -1)
    )
    return files.select(F.coalesce(name, F.col("path")).alias("name"), "length", "content")


def file_pairs(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Pairs of two folders' files of the same name; a file without an old one has an empty one."""
    olds = read_files(spark, old).select("name", F.col("content").alias("old"))
    news = read_files(spark, new).select("name", F.col("content").alias("new"))
    return news.join(olds, "name", "left").select(
        F.col("name").alias("pair_id"), F.coalesce("old", F.lit(b"")).alias("old"), "new"
    )


def pages(blobs: DataFrame, size: int) -> DataFrame:
    """name, page_no, start and bytes of pages of content, so that no later row is large. [D1]"""
    each = blobs.select(
        "name",
        "content",
        F.explode(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size) - 1, F.lit(0)).cast("int"))
        ).alias("page_no"),
    )
    start = F.col("page_no") * F.lit(size).cast("long")
    return each.select("name", "page_no", start.alias("start"), slice_bytes(F.col("content"), start, size).alias("bytes"))


def write_records(records: DataFrame, path: str) -> None:
    """Patch records as a Parquet table, each chunk a row."""
    records.write.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_file(rows: DataFrame, column: str, order: list[str], path: str, head: bytes = b"") -> None:
    """One local file of a column's bytes in order; one partition at a time passes the driver."""
    with open(path, "wb") as f:
        f.write(head)
        for r in rows.orderBy(*order).select(column).toLocalIterator():
            f.write(r[0])


def edited_documents(documents: DataFrame, inserted: bytes = b"<edit>") -> DataFrame:
    """Each document against itself with bytes put in at the middle. [P2]"""
    old = text_bytes(F.col("text"))
    half = F.floor(F.length(old) / 2)
    new = F.concat(slice_bytes(old, 0, half), F.lit(inserted), slice_bytes(old, half, F.length(old)))
    return documents.select(F.col("doc_id").cast("string").alias("pair_id"), old.alias("old"), new.alias("new"))


def conversation_history(conversations: DataFrame) -> DataFrame:
    """Each conversation up to a turn against it up to the turn before. [P3]"""
    order = Window.partitionBy("conv_id").orderBy("turn")

    def until(last: int):
        said = F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, last))
        return text_bytes(F.array_join(said, "\n"))

    return conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), until(-1).alias("old"), until(0).alias("new")
    )


def successive_turns(conversations: DataFrame) -> DataFrame:
    """Each turn against the turn before in its conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
        text_bytes(F.lag("text").over(order)).alias("old"),
        text_bytes(F.col("text")).alias("new"),
    )
    return turns.where(F.col("old").isNotNull() & F.col("new").isNotNull())


SHARED = 5  # distinct blocks that near copies share


def near_copies(held: DataFrame) -> DataFrame:
    """doc_id, class_id and links of documents (doc_id, block, each once) with near copies. [P1]

    Documents with equal sets of blocks are one class, of its least id, and stand in joins
    once. links counts the documents that share SHARED blocks with one, its class included. Of a
    set's blocks all but the SHARED - 1 that most classes hold are joined: two sets that
    share SHARED blocks share one of those, and a block of nearly all documents is none.
    Blocks are told apart by hashes of 64 bits, and candidates are compared by arrays of them.
    """
    held = held.select("doc_id", F.xxhash64("block").alias("block"))
    number = F.col("block")
    sets = held.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bit_xor(number).alias("x"), F.sum(F.shiftright(number, 20)).alias("s")
    )
    of_set = sets.where(F.col("n") >= SHARED).groupBy("n", "x", "s")
    classes = of_set.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    members = sets.join(classes, ["n", "x", "s"]).select("doc_id", "class_id", "size")
    blocks = held.join(members.where("doc_id = class_id"), "doc_id").select("class_id", "block")
    several = blocks.groupBy("block").agg(F.count("*").alias("holders")).where("holders > 1")
    counted = blocks.join(several, "block")
    common_first = Window.partitionBy("class_id").orderBy(F.desc("holders"), "block")
    ranked = blocks.join(several, "block", "left").withColumn("place", F.row_number().over(common_first))
    rare = ranked.where((F.col("place") >= SHARED) & F.col("holders").isNotNull()).select("class_id", "block")
    x = rare.select(F.col("class_id").alias("a"), "block")
    y = rare.select(F.col("class_id").alias("b"), "block")
    candidates = x.join(y, "block").where("a < b").select("a", "b").distinct()
    shared = counted.groupBy("class_id").agg(F.count("*").alias("n"), F.collect_list("block").alias("blocks"))
    shared = shared.where(F.col("n") >= SHARED)
    of_a, of_b = (shared.select(F.col("class_id").alias(c), F.col("blocks").alias(f"{c}_blocks")) for c in "ab")
    both = candidates.join(of_a, "a").join(of_b, "b")
    pairs = both.where(F.size(F.array_intersect("a_blocks", "b_blocks")) >= SHARED).select("a", "b")
    ends = F.inline(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other"))))
    sizes = classes.select(F.col("class_id").alias("other"), "size")
    others = pairs.select(ends).join(sizes, "other").groupBy("class_id").agg(F.sum("size").alias("others"))
    linked = members.join(others, "class_id", "left")
    links = F.coalesce("others", F.lit(0)) + F.col("size") - 1
    return linked.select("doc_id", "class_id", links.alias("links")).where("links > 0")
