"""A corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; its result is
written as Parquet and read again as the docs of the next. All but the last return the
columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import order_minhash, piece_codec, secret_scan, source_mix, toxicity
from deltaloom.llm._common import settle, table
from deltaloom.llm.queries import SOURCE_WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more; texts without any n-gram stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = toxicity.score_column(docs, model)
    bare = F.coalesce(F.length(F.trim("text")) == 0, F.lit(True))
    return docs.where(bare | (score(F.col("text")) < 0.5))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return order_minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    spanned = docs.withColumn("__spans", secret_scan.secret_spans(F.col("text")))
    found = F.size("__spans") > 0
    text = secret_scan.redact(F.col("text"), F.col("__spans"))
    return spanned.withColumn("text", text).withColumn(
        "n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a random order."""
    return source_mix.mix_sources(docs, SOURCE_WEIGHTS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    vocabulary = piece_codec.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_codec.coded_column(spark, vocabulary)
    whole = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", "lang", "source", whole.alias("text"), coded(F.col("text")).alias("coded"))
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        (F.col("coded.text") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("order_minhash", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix),
    ("piece_codec", encode),
]

#: Training, alignment and merges aren't for SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage kept rests in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else settle(docs), sf_dir)
    return docs
