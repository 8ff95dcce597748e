"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes ratios.

Whether a hashed n-gram occurs in a text is its feature. Counts over labelled texts give each
feature's log-count ratio r = log((p / |p|) / (q / |q|)), p and q being its counts in toxic
and other texts plus ``smoothing``. A logistic regression is fitted on the features times r.
Its score for a text is the logistic function of the sum over the text's features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class Fit:
    """The bound of the sample, and the regression.

    per_label: labelled texts of each label that the classifier is fitted on at most, those
    of the least hash of their id.
    """

    per_label: int = 3000
    smoothing: float = 1.0
    least_texts: int = 3
    least_ratio: float = 0.8
    penalty: float = 10.0
    steps: int = 150


_SLICE = 1 << 20  # characters that are hashed at a time
_last = np.zeros(1 << BITS, dtype=np.int64)


def ngrams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a whole text, ids below 2 ** BITS."""
    text = " " + re.sub(r"\s+", " ", text.lower()).strip() + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = [_of_slice(codes[at : at + _SLICE + max(ORDERS) - 1]) for at in range(0, len(codes), _SLICE)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _of_slice(codes: np.ndarray) -> np.ndarray:
    found = [np.zeros(0, np.uint32)]
    hashed = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (hashed ^ (hashed >> np.uint32(16))) * np.uint32(0xC2B2AE35)
            found.append(mixed >> np.uint32(32 - BITS))
    ids = np.concatenate(found).astype(np.int64)
    places = np.arange(len(ids))
    _last[ids] = places  # of equal ids the last place stays
    return ids[_last[ids] == places]


def fit_regression(texts: list[str], labels: np.ndarray, fit: Fit) -> tuple[float, np.ndarray]:
    """Bias and weight of each n-gram."""
    weights = np.zeros(1 << BITS)
    rows = [ngrams(t).astype(np.int32) for t in texts]
    n, toxic = len(rows), labels.astype(bool)
    if n == 0 or toxic.all() or not toxic.any():
        # Nothing to tell apart: the share of toxic texts, 0.5 without any.
        share = (toxic.sum() + 1) / (n + 2)
        return float(np.log(share / (1 - share))), weights
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for ids, label in zip(rows, toxic, strict=True):
        (p if label else q)[ids] += 1  # a text's ids are distinct
    ratio = np.log((p + fit.smoothing) / (toxic.sum() + fit.smoothing))
    ratio -= np.log((q + fit.smoothing) / ((~toxic).sum() + fit.smoothing))
    used = np.flatnonzero((p + q >= fit.least_texts) & (np.abs(ratio) >= fit.least_ratio))
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    for i, ids in enumerate(rows):  # only what is used stays in memory
        of_row = number[ids]
        rows[i] = of_row[of_row >= 0]
    column, r = np.concatenate(rows), ratio[used]
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    value = r[column]
    # Each label weighs the same in sum, whatever its share of the sample.
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * n
    w, bias = np.zeros(len(used)), 0.0
    # Adagrad: each step of a weight is divided by the root of its squared gradients so far.
    squares, bias_squares = np.full(len(used), 1e-8), 1e-8
    for _ in range(fit.steps):
        score = np.bincount(row, weights=value * w[column], minlength=n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - toxic)
        slope = np.bincount(column, weights=value * error[row], minlength=len(used)) + fit.penalty * w
        squares += slope**2
        bias_squares += error.sum() ** 2
        w -= 0.1 * slope / np.sqrt(squares)
        bias -= 0.1 * error.sum() / np.sqrt(bias_squares)
    weights[used] = w * r
    return float(bias), weights


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text isn't divisible by folds; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) != 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    fit: Fit = Fit(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> tuple[float, np.ndarray]:
    """Fit on a bounded sample of the labelled rows that in_training keeps.

    Labels other than 0 and 1 are left out; of repeated labels of an id the larger counts, of
    repeated texts the least. The sample's texts meet in one task; the driver gets the
    weights, 2 ** BITS numbers at most.
    """
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & in_training(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = None
    for label in (0, 1):
        drawn = marked.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(fit.per_label)
        sample = drawn if sample is None else sample.unionByName(drawn)
    # At most 2 * per_label rows of an id and a label.
    sampled = (
        texts.join(F.broadcast(sample), "id")
        .groupBy("id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["label"], r["text"]) for b in batches for r in b.to_pylist())
        bias, weights = fit_regression([r[2] for r in rows], np.array([r[1] for r in rows]), fit)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(weights[used], bias))],
            names=["feature", "weight"],
        )

    model = sampled.repartition(1).mapInArrow(fitted, "feature long, weight double").toArrow()
    features, values = model["feature"].to_numpy(), model["weight"].to_numpy()
    weights = np.zeros((1 << BITS) + 1)
    weights[features] = values  # the bias, at -1, is the last
    return float(weights[-1]), weights[:-1]


def score_column(docs: DataFrame, model: tuple[float, np.ndarray]):
    """A function of a string column that gives its score; null is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of 2 ** BITS numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, weights = shared.value
        for batch in batches:
            sums = [bias + weights[ngrams(x.as_py() or "")].sum() for x in batch]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -700, 700))))

    return score


def classify(
    docs: DataFrame,
    labels: DataFrame,
    fit: Fit = Fit(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of each row of docs.

    Whole texts are scored; null texts are empty ones, which get the score of the bias alone.
    Repeated rows are scored alike, other columns are not read, an empty table gives none.
    Without labels of both kinds every text gets the share of toxic ones.
    """
    score = score_column(docs, train(docs, labels, fit, id_col, text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (~in_training(F.col(id_col))).alias("held_out"),
        score(F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
