"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of whole numbers. Query rows and candidate rows are dealt into
blocks of bounded size; each pair of blocks is one group. In a group the candidates become
postings, one list of (row, weight) for each term; for each term of the queries the weighted
postings are scattered into dense arrays of scores, and a partition of each array selects
the best of the block. The best of all blocks are merged in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 2048  # rows in a block, about
TILE = 64  # queries whose dense scores are held at a time


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as array<bigint>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    limit = float("inf")
    return vector.isNotNull() & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(limit)) & (x > F.lit(-limit)),
    )


def _blocks(rows: DataFrame, size: int) -> tuple[Column, int]:
    """A block for each row from its contents, and how many there are."""
    n = max(1, math.ceil(rows.count() / size))
    return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"), n


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    candidate_rows: int = CANDIDATES,
    query_rows: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Vectors are array<bigint>; a shorter one counts as padded with zeros. Score: the inner
    product, largest first, ties to the smaller id. A candidate with the query's own id is
    left out. Rows with a null id or vector, or a null component, take no part. Repeated rows
    of a candidate each count; repeated rows of a query are one query, whose candidates then
    come as often. Other columns are not read. With no queries or candidates: no rows.

    A score outside 64 bits is refused with an ArithmeticError.
    """

    def rows(df: DataFrame) -> DataFrame:
        whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
        return df.select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")
        ).where(F.col("id").isNotNull() & whole)

    q, c = rows(queries), rows(candidates)
    (q_block, n_q), (c_block, n_c) = _blocks(q, query_rows), _blocks(c, candidate_rows)
    q = q.select(
        q_block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), "id", "v"
    )
    c = c.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), c_block.alias("cb"), "id", "v"
    )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_best_of_block(*_rows(left), *_rows(right), k))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)]
        columns = columns or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    of_blocks = (
        q.groupBy("qb", "cb")
        .cogroup(c.groupBy("qb", "cb"))
        .applyInArrow(best, "query_id long, vec_id long, score long")
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        of_blocks.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and row, term and weight of each component that isn't 0."""
    ids = table["id"].to_numpy()
    vectors = table["v"].combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = np.diff(vectors.offsets.to_numpy())
    weights = vectors.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = np.flatnonzero(weights)
    return ids, row[there], term[there], weights[there]


def _best_of_block(
    q_ids, q_row, q_term, q_weight, c_ids, c_row, c_term, c_weight, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not len(q_ids) or not len(c_ids):
        return
    by_id = np.argsort(c_ids, kind="stable")  # then a place in the block ranks ids
    place = np.empty_like(by_id)
    place[by_id] = np.arange(len(by_id))
    c_ids, c_row = c_ids[by_id], place[c_row]
    terms = int(max(q_term.max(initial=-1), c_term.max(initial=-1))) + 1
    bound = float(np.abs(q_weight.astype(float)).max(initial=0)) * float(np.abs(c_weight.astype(float)).max(initial=0))
    if bound * max(1, terms) >= 2.0**63:
        raise ArithmeticError("an inner product may not fit in 64 bits")
    order = np.argsort(c_term, kind="stable")
    c_row, c_weight = c_row[order], c_weight[order]
    starts = np.searchsorted(c_term[order], np.arange(terms + 1))
    for at in range(0, len(q_ids), TILE):
        ids = q_ids[at : at + TILE]
        own = (q_row >= at) & (q_row < at + TILE)
        rows, of_term, weight = q_row[own] - at, q_term[own], q_weight[own]
        scores = np.zeros((len(ids), len(c_ids)), dtype=np.int64)
        for r, t, w in zip(rows.tolist(), of_term.tolist(), weight.tolist(), strict=True):
            a, b = starts[t], starts[t + 1]
            scores[r][c_row[a:b]] += w * c_weight[a:b]
        for r, q in enumerate(ids):
            yield _select(int(q), scores[r], c_ids, k)


def _select(query: int, score: np.ndarray, c_ids: np.ndarray, k: int):
    """The k best of one dense array, ties to the smaller id; the query's own id has no part."""
    there = np.flatnonzero(c_ids != query)
    if len(there) > k:
        of_there = score[there]
        limit = np.partition(of_there, len(there) - k)[len(there) - k]
        above, equal = there[of_there > limit], there[of_there == limit]
        there = np.concatenate([above, equal[: k - len(above)]])  # places rise with the ids
    return np.full(len(there), query, np.int64), c_ids[there], score[there]
