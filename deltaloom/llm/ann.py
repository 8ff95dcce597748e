"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a pseudo-random rotation (three rounds of random signs and a
fast Hadamard transform) and puts each vector into the bucket of its nearest signed axis. A
query looks into the buckets of its nearest ``probes`` axes in each table. Queries and
candidates of a bucket meet in groups of bounded size, where the exact distances of all
candidates are ranked; the best of all groups are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, settle

CANDIDATES, QUERIES = 8192, 2048  # rows of a bucket that meet in a group, about
#: On vectors without any structure (64 components, neighbours at 0.75 of the usual distance)
#: these find 0.99 of the ten nearest; clustered vectors need less.
TABLES, PROBES = 8, 16
ALL_AXES = 1 << 30  # more than any vector has


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.concatenate(
            [pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2
        ).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def nearest_axes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Axes (2 * axis + 1 if negative) by nearness, of each vector in each table."""
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    # Scaled by the largest component first: squares of very large ones would overflow.
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x = np.pad(x, ((0, 0), (0, size - vectors.shape[1])))
    out = np.empty((len(x), tables, min(probes, 2 * size)), dtype=np.int32)
    for t in range(tables):
        turned = x
        signs = np.random.default_rng([seed, t, size])
        for _ in range(3):
            turned = _hadamard(turned * signs.choice([-1.0, 1.0], size))
        along = np.stack([turned, -turned], axis=2).reshape(len(x), 2 * size)
        out[:, t] = np.argsort(-along, axis=1, kind="stable")[:, : out.shape[2]]
    return out


def _axes_udf(tables: int, probes: int, seed: int):
    @F.arrow_udf("array<int>")
    def axes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.diff(batch.offsets.to_numpy())
            flat, starts = batch.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            found: list = [None] * len(sizes)
            for d in np.unique(sizes):
                of_size = np.flatnonzero(sizes == d)
                x = flat[starts[of_size, None] + np.arange(d)]
                for i, a in zip(of_size, nearest_axes(x, tables, probes, seed), strict=True):
                    found[i] = a.ravel()
            yield pa.array(found, pa.list_(pa.int32()))

    return axes


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and Euclidean distance (score) of the nearest found.

    Ties go to the smaller id; a candidate with the query's own id is left out, and an id
    counts once, at its least distance, however often it occurs. Rows with a null id, a null
    or zero vector, or a null or non-finite component take no part; vectors of different
    lengths are never compared. Other columns are not read. A query whose buckets hold fewer
    than k candidates is compared with all; with no queries or candidates there are no rows.
    """

    def rows(df: DataFrame, tables: int, probes: int) -> DataFrame:
        """id, v and axes of the usable rows, settled: axes are found once, v keeps its own type."""
        limit = F.lit(float("inf"))
        single = dict(df.dtypes)[vector_col] == "array<float>"
        v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
        usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        used = df.where(F.col(id_col).isNotNull() & usable & F.exists(v, lambda x: x != 0))
        used = used.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        axes = _axes_udf(tables, probes, seed)(F.col("v").cast("array<double>"))
        return settle(used.withColumn("axes", axes))

    q, c = rows(queries, tables, probes), rows(candidates, tables, 1)
    found = settle(_found(q, c, tables, k))
    discard(q, c)
    # A candidate lies on one axis of a table, so all axes of one table reach every candidate.
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    few = queries.join(enough, F.col(id_col).cast("long") == F.col("query_id"), "left_anti")
    if few.where(F.col(id_col).isNotNull()).limit(1).count():
        every = _found(rows(few, 1, ALL_AXES), rows(candidates, 1, 1), 1, k)
        found = found.unionByName(every).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _found(q: DataFrame, c: DataFrame, tables: int, k: int) -> DataFrame:
    """query_id, vec_id and score of the best of each group of a bucket's queries and candidates.

    q, c: id, v and axes of all tables in turn. The plan has a row for each bucket, at most
    tables * 2 * components of them for a length; it is settled, so that its size is known
    where it is joined and vectors are shuffled once, to their groups.
    """
    bucket = ["dim", "tab", "axis"]

    def spread_out(rows: DataFrame) -> DataFrame:
        per = F.size("axes") / tables
        each = rows.select("id", "v", per.alias("per"), F.posexplode("axes").alias("at", "axis"))
        return each.select("id", "v", F.size("v").alias("dim"), F.floor(F.col("at") / F.col("per")).alias("tab"), "axis")

    q, c = spread_out(q), spread_out(c)
    n_c = c.groupBy(*bucket).agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("n_c"))
    n_q = q.groupBy(*bucket).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n_q"))
    plan = settle(n_c.join(n_q, bucket))
    own = F.xxhash64("id", "v")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def part(n):
        return F.pmod(own, F.col(n)).cast("int")

    q = q.join(plan, bucket).select(*bucket, part("n_q").alias("qb"), spread("n_c").alias("cb"), "id", "v")
    c = c.join(plan, bucket).select(*bucket, spread("n_q").alias("qb"), part("n_c").alias("cb"), "id", "v")

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        return _rank(left, right, k)

    group = [*bucket, "qb", "cb"]
    return (
        q.groupBy(*group)
        .cogroup(c.groupBy(*group))
        .applyInArrow(ranked, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, sorted by id."""
    ids = table["id"].to_numpy()
    flat = np.concatenate([x.flatten().to_numpy() for x in table["v"].chunks] or [np.zeros(0)]).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else flat.reshape(0, 1)


def _rank(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    (q_ids, q), (c_ids, c) = _vectors(left), _vectors(right)
    found: list[tuple] = []
    for i in range(len(q_ids) if len(c_ids) else 0):
        away = np.sqrt(((c - q[i]) ** 2).sum(axis=1))
        there = np.flatnonzero(c_ids != q_ids[i])
        order = there[np.argsort(away[there], kind="stable")]  # ids rise, so ties are right
        if len(order) > k:
            _, first = np.unique(c_ids[order], return_index=True)
            order = order[np.sort(first)[:k]]
        found.append((np.full(len(order), q_ids[i]), c_ids[order], away[order]))
    kinds = (np.int64, np.int64, np.float64)
    columns = [np.concatenate([f[j] for f in found] or [np.zeros(0)]).astype(t) for j, t in enumerate(kinds)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))
