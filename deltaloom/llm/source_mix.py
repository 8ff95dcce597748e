"""Mixing sources to target weights by Poisson replication.

A source with share p of the rows and target weight w repeats each row w/p times on average.
The number of copies of a row is the Poisson quantile, with that mean, of a number in (0, 1)
that is hashed from the row's id and a seed: the same row gets the same count in any run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shuffle_parts

OTHER = "*other*"
#: Largest rate whose distribution is written into the plan; those of larger ones are a small table.
PLANNED = 1000.0
PART = 1 << 16  # copies of a row that are made at a time
HASH_DIGITS = 13  # hexadecimal digits of an md5: 52 bits, exact in a double


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of the key and the seed."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)))
    whole = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(2 ** (4 * HASH_DIGITS))


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at 0, 1, ... until what is left is below 2**-54."""
    if rate <= 0:
        return [1.0]
    most = int(rate + 12 * math.sqrt(rate) + 30)
    out, total = [], 0.0
    for k in range(most + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
    return out


def poisson_middle(rate: float) -> tuple[int, list[float]]:
    """A count, and the distribution function from it on, of a large rate.

    What lies 12 deviations or more away has less than 2**-90 and isn't kept; the sum is
    scaled to 1, as the terms' logarithms are large.
    """
    away = 12 * math.sqrt(rate) + 30
    first = max(0, int(rate - away))
    out, total = [], 0.0
    for k in range(first, int(rate + away) + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
    return first, [p / total for p in out]


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    max_rate: float | None = None,
) -> DataFrame:
    """Each row of docs, as often as its source's target weight asks, in a random order.

    weights: target share of each source, of any sum; sources that aren't named, and null,
    share the weight of the key ``*other*`` (0 and so no rows if it isn't given). A named
    source without rows gives nothing, and the others keep their proportions.

    Returns the columns of docs, with mix_copy (long, from 0) and mix_key (string, in whose
    order the rows lie in their partitions); columns of docs by these names are replaced.
    Rows of one id get equal counts; null ids are hashed as such. An empty table gives none.

    Counts of the named sources reach the driver: as many rows as weights has keys. A source
    that is hardly there gets as many copies of its rows as its weight asks; a rate over
    max_rate, if one is given, is refused.
    """
    group = F.when(F.col(source_col).isin([k for k in weights if k != OTHER]), F.col(source_col))
    group = F.coalesce(group, F.lit(OTHER))
    sizes = {r[0]: r[1] for r in docs.groupBy(group.alias("g")).count().collect()}
    there = {k: float(weights.get(k, 0.0)) for k in sizes}
    total, asked = sum(sizes.values()), sum(there.values()) or 1.0
    rates = {k: w / asked * total / sizes[k] for k, w in there.items()}
    if max_rate is not None and any(r > max_rate for r in rates.values()):
        raise ValueError(f"a source would be repeated over {max_rate} times: {rates}")
    none = F.array().cast("array<double>")
    steps = none
    planned = {k: r for k, r in rates.items() if r <= PLANNED}
    large = [(k, *poisson_middle(r)) for k, r in sorted(rates.items()) if r > PLANNED]
    if planned:
        steps = F.create_map(
            *[
                x
                for k, r in sorted(planned.items())
                for x in (F.lit(k), F.array(*[F.lit(p) for p in poisson_steps(r)]))
            ]
        )[group]
    drawn = uniform(F.col(id_col), seed)

    def counted(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, p: n + F.when(p < drawn, 1).otherwise(0))

    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    if large:
        spark = docs.sparkSession
        middles = spark.createDataFrame(large, "__group string, __first long, __steps array<double>")
        copies = F.coalesce(F.col("__first") + counted(F.col("__steps")), counted(steps))
        each = docs.join(F.broadcast(middles), group == F.col("__group"), "left").select(*kept, copies.alias("__copies"))
        parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / PART))
        each = each.where("__copies > 0").select(*kept, "__copies", F.explode(parts).alias("__part"))
        begin = F.col("__part") * PART
        numbers = F.sequence(begin, F.least(begin + PART, F.col("__copies")) - 1)
        made = each.select(*kept, F.explode(numbers).alias("mix_copy"))
    else:
        repeated = F.array_repeat(F.lit(0), counted(steps))
        made = docs.select(*kept, F.posexplode(repeated).alias("mix_copy", "__zero"))
    out = (
        made
        .drop("__zero")
        .withColumn("mix_copy", F.col("mix_copy").cast("long"))
        .withColumn(
            "mix_key",
            F.md5(
                F.concat_ws(
                    ":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "mix_copy", F.lit(seed)
                )
            ),
        )
    )
    n = shuffle_parts(docs.sparkSession)
    return out.repartition(n, F.xxhash64("mix_key", "mix_copy")).sortWithinPartitions("mix_key")
