"""URL filters as a sort-merge range join.

A host is turned around label by label (``a.example.com`` to ``com.example.a.``), so that a
rule for a host and its subdomains holds for one interval of keys: those that start with the
rule's key. Intervals of prefixes are nested or apart. URLs and rules are sorted together by
key, and a sweep keeps a stack with one place for each depth: the place at depth d holds the
last rule host of d labels. It is active for a URL if the URL's key starts with it; keys with
a common prefix lie together, so no rule below the top of its place can be active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def reversed_host(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def _last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def filter_urls(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    parts: int | None = None,
) -> DataFrame:
    """Judge each URL by the longest rule that fits it.

    rules: (host, path, verdict). Returns one row for each row of urls: id, url, host, path,
    rule, verdict; other columns of urls are left out, so their names can't clash.

    - A null URL, or one without ``://``, has an empty host and path and gets ``default``.
    - Null ids and repeated rows are kept as they are.
    - Rules of equal length: the longer host wins, then ``allow``. Rules with a null in host
      or path fit nothing. No rules or no URLs: defaults, or no rows.

    The sweep runs in groups of one last label (``com``); a label with more than 1/parts of
    the URLs is salted and its rules are given to each of its salts. At most ``parts`` such
    labels exist, and only they reach the driver.
    """
    parts = parts or 4 * shuffle_parts(urls.sparkSession)
    pages = urls.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    hosts = (
        rules.select("host", "path", "verdict")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        F.length(F.concat("host", "path")).alias("chars"),
                        F.length("host").alias("host_chars"),
                        (F.col("verdict") == "allow").alias("allows"),
                        F.concat("host", "path").alias("rule"),
                        "path",
                        "verdict",
                    )
                )
            ).alias("rules")
        )
        .select(
            F.size(F.split("host", r"\.")).alias("depth"),
            _last_label(F.col("host")).alias("top"),
            reversed_host(F.col("host")).alias("key"),
            "rules",
        )
    )
    deepest = hosts.agg(F.max("depth")).first()[0] or 0

    counted = pages.groupBy(_last_label(F.col("host")).alias("top")).count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = counted.where(F.col("count") > max(1, total // parts)).collect()
    salts = F.lit(1)
    if hot:
        by_label = F.create_map(
            *[F.lit(x) for r in hot for x in (r["top"], -(-r["count"] * parts // total))]
        )
        salts = F.coalesce(by_label[F.col("top")], F.lit(1))

    pages = pages.withColumn("top", _last_label(F.col("host")))
    of_pages = pages.select(
        "top",
        F.pmod(F.xxhash64("id", "url"), salts).cast("int").alias("salt"),
        reversed_host(F.col("host")).alias("key"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast(hosts.schema["rules"].dataType).alias("rules"),
        F.struct("id", "url", "host", "path").alias("page"),
    )
    of_rules = hosts.select(
        "top",
        F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"),
        "key",
        "depth",
        "rules",
        F.lit(None).cast(of_pages.schema["page"].dataType).alias("page"),
    )
    sweep = (
        Window.partitionBy("top", "salt")
        .orderBy("key", F.col("depth").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = of_pages.unionByName(of_rules)
    for d in range(1, deepest + 1):
        place = F.when(F.col("depth") == d, F.struct("key", "rules"))
        swept = swept.withColumn(f"place{d}", F.last(place, ignorenulls=True).over(sweep))
    swept = swept.where(F.col("page").isNotNull())
    fits = [
        F.when(
            F.col("key").startswith(F.col(f"place{d}.key")),
            F.filter(
                F.col(f"place{d}.rules"), lambda r: F.col("page.path").startswith(r["path"])
            ),
        )
        for d in range(1, deepest + 1)
    ]
    none = F.array().cast(hosts.schema["rules"].dataType)
    best = F.array_max(F.concat(none, *[F.coalesce(x, none) for x in fits]))
    return swept.withColumn("best", best).select(
        F.col("page.id").alias(id_col),
        F.col("page.url").alias(url_col),
        F.col("page.host").alias("host"),
        F.col("page.path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
