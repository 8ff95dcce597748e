"""One query for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    chat_format,
    license_scan,
    order_minhash,
    piece_codec,
    secret_scan,
    source_mix,
    topk,
    toxicity,
    url_filter,
)
from ._common import table

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Target shares: the common source less than it has, all others alike.
SOURCE_WEIGHTS = {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)} | {source_mix.OTHER: 0.04}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = piece_codec.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_codec.encode_texts(table(spark, sf_dir, "documents"), vocabulary)
    coded = piece_codec.decode_texts(encoded, vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def counted(kind):
        of_kind = F.filter("spans", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(kind) for kind, *_ in secret_scan.BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts are control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(
        spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    )
    formatted = chat_format.format_chats(turns, chat_format.text_part(F.col("text")))
    return chat_format.read_back(formatted)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_piece_codec": op2_piece_codec,
    "op3_order_minhash": op3_order_minhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_source_mix": op7_source_mix,
    "op8_topk": op8_topk,
    "op9_ann": op9_ann,
    "op10_license_scan": op10_license_scan,
}

SQL: dict[str, str] = {}



def _secret_sql() -> str:
    """Spans of each pattern from the lengths of matches and gaps, entropy window by window."""
    parts, spans = [], []
    for rank, (kind, pattern, group, least, _) in enumerate(secret_scan.BASE):
        parts.append(_places_sql(kind, pattern, group, least))
        spans.append(f"SELECT rid, {rank} AS rank, '{kind}' AS kind, s, s + len(v) AS e FROM {kind}")
    width = secret_scan.WINDOW
    for rank, (kind, pattern, _, must, limit) in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        holds = " AND ".join(f"regexp_matches(v, '{m}')" for m in must)
        parts.append(_places_sql(kind, pattern, 0, width))
        parts.append(f"""{kind}_w AS (
  SELECT rid, s, v, unnest(range(0, len(v) - {width - 1})) AS k FROM {kind}
  WHERE {holds} AND NOT regexp_matches(v, '{secret_scan.ALLOWED}')
), {kind}_h AS (
  SELECT rid, s, k FROM (
    SELECT rid, s, k, c, count(*) AS n FROM (SELECT rid, s, k, unnest(string_split(substr(v, k + 1, {width}), '')) AS c FROM {kind}_w)
    GROUP BY ALL
  ) GROUP BY rid, s, k HAVING log2({width}) - sum(n * log2(n)) / {width} >= {limit}
), {kind}_r AS (
  SELECT rid, s, k, sum(fresh) OVER (PARTITION BY rid, s ORDER BY k) AS run FROM (
    SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY rid, s ORDER BY k) <= {width} THEN 0 ELSE 1 END AS fresh FROM {kind}_h)
)""")
        spans.append(f"SELECT rid, {rank}, '{kind}', s + min(k), s + max(k) + {width} FROM {kind}_r GROUP BY rid, s, run")
    one, order = "kind || ':' || s || ':' || e", "ORDER BY s, rank, e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in secret_scan.BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(parts)},
spans AS ({" UNION ALL ".join(spans)})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' {order}) FILTER (rank < {len(secret_scan.BASE)}), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' {order}), '') AS spans
FROM t LEFT JOIN spans ON t.rid = spans.rid GROUP BY t.rid, doc_id
"""


def _places_sql(name: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, m[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g,
        string_split_regex(text, '{quoted}') AS gaps FROM t)
  ) WHERE len(g[i]) >= {least}
)"""


SQL["op4_secret_scan"] = _secret_sql()



def _license_sql() -> str:
    """The same votes with k words as text instead of hashes."""
    rows, furthest = [], 0
    for i, t in enumerate(license_scan.PHRASES + license_scan.NOTICES):
        words = re.findall("[a-z0-9]+", t.text.lower())
        k = license_scan.SHORT if t.phrase else license_scan.LONG
        grams = [" ".join(words[p : p + k]) for p in range(len(words) - k + 1)]
        reach = license_scan.reach(t, len(words))
        rows += [f"({i}, '{t.label}', {t.phrase}, {reach}, {len(grams)}, {p}, '{g}')" for p, g in enumerate(grams)]
        furthest = max(furthest, reach)
    each = " UNION ALL ".join(
        f"SELECT rid, {phrase} AS phrase, i, array_to_string(w[i + 1:i + {k}], ' ') AS gram "
        f"FROM (SELECT rid, w, unnest(range(0, len(w) - {k - 1})) AS i FROM t)"
        for phrase, k in ((True, license_scan.SHORT), (False, license_scan.LONG))
    )
    upper, lower = url_filter.UPPER, url_filter.LOWER
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), k(template, label, phrase, reach, keys, p, gram) AS (VALUES {", ".join(rows)}), g AS ({each}),
votes AS (
  SELECT g.rid, k.template, k.label, k.phrase, k.reach, k.keys, g.i - k.p AS diagonal, list(DISTINCT k.p) AS met
  FROM g JOIN k ON g.gram = k.gram AND g.phrase = k.phrase GROUP BY ALL
), f AS (
  SELECT *, CASE WHEN NOT phrase AND diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {license_scan.GAP}
    THEN 0 ELSE 1 END AS fresh,
    list({{'d': diagonal, 'met': met}}) OVER (PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {furthest} FOLLOWING) AS ahead
  FROM votes
), m AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span,
    len(list_distinct(flatten(list_transform(list_filter(ahead, lambda v: v.d <= diagonal + reach), lambda v: v.met)))) AS n FROM f
), spans AS (
  SELECT rid, label, phrase, max(n) / keys AS covered, min(diagonal + list_min(met)) AS first
  FROM m GROUP BY rid, template, label, phrase, keys, span
), ok AS (SELECT * FROM spans WHERE covered >= CASE WHEN phrase THEN 1.0 ELSE {license_scan.COVERED} END)
SELECT doc_id, len(w) AS n_words, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word,
  max(first) FILTER (phrase) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0.0) AS score
FROM t LEFT JOIN ok ON t.rid = ok.rid GROUP BY t.rid, doc_id, w
"""


SQL["op10_license_scan"] = _license_sql()

_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER
SQL["op1_url_filter"] = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_WEIGHTS = ", ".join(f"('{k}', {w!r})" for k, w in SOURCE_WEIGHTS.items())
SQL["op7_source_mix"] = f"""
WITH w(g, weight) AS (VALUES {_WEIGHTS}), d AS (
  SELECT *, CASE WHEN source IN (SELECT g FROM w WHERE g <> '{source_mix.OTHER}') THEN source ELSE '{source_mix.OTHER}' END AS g,
    coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), n AS (
  SELECT d.g, CAST(any_value(w.weight) AS DOUBLE) AS weight, count(*) AS size FROM d JOIN w ON d.g = w.g GROUP BY d.g
), rates AS (
  SELECT g, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate FROM n
), steps AS (
  SELECT g, rate, unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS i FROM rates
), cdf AS (
  SELECT g, list(p ORDER BY i) AS steps FROM (
    SELECT g, i, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM steps
  ) GROUP BY g
), drawn AS (
  SELECT d.*, len(list_filter(steps, lambda p: p < (CAST('0x' || substr(md5(k || ':mix'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS copies
  FROM d JOIN cdf ON d.g = cdf.g
), each AS (SELECT *, unnest(range(copies)) AS mix_copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, mix_copy, md5(k || ':' || mix_copy || ':mix') AS mix_key FROM each
"""

SQL["op6_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + length('<|turn|>') + 1 + length('<|end|>') + 1
    + 2 * len(regexp_extract_all(text, '%|<\||</?s>|\[/?INST\]')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
