"""Queries over the tables of a folder, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bytesops as b
from .operators import block_index, chunking, codec, controls, cover, patchfile, synth
from .plans import deltas
from .schema import DiffOptions
from .sources import versions

BLOCK, CHUNK = 32, 512
INSERTED = b"<edit>"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id and old: each document's bytes."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("pair_id"), b.text_bytes(F.col("text")).alias("old"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.edited_documents(table(spark, sf_dir, "documents"), INSERTED)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.conversation_history(table(spark, sf_dir, "conversations"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.successive_turns(table(spark, sf_dir, "conversations"))


# The same pairs in SQL, bytes as hexadecimal digits.
DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, hex(encode(text)) AS o, len(hex(encode(text))) // 2 AS size FROM documents)"
EDITS = f"""{DOCS}, e AS (
  SELECT pair_id, o, substr(o, 1, 2 * (size // 2)) || '{INSERTED.hex().upper()}' || substr(o, 2 * (size // 2) + 1) AS n FROM d
)"""
HISTORY = """h AS (
  SELECT conv_id || ':' || turn AS pair_id,
    coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ot,
    string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nt
  FROM conversations
), p AS (SELECT pair_id, nt, hex(encode(ot)) AS o, hex(encode(nt)) AS n FROM h)"""
TURNS = """t AS (
  SELECT conv_id || ':' || turn AS pair_id, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ot, text AS nt FROM conversations
), p AS (SELECT pair_id, hex(encode(ot)) AS o, hex(encode(nt)) AS n FROM t WHERE ot IS NOT NULL AND nt IS NOT NULL)"""
INDEX = f"""x AS (
  SELECT pair_id, substr(o, 2 * b0 + 1, {2 * BLOCK}) AS block, min(b0) AS old_off
  FROM (SELECT pair_id, o, unnest(range(0, len(o) // 2 - {BLOCK - 1}, {BLOCK})) AS b0 FROM p) GROUP BY ALL
)"""
PROBES = f"q AS (SELECT pair_id, n, unnest(range(0, len(n) // 2 - {BLOCK - 1})) AS pos FROM p)"
HITS = f"""hits AS (
  SELECT q.pair_id, q.pos, x.old_off FROM q JOIN x ON q.pair_id = x.pair_id AND substr(q.n, 2 * q.pos + 1, {2 * BLOCK}) = x.block
)"""
COVER = f"""
r1 AS (SELECT *, old_off - pos AS diagonal, lag(pos) OVER (PARTITION BY pair_id, old_off - pos ORDER BY pos) AS prev FROM hits),
r2 AS (SELECT *, sum(CASE WHEN pos - prev <= {BLOCK} THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id, diagonal ORDER BY pos) AS run FROM r1),
runs AS (
  SELECT pair_id, min(pos) AS pos, max(pos) - min(pos) + {BLOCK} AS len, min(old_off) AS old_off FROM r2 GROUP BY pair_id, diagonal, run
),
nexts AS (
  SELECT a.*, b.pos AS after FROM runs AS a ASOF LEFT JOIN runs AS b ON a.pair_id = b.pair_id AND a.pos + a.len <= b.pos
),
taken AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS i FROM nexts) WHERE i = 1
  UNION ALL
  SELECT m.pair_id, m.pos, m.len, m.old_off, m.after, t.i + 1
  FROM taken AS t JOIN nexts AS m ON m.pair_id = t.pair_id AND m.pos = t.after
)"""
CONTROLS = f"""
lead_in AS (
  SELECT pair_id, 0 AS pos, 0 AS len, 0 AS old_off FROM p WHERE len(n) > 0
  UNION ALL SELECT pair_id, pos, len, old_off FROM taken
), m AS (
  SELECT l.*, row_number() OVER w - 1 AS seq, coalesce(lead(l.pos) OVER w, len(p.n) // 2) AS copy_end,
    coalesce(lead(l.old_off) OVER w - l.old_off - l.len, 0) AS seek
  FROM lead_in AS l JOIN p ON l.pair_id = p.pair_id WINDOW w AS (PARTITION BY l.pair_id ORDER BY l.pos, l.len)
)"""
DIGIT = "(strpos('0123456789ABCDEF', substr({0}, 2 * i + {1}, 1)) - 1)"


def byte_at(h: str) -> str:
    return f"(16 * {DIGIT.format(h, 1)} + {DIGIT.format(h, 2)})"


@query(f"""WITH {DOCS}, c AS (SELECT *, unnest(range(0, greatest(1, (size + {CHUNK - 1}) // {CHUNK}))) AS i FROM d)
SELECT pair_id, CAST(i AS INTEGER) AS chunk_idx, i * {CHUNK} AS new_start, least({CHUNK}, size - i * {CHUNK}) AS new_len,
  md5(substr(o, 2 * i * {CHUNK} + 1, {2 * CHUNK})) AS digest FROM c""")
def chunks_fixed(spark, sf_dir):
    """[F1, D2]"""
    made = chunking.chunks(documents(spark, sf_dir), CHUNK, "old")
    return made.withColumn("digest", F.md5(F.hex("bytes"))).drop("bytes")


@query(f"WITH {DOCS} SELECT pair_id, greatest(1, (size + {CHUNK - 1}) // {CHUNK}) AS n_chunks FROM d")
def chunk_count(spark, sf_dir):
    """[F1, M7]"""
    length = F.length("old").cast("long")
    return documents(spark, sf_dir).select("pair_id", chunking.chunk_count(length, CHUNK).alias("n_chunks"))


@query(f"""WITH {DOCS} SELECT pair_id, b0 AS old_off, substr(o, 2 * b0 + 1, {2 * BLOCK}) AS block
FROM (SELECT *, unnest(range(0, size - {BLOCK - 1}, {BLOCK})) AS b0 FROM d)""")
def blocks_aligned(spark, sf_dir):
    """[X1]"""
    return block_index.aligned_blocks(documents(spark, sf_dir), BLOCK).withColumn("block", F.hex("block"))


_DOC_INDEX = f"WITH {DOCS}, p AS (SELECT * FROM d), {INDEX} SELECT pair_id, block, old_off FROM x"


@query(_DOC_INDEX)
def block_index_min(spark, sf_dir):
    """[X3, D3, D4]"""
    return block_index.block_index(documents(spark, sf_dir), BLOCK).withColumn("block", F.hex("block"))


@query(f"""WITH {DOCS} SELECT pair_id, substr(o, 2 * b0 + 1, {2 * BLOCK}) AS block, count(*) AS n, min(b0) AS old_off
FROM (SELECT *, unnest(range(0, size - {BLOCK - 1}, {BLOCK})) AS b0 FROM d) GROUP BY ALL HAVING count(*) > 1""")
def block_dup_groups(spark, sf_dir):
    """[X3]"""
    blocks = block_index.aligned_blocks(documents(spark, sf_dir), BLOCK)
    groups = blocks.groupBy("pair_id", "block").agg(F.count("*").alias("n"), F.min("old_off").alias("old_off"))
    return groups.where("n > 1").withColumn("block", F.hex("block"))


@query(f"""WITH {DOCS}, g AS (SELECT pair_id, size AS length, size // {BLOCK} AS entries FROM d), k AS (
  SELECT *, CAST(CASE WHEN entries < 1 THEN 1 ELSE greatest(1, 2 ** CAST(ceil(log2(ceil(2 * entries / 8))) AS INTEGER)) END AS BIGINT) AS buckets FROM g)
SELECT pair_id, length, entries, buckets, 8 * buckets AS slots, 64 * buckets AS table_bytes FROM k""")
def index_geometry(spark, sf_dir):
    """[X4, M7]"""
    lengths = documents(spark, sf_dir).select("pair_id", F.length("old").cast("long").alias("length"))
    return block_index.index_geometry(lengths, BLOCK)


@query(f"WITH {HISTORY}, {INDEX}, {PROBES}, {HITS} SELECT pair_id, pos, old_off FROM hits")
def probe_hits(spark, sf_dir):
    """[X5, X6]"""
    return block_index.hits(chunking.spans(history(spark, sf_dir), None), BLOCK).select("pair_id", "pos", "old_off")


@query(f"""WITH {HISTORY}, {INDEX}, {PROBES} SELECT q.pair_id, count(*) AS n, min(q.pos) AS first, max(q.pos) AS last
FROM q ANTI JOIN x ON q.pair_id = x.pair_id AND substr(q.n, 2 * q.pos + 1, {2 * BLOCK}) = x.block GROUP BY q.pair_id""")
def probe_miss(spark, sf_dir):
    """[X5]"""
    missed = block_index.misses(chunking.spans(history(spark, sf_dir), None), BLOCK)
    return missed.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


_HOLDERS = f"""b AS (
  SELECT DISTINCT pair_id, substr(o, 2 * b0 + 1, {2 * BLOCK}) AS block
  FROM (SELECT *, unnest(range(0, size - {BLOCK - 1}, {BLOCK})) AS b0 FROM d)
), f AS (SELECT block, min(CAST(pair_id AS BIGINT)) AS first FROM b GROUP BY block HAVING count(*) > 1)"""


@query(f"WITH {DOCS}, {_HOLDERS} SELECT DISTINCT pair_id FROM b SEMI JOIN f ON b.block = f.block")
def docs_with_shared_block(spark, sf_dir):
    """Documents that share a block with another: a semi join."""
    held = block_index.block_index(documents(spark, sf_dir), BLOCK)
    shared = held.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    return held.join(shared, "block", "left_semi").select("pair_id").distinct()


@query(f"""WITH {DOCS}, {_HOLDERS} SELECT f.first AS base_id, CAST(b.pair_id AS BIGINT) AS doc_id, count(*) AS shared
FROM b JOIN f ON b.block = f.block WHERE CAST(b.pair_id AS BIGINT) <> f.first GROUP BY ALL HAVING count(*) >= 5""")
def near_copy_bases(spark, sf_dir):
    """Documents and bases for their deltas: five blocks are first held by the base.

    Blocks join with their first holder only, so a block of many documents gives as many
    rows, not as many as their pairs. [P1]
    """
    held = block_index.block_index(documents(spark, sf_dir), BLOCK)
    held = held.select("block", F.col("pair_id").cast("long").alias("doc_id"))
    firsts = held.groupBy("block").agg(F.min("doc_id").alias("base_id"), F.count("*").alias("n")).where("n > 1")
    of_base = held.join(firsts.drop("n"), "block").where("doc_id <> base_id")
    return of_base.groupBy("base_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 5")


@query(f"""WITH {DOCS}, b AS (
  SELECT DISTINCT CAST(pair_id AS BIGINT) AS doc_id, substr(o, 2 * b0 + 1, {2 * BLOCK}) AS block
  FROM (SELECT *, unnest(range(0, size - {BLOCK - 1}, {BLOCK})) AS b0 FROM d)
), s AS (
  SELECT x.doc_id, y.doc_id AS other FROM b AS x JOIN b AS y ON x.block = y.block AND x.doc_id <> y.doc_id
  GROUP BY ALL HAVING count(*) >= {versions.SHARED}
), k AS (SELECT doc_id, md5(string_agg(block, '' ORDER BY block)) AS blocks FROM b GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY blocks) AS class_id FROM k)
SELECT c.doc_id, c.class_id, count(*) AS links FROM c JOIN s ON c.doc_id = s.doc_id GROUP BY ALL""")
def near_copy_links(spark, sf_dir):
    """Documents that share five distinct aligned blocks with others: the number of those. [P1]"""
    held = block_index.block_index(documents(spark, sf_dir), BLOCK)
    return versions.near_copies(held.select(F.col("pair_id").cast("long").alias("doc_id"), "block"))


def _prefix(pairs: str) -> str:
    """Common prefix of a and b in bytes by pair_id: first the 64 bytes that differ, then the byte."""
    return f"""w AS (SELECT pair_id, a, b, unnest(range(0, least(len(a), len(b)) // 128 + 1)) AS j FROM {pairs}),
w1 AS (SELECT pair_id, substr(any_value(a), 128 * min(j) + 1, 128) AS a, substr(any_value(b), 128 * min(j) + 1, 128) AS b, min(j) AS j
  FROM w WHERE substr(a, 128 * j + 1, 128) <> substr(b, 128 * j + 1, 128) GROUP BY pair_id),
w2 AS (SELECT pair_id, a, b, j, unnest(range(0, least(len(a), len(b)) // 2 + 1)) AS i FROM w1),
w3 AS (SELECT pair_id, min(64 * j + i) AS first FROM w2 WHERE substr(a, 2 * i + 1, 2) <> substr(b, 2 * i + 1, 2) GROUP BY pair_id),
pre AS (SELECT {pairs}.pair_id, least(coalesce(w3.first, len(a) // 2), len(a) // 2, len(b) // 2) AS more
  FROM {pairs} LEFT JOIN w3 ON {pairs}.pair_id = w3.pair_id)"""


@query(f"WITH {EDITS}, k AS (SELECT pair_id, o AS a, n AS b FROM e), {_prefix('k')} SELECT pair_id, more AS common FROM pre")
def prefix_len_pairs(spark, sf_dir):
    """[X9, M2]"""
    return edits(spark, sf_dir).select("pair_id", b.common_prefix(F.col("old"), F.col("new")).alias("common"))


@query(f"""WITH {TURNS}, {INDEX}, k AS (
  SELECT p.pair_id, x.old_off, substr(p.o, 2 * (x.old_off + {BLOCK}) + 1) AS a, substr(p.n, {2 * BLOCK + 1}) AS b
  FROM p LEFT JOIN x ON p.pair_id = x.pair_id AND substr(p.n, 1, {2 * BLOCK}) = x.block
), {_prefix("k")}
SELECT k.pair_id, coalesce(k.old_off, 0) AS start, CASE WHEN k.old_off IS NULL THEN 0 ELSE {BLOCK} + pre.more END AS len
FROM k LEFT JOIN pre ON k.pair_id = pre.pair_id""")
def prefix_match(spark, sf_dir):
    """[X7, X8, D5]"""
    pairs = turns(spark, sf_dir)
    needles = pairs.select("pair_id", "old", F.col("new").alias("needle"))
    return block_index.prefix_match(needles, block_index.block_index(pairs, BLOCK), BLOCK)


_BYTES = f"{TURNS}, s AS (SELECT pair_id, o, n, unnest(range(0, least(len(o), len(n)) // 2)) AS i FROM p)"


@query(f"""WITH {_BYTES}, c AS (SELECT pair_id, count(*) FILTER (substr(o, 2 * i + 1, 2) = substr(n, 2 * i + 1, 2)) AS k FROM s GROUP BY pair_id)
SELECT p.pair_id, coalesce(c.k, 0) AS equal FROM p LEFT JOIN c ON p.pair_id = c.pair_id""")
def equal_bytes_count(spark, sf_dir):
    """[F12, M1]"""
    return turns(spark, sf_dir).select("pair_id", b.equal_bytes(F.col("old"), F.col("new")).alias("equal"))


@query(f"""WITH {_BYTES}, v AS (
  SELECT pair_id, string_agg(printf('%02X', ({byte_at("n")} - {byte_at("o")} + 256) % 256), '' ORDER BY i) AS x FROM s GROUP BY pair_id)
SELECT p.pair_id, md5(coalesce(v.x, '')) AS digest FROM p LEFT JOIN v ON p.pair_id = v.pair_id""")
def delta_bytes(spark, sf_dir):
    """[F9, M6]"""
    delta = b.wrapping_minus(F.col("new"), F.col("old"))
    return turns(spark, sf_dir).select("pair_id", F.md5(F.hex(delta)).alias("digest"))


@query(f"WITH {TURNS} SELECT pair_id, md5(substr(n, 1, least(len(o), len(n)))) AS digest FROM p")
def delta_inverse(spark, sf_dir):
    """[A2, M6]"""
    delta = b.wrapping_minus(F.col("new"), F.col("old"))
    back = turns(spark, sf_dir).select("pair_id", "old", delta.alias("delta"))
    return back.select("pair_id", F.md5(F.hex(b.wrapping_plus(F.col("delta"), F.col("old")))).alias("digest"))


_WITH_SAME = f"""{EDITS}, k AS (
  SELECT pair_id, o, n FROM e UNION ALL SELECT 'same:' || pair_id, o, o FROM d
), l AS (SELECT pair_id, o, n, least(len(o), len(n)) AS len FROM k WHERE len(n) > 0)"""


def _one_control(spark, sf_dir):
    """The control of a match of all of new with the start of old: edited and equal versions."""
    docs = documents(spark, sf_dir)
    equal = docs.select(F.concat(F.lit("same:"), "pair_id").alias("pair_id"), "old", F.col("old").alias("new"))
    pairs = edits(spark, sf_dir).unionByName(equal).where(F.length("new") > 0)
    length = F.least(F.length("old"), F.length("new")).cast("long")
    zero = F.lit(0).cast("long")
    whole = pairs.select(
        "pair_id",
        F.lit(0).alias("chunk_idx"),
        F.lit(0).alias("seq"),
        zero.alias("add_old_start"),
        zero.alias("add_new_start"),
        length.alias("add_length"),
        F.length("new").cast("long").alias("copy_end"),
        b.slice_bytes(F.col("old"), 0, length).alias("old_part"),
        F.col("new").alias("new_part"),
    )
    return controls.controls(whole)


@query(f"WITH {_WITH_SAME} SELECT pair_id, substr(n, 1, len) = substr(o, 1, len) AS same FROM l")
def zero_delta_flag(spark, sf_dir):
    """Whether a control's bytes to add are all 0. [C2]"""
    return _one_control(spark, sf_dir).select("pair_id", "same")


@query(f"WITH {_WITH_SAME} SELECT pair_id, substr(n, len + 1) AS literal FROM l")
def literal_slice(spark, sf_dir):
    """A control's literal bytes: new beyond the length of old. [F10]"""
    return _one_control(spark, sf_dir).select("pair_id", F.hex("copy").alias("literal"))


@query("""SELECT o_orderkey, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS code,
  greatest(1, CAST(ceil(len(bin(o_orderkey)) / 7) AS BIGINT)) AS bytes
FROM (SELECT o_orderkey, o_custkey - o_orderkey AS x FROM orders)""")
def zigzag_varint(spark, sf_dir):
    """[C3, C4]"""
    away = (F.col("o_custkey") - F.col("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", b.zigzag(away).alias("code"), b.varint_length(F.col("o_orderkey")).alias("bytes")
    )


def _covered(spark, sf_dir):
    pairs = history(spark, sf_dir)
    hits = block_index.hits(chunking.spans(pairs, None), BLOCK)
    return pairs, chunking.chunks(pairs, None), cover.greedy_cover(hits, BLOCK)


_COVERED = f"WITH RECURSIVE {HISTORY}, {INDEX}, {PROBES}, {HITS}, {COVER}"


@query(f"{_COVERED} SELECT pair_id, pos, len, old_off FROM taken")
def greedy_cover(spark, sf_dir):
    """[7.3]"""
    return _covered(spark, sf_dir)[2].drop("chunk_idx")


def _controls(spark, sf_dir):
    return controls.controls(cover.cover_matches(*_covered(spark, sf_dir)))


@query(f"{_COVERED}, {CONTROLS} SELECT pair_id, CAST(seq AS INTEGER) AS seq, CAST(seek AS BIGINT) AS seek FROM m")
def seek_lead(spark, sf_dir):
    """[F11]"""
    return _controls(spark, sf_dir).select("pair_id", "seq", "seek")


@query(f"""{_COVERED}, {CONTROLS} SELECT pair_id, CAST(seq AS INTEGER) AS seq, CAST(old_off AS BIGINT) AS old_pos FROM m""")
def old_cursor(spark, sf_dir):
    """Where each control reads old: a running sum of what was added and sought. [A6]"""
    order = Window.partitionBy("pair_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.sum(F.col("add_length") + F.col("seek")).over(order)
    return _controls(spark, sf_dir).select("pair_id", "seq", F.coalesce(moved, F.lit(0)).alias("old_pos"))


@query(f"""{_COVERED}, {CONTROLS}, z AS (
  SELECT pair_id, 2 * len + 1 AS a, 2 * (copy_end - pos - len) AS c, CASE WHEN seek >= 0 THEN 2 * seek ELSE -2 * seek - 1 END AS s FROM m)
SELECT pair_id, CAST(sum(greatest(1, ceil(len(bin(a)) / 7)) + greatest(1, ceil(len(bin(c)) / 7)) + c // 2 + greatest(1, ceil(len(bin(s)) / 7))) AS BIGINT) AS raw_len
FROM z GROUP BY pair_id""")
def control_sizes(spark, sf_dir):
    """Bytes of each control stream, from the encoder. [C1, C3, D8]"""
    codes = codec.encode_controls(_controls(spark, sf_dir))
    return codes.groupBy("pair_id").agg(F.sum(F.length("code")).alias("raw_len"))


@query(f"""WITH {HISTORY}
SELECT pair_id, (len(n) // 2 + {CHUNK - 1}) // {CHUNK} AS tiled, CAST(0 AS BIGINT) AS untiled FROM p WHERE len(n) > 0""")
def tiling_check(spark, sf_dir):
    """Chunks that the exact scan's matches tile, and others, by pair. [F5]"""
    pairs = history(spark, sf_dir)
    checked = cover.tiling(deltas.matches(pairs, DiffOptions(BLOCK, CHUNK)), chunking.chunks(pairs, CHUNK))
    return checked.groupBy("pair_id").agg(
        F.count_if("tiled").alias("tiled"), F.count_if(~F.col("tiled")).alias("untiled")
    )


@query(f"""WITH {HISTORY} SELECT pair_id, CAST(0 AS BIGINT) AS first, len(n) // 2 AS last, len(n) // 2 AS covered, CAST(0 AS BIGINT) AS gaps
FROM p WHERE len(n) > 0""")
def rebased_matches(spark, sf_dir):
    """Matches of chunks with offsets of the whole new version, which they cover without gaps. [F4]"""
    pairs = history(spark, sf_dir)
    found = deltas.rebased(deltas.matches(pairs, DiffOptions(BLOCK, CHUNK)), chunking.chunks(pairs, CHUNK))
    order = Window.partitionBy("pair_id").orderBy("chunk_idx", "seq")
    before = F.coalesce(F.lag("copy_end").over(order), F.lit(0))
    return found.withColumn("gap", (F.col("add_new_start") != before).cast("long")).groupBy("pair_id").agg(
        F.min("add_new_start").alias("first"),
        F.max("copy_end").alias("last"),
        F.sum(F.col("copy_end") - F.col("add_new_start")).alias("covered"),
        F.sum("gap").alias("gaps"),
    )


def _le(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(n))


@query(f"""WITH {HISTORY}, z AS (SELECT pair_id, len(n) // 2 AS size, greatest(1, (len(n) // 2 + {CHUNK - 1}) // {CHUNK}) AS k FROM p)
SELECT pair_id, 'DFB1000000200000' || {_le("size", 8)} || {_le("k", 4)} AS header FROM z""")
def patch_header(spark, sf_dir):
    """[IO4, D10]"""
    patches = deltas.diff(history(spark, sf_dir), DiffOptions(BLOCK, CHUNK))
    return patches.select("pair_id", F.hex(F.substring("patch", 1, 20)).alias("header"))


@query(f"""WITH {HISTORY}, c AS (SELECT pair_id, len(n) // 2 AS size, unnest(range(0, greatest(1, (len(n) // 2 + {CHUNK - 1}) // {CHUNK}))) AS i FROM p)
SELECT pair_id, CAST(i AS INTEGER) AS chunk_idx, size AS new_size, CAST(0 AS BIGINT) AS old_start, i * {CHUNK} AS new_start, least({CHUNK}, size - i * {CHUNK}) AS new_len FROM c""")
def patch_records(spark, sf_dir):
    """Records read back from assembled patches. [IO5, IO6, D9]"""
    parsed = patchfile.parse(deltas.diff(history(spark, sf_dir), DiffOptions(BLOCK, CHUNK)))
    return parsed.select("pair_id", "chunk_idx", "new_size", "old_start", "new_start", "new_len")


def _rebuilt(pairs: DataFrame, options: DiffOptions, mode: str) -> DataFrame:
    new = deltas.patch(deltas.diff(pairs, options, mode), pairs)
    return new.select("pair_id", F.length("new").cast("long").alias("new_len"), F.sha2("new", 256).alias("new_sha256"))


_HISTORY_NEW = f"WITH {HISTORY} SELECT pair_id, len(n) // 2 AS new_len, sha256(nt) AS new_sha256 FROM p"
_EDITS_NEW = f"WITH {EDITS} SELECT pair_id, len(n) // 2 AS new_len, sha256(unhex(n)) AS new_sha256 FROM e"


@query(_EDITS_NEW)
def roundtrip_exact(spark, sf_dir):
    """[F2-F5, F13, A1, V1]"""
    return _rebuilt(edits(spark, sf_dir), DiffOptions(BLOCK, None), "exact")


@query(_HISTORY_NEW)
def roundtrip_chunked(spark, sf_dir):
    """[F3, F6, A7]"""
    return _rebuilt(history(spark, sf_dir), DiffOptions(BLOCK, CHUNK), "exact")


@query(_HISTORY_NEW)
def roundtrip_relational(spark, sf_dir):
    """[7.3, F13, A1]"""
    return _rebuilt(history(spark, sf_dir), DiffOptions(BLOCK, None), "relational")


@query(f"WITH {DOCS} SELECT pair_id, size AS new_len, md5(o) AS digest FROM d")
def copy_from_old_decode(spark, sf_dir):
    """A stream that copies all from old, which the writer never makes. [A5]"""
    olds = documents(spark, sf_dir)
    chunks = chunking.chunks(olds, None, "old")
    one = chunks.select(
        "pair_id",
        "chunk_idx",
        F.lit(0).alias("seq"),
        F.lit(0).cast("long").alias("add_length"),
        F.lit(True).alias("same"),
        F.lit(b"").alias("add"),
        F.col("bytes").alias("copy"),
        F.lit(0).cast("long").alias("seek"),
        F.lit(0).cast("long").alias("copy_from"),
    )
    records = codec.compress_chunks(chunks, codec.encode_controls(one), 3)
    new = codec.apply_chunks(records, olds)
    return new.select("pair_id", F.length("bytes").cast("long").alias("new_len"), F.md5(F.hex("bytes")).alias("digest"))


@query(f"""WITH {DOCS}, a AS (
  SELECT pair_id, CASE WHEN size > 1 THEN substr(o, 3, 2) || substr(o, 1, 2) || substr(o, 5) ELSE o END AS o, size, 5 % size AS k FROM d WHERE size > 0)
SELECT pair_id, md5(o || substr(o, 2 * k + 1, 80) || '4141') AS digest FROM a""")
def edit_script_apply(spark, sf_dir):
    """[V7, D15] Swap the first two bytes, repeat 40 from the sixth on, append two; not of empty versions."""
    script = F.lit(bytes([150, 0, 5, 40, 130, 65]))
    old = documents(spark, sf_dir).where(F.length("old") > 0)
    return old.select("pair_id", F.md5(F.hex(synth.scripted(F.col("old"), script))).alias("digest"))


@query(f"WITH {HISTORY} SELECT pair_id, len(n) // 2 AS new_size, true AS ok FROM p")
def cycle_ok(spark, sf_dir):
    """[V2, D14]"""
    return deltas.cycle(history(spark, sf_dir), DiffOptions(BLOCK)).select("pair_id", "new_size", "ok")


@query(f"""WITH {DOCS}, k AS (
  SELECT pair_id, size * f AS size FROM d, (VALUES (1), (64), (4096)) AS t(f)
)
SELECT pair_id, size, CASE WHEN size >= 1048576 THEN printf('%.1f MiB', size / 1048576) WHEN size >= 1024 THEN printf('%.0f KiB', size / 1024)
    ELSE printf('%d B', size) END AS coarse,
  CASE WHEN size > 1048576 THEN printf('%.2f MiB', size / 1048576) WHEN size > 1024 THEN printf('%.1f KiB', size / 1024)
    ELSE printf('%d B', size) END AS fine FROM k""")
def format_size_doc(spark, sf_dir):
    """[M8, M9] Sizes as they are, 64 and 4096 times as large."""
    sizes = F.array(*[F.length("old").cast("long") * f for f in (1, 64, 4096)])
    each = documents(spark, sf_dir).select("pair_id", F.explode(sizes).alias("size"))
    return each.select(
        "pair_id", "size", b.format_size(F.col("size")).alias("coarse"), b.format_size_fine(F.col("size")).alias("fine")
    )


@query()
def match_stats_exact(spark, sf_dir):
    """Matches and their bytes by pair. [F2]"""
    found = deltas.matches(history(spark, sf_dir), DiffOptions(BLOCK, None))
    return found.groupBy("pair_id").agg(
        F.count("*").alias("n_matches"),
        F.sum("add_length").alias("added"),
        F.sum(F.col("copy_end") - F.col("add_new_start") - F.col("add_length")).alias("literal"),
    )


@query()
def patch_size_exact(spark, sf_dir):
    """[V3]"""
    sizes = deltas.cycle(history(spark, sf_dir), DiffOptions(BLOCK))
    return sizes.select("pair_id", "new_size", "patch_size", "ratio")
