"""The operators against plain code, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import (
    _common,
    ann,
    chat_format,
    license_scan,
    order_minhash,
    piece_codec,
    queries,
    secret_scan,
    source_mix,
    topk,
    toxicity,
    url_filter,
)
from deltaloom.llm._words import word_hashes

LOWER = str.maketrans(url_filter.UPPER, url_filter.LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and repeated rows, and a column whose name the operators use themselves.
ODD = [(None, "only text"), (1, None), (2, ""), (3, "  "), (4, "same words here"), (4, "same words here"), (5, "é" * 5000)]


def rows_of(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *[F.lit(0).alias(c) for c in ("id", "key", "row", "spans", "hash", "score", "label", "ids")])


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, small, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, small).collect()]
    assert rows_of(got) == rows_of(duck(queries.SQL[name]))


# 1


def test_urls(spark):
    rules = [("com", "/", "block"), ("b.com", "/x", "allow"), ("b.com", "/x/y", "block"), ("a.b.com", "/", "allow"), ("b-c.com", "/", "allow"), (None, "/", "block"), ("d.com", "/xyz", "block"), ("a.d.com", "/x", "allow")]
    urls = ["https://b.com/x", "https://q.B.com/x/yz", "https://a.b.com/x/y", "http://xb.com/x", "http://b-c.com/", "http://b.com", "com/", None, "x://", "http://d..com/?a", "http://a.b.com:80/x", "http://a.d.com/xyz"]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string, host string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [r for r in rules if r[0] and ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    of_rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    for parts in (2, 1000):
        got = url_filter.filter_urls(pages, of_rules, parts=parts).collect()
        assert sorted(r.page_id for r in got) == list(range(2 * len(urls)))
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), r
    assert url_filter.filter_urls(pages.limit(0), of_rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, of_rules.limit(0)).collect()} == {"allow"}


# 2


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return piece_codec.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(spark, vocabulary, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder, decoder = piece_codec.Encoder(vocabulary), piece_codec.Decoder(vocabulary)
    rng = np.random.default_rng(1)
    signs = list("ab cdeéth  ▁\n\t.,12²m.()[]<>/s_-'中😀İ\x00")
    pieces = [p.replace("▁", " ") for p in vocabulary.pieces[300:]]
    made = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)]
    made += ["".join(rng.choice(pieces, rng.integers(0, 8))) for _ in range(3000)] + ["a" * 20000, *texts.values()]
    for text in made:
        ids = np.frombuffer(encoder.text(text), np.int32).tolist()
        assert ids == library.encode(text), text
        assert decoder.ids([*ids, 2]) == library.decode([*ids, 2])
    for _ in range(3000):
        ids = [int(i) for i in rng.choice([0, 1, 2, *range(3, 259), 29871, *range(1000, 1100)], rng.integers(0, 7))]
        assert decoder.ids(ids) == library.decode(ids), ids
    rows = queries.op2_piece_codec(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    coded = piece_codec.decode_texts(piece_codec.encode_texts(odd(spark), vocabulary), vocabulary).collect()
    assert Counter((r.doc_id, r.text) for r in coded) == Counter((i, t or "") for i, t in ODD)
    assert all(r.ids[-1] == 2 for r in coded)
    assert piece_codec.encode_texts(odd(spark).limit(0), vocabulary).count() == 0


# 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, op = rng.integers(0, len(words) + 1), rng.integers(0, 3)
        if op == 0 or at == len(words):
            words.insert(at, rng.integers(0, 6))
        elif op == 1:
            words.pop(at)
        else:
            words[at] = rng.integers(0, 6)
    return words


def test_banded_alignment():
    rng = np.random.default_rng(3)
    pairs, wanted = [], []
    for _ in range(1500):
        a = list(rng.integers(0, 6, rng.integers(0, 25)))
        b = changed(rng, a, rng.integers(0, 9))
        limit = int(rng.integers(0, 10))
        pairs.append((np.array(a, np.int32), np.array(b, np.int32), limit))
        wanted.append(distance(a, b) <= limit)
    assert order_minhash.within(pairs).tolist() == wanted


def test_near_duplicates_are_the_classes_of_all_pairs(spark, small, texts):
    words = {}
    for i, t in texts.items():
        ((_, _, w),) = word_hashes(pa.array([t]))
        words[i] = (w >> np.uint64(33)).astype(np.int32)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted(texts, key=lambda i: len(words[i]))
    for n, a in enumerate(by_size):
        for b in by_size[n + 1 :]:
            limit = int(0.2 * len(words[b]) + 1e-9)
            if len(words[b]) - len(words[a]) > limit:
                break
            if len(words[a]) and order_minhash.within([(words[a], words[b], limit)])[0]:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in queries.op3_order_minhash(spark, small).collect()}
    assert got == {i: root(i) for i in texts}


def test_near_duplicates_of_groups_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in changed(rng, [j * 7 % 101 for j in range(120)], 3))) for i in range(10, 60)]
    rows += [(100 + i, f"a text of its own {i} " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60))) for i in range(20)]
    rows += [(200, "short one"), (201, "short one"), (202, "Short, one!"), (203, "short two")] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit(2))
    got = Counter((r.doc_id, r.class_id) for r in order_minhash.classes(df).collect())
    assert sum(got.values()) == len(rows)
    assert all((i, 10) in got for i in range(10, 60))
    assert all((100 + i, 100 + i) in got for i in range(20))
    assert {(200, 200), (201, 200), (202, 200), (203, 203), (1, 1), (2, 2), (3, 3), (None, None), (5, 5)} <= set(got)
    kept = order_minhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([10, 200, 203, None, 1, 2, 3, 4, 5, *range(100, 120)])
    assert order_minhash.classes(df.limit(0)).count() == 0


def test_near_duplicates_of_texts_of_one_id(spark):
    """Texts are judged by themselves: a copy of another row takes nothing else of its id along."""
    rng = np.random.default_rng(14)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(4)]
    rows = [(3, own[0]), (4, own[1]), (4, own[0]), (4, own[2]), (9, own[2] + " more"), (4, own[1]), (5, own[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = order_minhash.classes(df).collect()
    assert len(found) == len(rows) and len({r.class_id for r in found}) == 4
    by_id = Counter((r.doc_id, r.class_id) for r in found)
    assert by_id[3, 3] == 1 and by_id[4, 3] == 1 and by_id[5, 5] == 1
    kept = Counter(map(tuple, order_minhash.deduplicate(df).collect()))
    assert kept[3, own[0]] == kept[4, own[1]] == kept[5, own[3]] == 1 and sum(kept.values()) == 4
    assert (4, own[2]) in kept or (9, own[2] + " more") in kept


def test_near_duplicates_far_from_their_pivots(spark):
    """Texts of large buckets that are like some of a group but not like its least one."""
    rng = np.random.default_rng(15)
    passage, words = list(range(60)), list(range(1000, 1140))
    rows = {}
    for i in range(150):
        rows[i] = passage + [int(x) for x in rng.integers(10**4, 10**6, 140)]
    for i in range(100):  # each with some edits of its own
        rows[1000 + i] = passage + [int(rng.integers(10**6, 10**7)) if rng.random() < 0.08 else w for w in words]
    far = [x if j % 4 else 5 * 10**7 + j for j, x in enumerate(rows[1050][60:])]
    rows[3000] = passage + far  # 35 of 200 words from one of the group, more from the others
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    alike = {i: np.array(w, np.int32) for i, w in rows.items()}

    def like(i, j):
        return order_minhash.within([(alike[i], alike[j], int(0.2 * max(len(alike[i]), len(alike[j])) + 1e-9))])[0]

    assert like(3000, 1050) and got[3000] == 1000
    assert all(got[i] == i for i in range(150)) and all(got[1000 + i] == 1000 for i in range(100))


def test_marks_tell_long_texts_apart_before_they_are_aligned(spark, monkeypatch):
    """Long texts that share a passage and their commonest words are in one bucket, and no pair of them is aligned."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(60):
        words = rng.zipf(1.15, 2000) % 5000
        rows.append((i, " ".join(f"w{x}" for x in [*range(10**6, 10**6 + 400), *words])))
    rows += [(1000 + i, rows[i][1].replace("w1 ", "v1 ", 300)) for i in (3, 50)]
    tested, aligned = [], order_minhash._aligned

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return aligned(pairs, *rest)

    monkeypatch.setattr(order_minhash, "_aligned", counted)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert sum(tested[1:]) <= 2


def test_a_pair_is_given_by_one_of_its_large_buckets(spark, monkeypatch):
    """Texts of one passage, each with 14 of its 100 words changed, share several large buckets."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in rng.choice(100, 14, replace=False):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given, was = [], order_minhash._nearest

    def counted(members, marks, similarity):
        blocks = order_minhash._in_marked_blocks(members, marks).toArrow()
        for bucket in set(blocks["bucket"].to_pylist()):
            own = blocks.take([i for i, x in enumerate(blocks["bucket"].to_pylist()) if x == bucket])
            told = order_minhash._first_meeting(own)
            nodes, ups = own["node"].to_pylist(), own["up"].to_pylist()
            i, j = np.triu_indices(len(nodes), 1)
            met = np.array([not (ups[x] and ups[y]) for x, y in zip(i, j, strict=True)], dtype=bool)
            i, j = i[met], j[met]
            large = own["large"].is_valid().to_pylist()[0]
            first = told(i, j)
            given.extend((large, frozenset((nodes[x], nodes[y])), bool(f)) for x, y, f in zip(i, j, first, strict=True))
        return was(members, marks, similarity)

    monkeypatch.setattr(order_minhash, "_nearest", counted)
    monkeypatch.setattr(order_minhash, "LARGE", 8)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert [got[i] for i in (100, 101, 102)] == [got[0]] * 3
    met = Counter(pair for large, pair, _ in given if large)
    once = Counter(pair for large, pair, first in given if large and first)
    assert max(met.values()) > 2
    assert once.keys() == met.keys() and set(once.values()) == {1}
    assert all(first for large, _, first in given if not large)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_marks_differ_by_two_for_each_edit_at_most():
    rng = np.random.default_rng(18)
    for n in (0, 5, 60, 700, 30000):
        a = [int(x) for x in rng.integers(0, 300, n)]
        b = changed(rng, a, n // 9)
        hashes = [np.array([hash(f"{x}") & (2**63 - 1) for x in w], np.uint64) for w in (a, b)]
        marks = order_minhash._marks(np.concatenate(hashes), np.array([len(a), len(b)]))
        own = [np.array(m, np.int64).view(np.uint64) for m in marks.to_pylist()]
        alone = order_minhash._marks(hashes[1], np.array([len(b)]))
        assert alone.to_pylist()[0] == marks.to_pylist()[1]
        w = min(map(len, own))
        x, y = (np.bitwise_xor.reduce(m.reshape(-1, w), axis=0) for m in own)
        assert int(np.bitwise_count(x ^ y).sum()) + abs(len(a) - len(b)) <= 2 * (n // 9)


def test_settled_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(_common, "shared_folder", lambda _: str(tmp_path))
        kept = _common.settle(spark.range(3))
        assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1 and kept.count() == 3
        _common.discard(kept)
        assert not [p for p in tmp_path.iterdir() if p.is_dir()]

    class Elsewhere:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="share"):
        _common.shared_folder(Elsewhere)


def test_near_duplicates_of_a_large_mixed_bucket(spark, monkeypatch):
    """Pairs in a bucket of texts that share a passage only, which is all that they share."""
    rng = np.random.default_rng(11)
    passage = list(range(120))
    rows, sketch = {}, order_minhash.Sketch(sampled=1, components=1, dense=0)
    for i in range(200):
        words = passage + list(rng.integers(10**3, 10**6, 60))
        rows[i] = words
        rows[1000 + i] = words[:120] + [int(rng.integers(10**3, 10**6)) if j % 4 == 1 else w for j, w in enumerate(words[120:])]
    docs = [(i, " ".join(f"w{x}" for x in w)) for i, w in rows.items()]
    sketches = {}
    for i, t in docs:
        ((_, _, w),) = word_hashes(pa.array([t]))
        sketches[i] = order_minhash.order_minhash(w, sketch)[0]
    alike = [i for i in range(200) if sketches[i] == sketches[1000 + i]]
    mixed, n = Counter(sketches.values()).most_common(1)[0]
    assert n > 130 and sum(sketches[i] == mixed for i in alike) > 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (order_minhash.BLOCK, 50):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        got = {r.doc_id: r.class_id for r in order_minhash.classes(df, sketch).collect()}
        assert got == {i: i - 1000 if i - 1000 in alike else i for i in rows}


def test_near_duplicates_at_the_limit_of_edits(spark):
    """Scattered edits in a fifth of the words, and one or two in short texts."""
    rng = np.random.default_rng(12)
    rows = {}
    for i in range(240):
        n = int(rng.integers(5, 15)) if i % 2 else int(rng.integers(15, 300))
        words = [int(x) for x in rng.integers(0, 10**6, n)]
        rows[i] = words
        other = list(words)
        for at in rng.choice(n, int(0.2 * n + 1e-9), replace=False):
            other[at] = int(rng.integers(10**6, 2 * 10**6))
        rows[1000 + i] = other
    rows[5000], rows[5001] = [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    missed = {i for i in range(240) if got[1000 + i] != i}
    assert not {i for i in missed if len(rows[i]) < 15} and len(missed) <= 1
    assert got[5001] == 5000


# 4

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def entropy_spans(text):
    found = []
    for rank, (kind, pattern, _, must, limit) in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(pattern, text):
            value, runs = m[0], []
            if len(value) < secret_scan.WINDOW or not all(re.search(x, value) for x in must) or re.search(secret_scan.ALLOWED, value):
                continue
            for i in range(len(value) - secret_scan.WINDOW + 1):
                p = np.array(list(Counter(value[i : i + secret_scan.WINDOW]).values())) / secret_scan.WINDOW
                if -(p * np.log2(p)).sum() >= limit:
                    if runs and runs[-1][1] >= i:
                        runs[-1][1] = i + secret_scan.WINDOW
                    else:
                        runs.append([i, i + secret_scan.WINDOW])
            found += [(m.start() + a, rank, m.start() + b, kind) for a, b in runs]
    return found


def test_secrets(spark, texts):
    rng = np.random.default_rng(6)
    made = list(texts.values()) + [
        "token=secret:abcdefgh1 é password = 'hunter22hunter' x",
        "😀 API_KEY:  \"aaaa.bbbb=\" apikey=short passwd:==12345678",
        "AKIA" + "A1" * 8 + " AKIASHORT AKIAAKIA12345678",
        "f" * 31 + " " + "0f" * 16 + "G" + "ab" * 40,
        "example_Key1" * 4 + " 123e4567-e89b-12d3-a456-426614174000",
    ]
    made += ["".join(rng.choice(list("abcDEF0189+/_ ="), 200)) for _ in range(60)]
    made += ["".join(rng.choice(list("abcdefghijkXYZRSTUVW0123456789"), 400)) + "a" * 100 for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(made)] + [(-1, None), (-2, ""), (0, made[0]), (0, made[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = secret_scan.scan_secrets(df).collect()
    assert len(found) == len(rows)
    some = 0
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        spans = [(s.start, s["rank"], s.end, s.kind) for s in r.spans]
        assert spans == sorted(base_spans(text) + entropy_spans(text)), text[:300]
        some += any(s[1] > 2 for s in spans)
    assert some > 5
    marked = df.select(secret_scan.redact(F.col("text"), secret_scan.secret_spans(F.col("text"))).alias("t"), "text").collect()
    for r in marked:
        if r.text and "hunter22" in r.text:
            assert r.t == "token=secret:abcdefgh1 é [SECRET]' x"
    assert {r.t for r in marked if not r.text} == {None, ""}


# 5


def test_toxicity_on_held_out_texts(spark):
    rng = np.random.default_rng(7)
    common, bad = [f"{a}{b}" for a in ("tha", "ere", "ion") for b in ("nt", "sh", "le", "ou")], ["idiot", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, rng.integers(5, 200)))
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.integers(0, len(words)), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(None, "x"), (1001, None), (1002, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (700, 1), (4, 2)], "doc_id long, toxic int")
    got = toxicity.classify(docs.withColumn("score", F.lit("clash")), marks).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert {r.predicted for r in toxicity.classify(docs, marks.limit(0)).collect()} == {1}
    assert toxicity.classify(docs.limit(0), marks).count() == 0


def plain_ngrams(text):
    """Hashed n-grams one by one, in Python's own numbers."""
    codes = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
    found, low = set(), 2**32 - 1
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = codes[i] * 0x9E3779B1 & low
            for c in codes[i + 1 : i + n]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + c) & low
            found.add(((h ^ h >> 16) * 0xC2B2AE35 & low) >> 32 - toxicity.BITS)
    return found


def test_scores_are_those_of_plain_code(spark):
    """Counts, ratios and each step of the regression over a dense table of all features."""
    rng = np.random.default_rng(16)
    words = ["some", "other", "words", "here", "dumb", "fool", "é😀"]
    texts = {i: " ".join(rng.choice(words[:4] + words[4:] * (i % 2), rng.integers(1, 9))) for i in range(40)}
    fit = toxicity.Fit(steps=12, least_texts=2, least_ratio=0.3)
    used = [i for i in texts if i < 30 and zlib.crc32(str(i).encode()) % 5]
    y = np.array([i % 2 for i in used], dtype=float)
    grams = {i: plain_ngrams(t) for i, t in texts.items()}
    features = sorted(set().union(*[grams[i] for i in used]))
    x = np.array([[float(f in grams[i]) for f in features] for i in used])
    p, q = (x[y == 1].sum(axis=0), x[y == 0].sum(axis=0))
    r = np.log((p + 1) / (y.sum() + 1)) - np.log((q + 1) / ((1 - y).sum() + 1))
    keep = (p + q >= 2) & (abs(r) >= 0.3)
    x, r = (x * r)[:, keep], r[keep]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w, bias, squares, bias_squares = np.zeros(len(r)), 0.0, np.full(len(r), 1e-8), 1e-8
    for _ in range(12):
        error = share * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        slope = x.T @ error + fit.penalty * w
        squares, bias_squares = squares + slope**2, bias_squares + error.sum() ** 2
        w, bias = w - 0.1 * slope / np.sqrt(squares), bias - 0.1 * error.sum() / np.sqrt(bias_squares)
    weight = dict(zip(np.array(features)[keep].tolist(), (w * r).tolist(), strict=True))
    texts |= {100: texts[1] * 4000, 101: None}
    grams |= {100: plain_ngrams(texts[100]), 101: plain_ngrams("")}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels, fit).collect()
    assert len(got) == 43 and len(weight) > 30
    for row in got:
        total = bias + sum(weight.get(g, 0.0) for g in grams[row.doc_id])
        assert row.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_ngrams_of_slices_are_those_of_the_text(monkeypatch):
    text = "Some text, é 😀 again and again. " * 40
    whole = set(toxicity.ngrams(text))
    monkeypatch.setattr(toxicity, "_SLICE", 64)
    assert set(toxicity.ngrams(text)) == whole and len(whole) > 50


# 6


def test_typed_parts(spark):
    part = ("kind", "text", "ref", "width", "height", "seconds", "pages")
    rows = [
        (1, 1, "assistant", [("text", "<|turn|>%</s>", None, None, None, None, None), None]),
        (1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]),
        (1, 2, "us\ner<|end|>", [("document", None, "d.pdf", None, None, None, 3), ("hologram", None, "h", None, None, None, None)]),
        (None, None, None, None),
        (2, 5, "assistant", []),
    ]
    rows = [(*r[:3], r[3] and [p and dict(zip(part, p, strict=True)) for p in r[3]]) for r in rows]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}").withColumn("seq", F.lit("clash"))
    segments = chat_format.format_chats(df, F.col("parts"))
    by_place = {(r.conv_id, r.seq): r for r in segments.collect()}
    user = by_place[1, 0]
    assert user.segment == "<|turn|>user\nsee <|image|><|audio|><|end|>\n" and user.loss_start is None
    assert [(a.part, a.kind, a.ref, a.tokens) for a in user.attachments] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 38)]
    assert by_place[1, 2].first_attachment == 2
    assert [a.tokens for a in by_place[1, 2].attachments] == [1536, 0]
    whole = "".join(by_place[1, i].segment for i in range(3))
    said = by_place[1, 1]
    assert chat_format.unescape(whole[said.loss_start : said.loss_end]) == "<|turn|>%</s>"
    digests = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert digests[1].n_turns == 3 and digests[1].formatted_chars == len(whole)
    assert digests[1].loss_sha256 == hashlib.sha256(b"<|turn|>%</s>").hexdigest()
    assert digests[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and digests[2].loss_chars == 0
    assert chat_format.read_back(segments.limit(0)).count() == 0
    for text in ("%3C|", "<|turn|>", "[INST]%[/INST]</s><s>", "%%25"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)


# 7


def test_mixing(spark):
    rows = [(i, "t", "en", s, 1) for s, n in (("hot", 3000), ("cold", 300), (None, 100)) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).withColumn("mix_copy", F.lit("old"))
    weights = {"hot": 1.0, "cold": 1.0, "gone": 5.0}
    out = source_mix.mix_sources(df, weights, seed="a")
    got = Counter(r.source for r in out.collect())
    assert None not in got and abs(got["hot"] - got["cold"]) < 400 and abs(sum(got.values()) - 3400) < 400
    assert dict(out.dtypes)["mix_copy"] == "bigint"
    again = source_mix.mix_sources(df.repartition(3), weights, seed="a")
    assert Counter(map(tuple, out.drop("mix_copy").collect())) == Counter(map(tuple, again.drop("mix_copy").collect()))
    assert None in {r.source for r in source_mix.mix_sources(df, weights | {source_mix.OTHER: 1.0}).collect()}
    assert source_mix.mix_sources(df.limit(0), weights).count() == 0
    unknown = spark.createDataFrame([(None, "t", "en", "hot", 1)] * 50 + [(1, "t", "en", "hot", 1)] * 2, DOCS)
    copies = Counter(r.doc_id for r in source_mix.mix_sources(unknown, {"hot": 1.0}).collect())
    assert copies[None] % 50 == 0 and copies[1] % 2 == 0  # rows of one id are drawn alike
    with pytest.raises(ValueError, match="repeated over"):
        source_mix.mix_sources(df, {"cold": 1.0}, max_rate=5)
    for rate in (0.1, 1.0, 7.5):
        steps = source_mix.poisson_steps(rate)
        assert abs(steps[-1] - 1) < 1e-12
        assert abs(sum(1 - s for s in steps) - rate) < 1e-9


def test_mixing_of_a_source_hardly_there(spark):
    """One row with a null source among many, over what a plan holds and over one part of copies."""
    docs = spark.range(400_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "a").alias("source")
    )
    weights = {"a": 0.75, source_mix.OTHER: 0.25}
    counts = {r.source: r for r in source_mix.mix_sources(docs, weights).groupBy("source").agg(
        F.count("*").alias("n"), F.min("mix_copy").alias("low"), F.max("mix_copy").alias("high"),
        F.countDistinct("mix_copy").alias("kinds"),
    ).collect()}
    assert abs(counts[None].n - 100_000) < 6 * 100_000**0.5 and abs(counts["a"].n - 300_000) < 6 * 300_000**0.5
    assert (counts[None].low, counts[None].high, counts[None].kinds) == (0, counts[None].n - 1, counts[None].n)
    for rate in (1.5, 40.0, 900.0):
        first, steps = source_mix.poisson_middle(rate)
        whole = source_mix.poisson_steps(rate)
        assert np.allclose(steps, whole[first : first + len(steps)], atol=1e-12)


# 8 and 9


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [(int(i), [int(x) for x in rng.integers(-3, 4, rng.integers(0, 6))]) for i in range(80)]
    odd_rows = [(None, [1]), (90, None), (91, [1, None]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors + odd_rows, "vec_id long, vector array<long>").withColumn("v", F.lit("clash"))
    used = vectors + [odd_rows[3]]
    for sizes in ((8192, 2048), (10, 7)):
        got = topk.top_k(df.where("vec_id % 5 = 0"), df, 5, candidate_rows=sizes[0], query_rows=sizes[1])
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
        for q, v in vectors:
            if q % 5 == 0:
                scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in used if c != q)[:5]
                assert [got[q, i] for i in range(1, 6)] == [(c, -s) for s, c in scores]
    assert topk.top_k(df.limit(0), df, 5).count() == topk.top_k(df, df.limit(0), 5).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id < 3"), 5).count() == 2


def test_nearest_reach_most_of_the_exact_ones(spark, small):
    rows = queries.table(spark, small, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = queries.op9_ann(spark, small).collect()
    exact = set()
    for q in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        exact |= {(int(ids[q]), int(ids[j])) for j in np.lexsort((ids, away))[:10]}
    assert len(exact & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(exact)
    place = {int(v): i for i, v in enumerate(ids)}
    for r in got:
        assert r.score == pytest.approx(np.sqrt(((x[place[r.query_id]] - x[place[r.vec_id]]) ** 2).sum()), abs=1e-12)


def test_nearest_reach_few_and_opposed_candidates(spark):
    rng = np.random.default_rng(13)
    schema = "vec_id long, embedding array<double>"
    few = [(i, rng.normal(size=64).tolist()) for i in range(6)]
    centre = rng.normal(size=64)
    cluster = [(i, (centre + 0.01 * rng.normal(size=64)).tolist()) for i in range(30)]
    for rows, asked in ((few, rng.normal(size=64)), (cluster, -centre)):
        queries_ = spark.createDataFrame([(1000, asked.tolist())], schema)
        got = ann.nearest(queries_, spark.createDataFrame(rows, schema), 10).collect()
        away = sorted((np.sqrt(((np.array(v) - asked) ** 2).sum()), i) for i, v in rows)
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for _, i in away[:10]]


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("axis", F.lit("clash"))
    got = ann.nearest(df.where("vec_id = 0"), df, 10).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert ann.nearest(df, df.limit(0), 10).count() == ann.nearest(df.limit(0), df, 10).count() == 0


# 10


def test_licenses(spark, texts):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    extra = {
        -1: "CC BY! cc-by cc é by All RIGHTS\nreserved general public license general public License",
        -2: "x " * 30 + mit.replace("charge", "any charge").upper() + " y" * 9,
        -3: mit[: len(mit) // 2],
        -4: None,
        -5: "cc",
        -6: "released under the x under the mit x the mit license",
        -7: "released under x the MIT License",
        -8: "general public license " * 20000 + "licensed under the MIT License",
    }
    rows = [*texts.items(), *extra.items(), (-5, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = license_scan.scan_licenses(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        words = WORD.findall((dict(rows)[r.doc_id] or "").translate(LOWER))
        assert r.n_words == len(words)
        wanted = []
        for t in license_scan.PHRASES:
            p = t.text.split()
            wanted += [(i, i + len(p), t.label) for i in range(len(words)) if words[i : i + len(p)] == p]
        assert sorted((s.start, s.end, s.label) for s in r.spans if s.phrase) == sorted(wanted)
        found = {(s.label, s.start) for s in r.spans if not s.phrase}
        assert (("mit", 30) in found) == (r.doc_id == -2) and (r.doc_id not in (-3, -6, -7) or not found)
        assert r.doc_id != -8 or found == {("mit", 60000)}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


# The pipeline


def test_pipeline(spark, small, texts):
    docs = queries.table(spark, small, "documents")
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        steps.append([r.asDict() for r in docs.collect()])
    clean, single, safe, mixed, coded = steps
    labels = {r.doc_id: r.toxic for r in queries.table(spark, small, "labels").collect()}
    gone = set(texts) - {r["doc_id"] for r in clean}
    assert gone and all(labels.get(i, 1) for i in gone)
    assert gone == {r.doc_id for r in queries.op5_toxicity(spark, small).collect() if r.predicted}
    of_clean = spark.createDataFrame([(r["doc_id"], r["text"]) for r in clean], "doc_id long, text string")
    assert {r["doc_id"] for r in single} == {r.class_id for r in order_minhash.classes(of_clean).collect()}
    import duckdb

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(safe))
    wanted = con.execute(f"SELECT doc_id FROM ({queries.SQL['op7_source_mix']})").fetchall()
    assert Counter(r["doc_id"] for r in mixed) == Counter(i for (i,) in wanted)
    assert len({r["doc_id"] for r in single}) == len(single) < len({r["text"] for r in clean}) + 1
    for r in safe:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert [sorted(r) for r in (clean[0], single[0], safe[0], mixed[0])] == [sorted(c.split()[0] for c in DOCS.split(", "))] * 4
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in safe}
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded)
    again = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    assert rows_of(again) == rows_of(coded)


def test_pipeline_of_odd_rows(spark, small):
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in ODD]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small).cache()
            docs.count()
        kept = Counter((r.doc_id, r.text) for r in order_minhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect())
        assert kept == Counter(set(ODD)) and {r.round_trip for r in docs.collect()} <= {True}


def test_the_pipeline_codes_in_one_worker_for_a_task(spark):
    docs = spark.createDataFrame([(1, "some text  \u2581x", "en", "a", 12), (2, None, "en", "a", 0), (3, "", "en", "b", 0)], DOCS)
    coded = corpus_pipeline.encode(spark, docs, "")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    import public_tokenizers

    vocabulary = piece_codec.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    plain = piece_codec.decode_texts(piece_codec.encode_texts(docs, vocabulary), vocabulary)
    wanted = {r.doc_id: (r.ids, r.text) for r in plain.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: (r.ids, r.round_trip, r.n_tokens) for r in coded.collect()} == {
        i: (ids, text == texts[i], len(ids)) for i, (ids, text) in wanted.items()
    }
