"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of k words, each with the number of its occurrence so far. A
sketch holds, for each of some hash functions, the ``sampled`` k-mers of least hash in the
order in which they stand in the text. Texts of similar length that agree in a component of
the sketch, and so in that order too, are candidates; they are linked if aligning their words costs at most
(1 - similarity) times the longer one's words in insertions, deletions and substitutions.
Classes are the connected components of the links.

Candidates are tested in three steps. First each text of a bucket is aligned with the bucket's
least text; that joins nearly all copies. The texts of buckets that still hold several
components, split by classes of length, then meet in blocks, each with its marks: bits that
an edit changes two of at most. What is told apart by them is never aligned. Large
buckets first meet another of their texts. Of what is left, each text is aligned with the nearest of each other component, and in the end components of
several texts with all of those texts that may be like one of theirs. So every pair of a bucket is tested,
or already joined, or told apart by a bound that holds for it, and what travels is a row for each
text of a bucket's blocks, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, settle, small_batches
from ._words import mixed, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Sketch:
    """words: in a k-mer; sampled: k-mers in a component; components: of a sketch.

    dense: further components of one k-mer of 3 words, or 2 for short texts. At 20 % of
    scattered edits such k-mers have a Jaccard similarity of 0.34, and 16 miss 0.1 %.
    """

    words: int = 5
    sampled: int = 2
    components: int = 32
    dense: int = 16
    similarity: float = 0.8


LARGE = 64  # members of buckets that meet one more of their texts first
BLOCK = 2048  # texts of a bucket that are compared with each other, or with as many more, in one task
NARROW = 2000  # words of texts whose marks are short enough for blocks of four times as many
FEW = 1 << 20  # numbers of texts that are broadcast, 8 MB at most
GROUP = 256  # texts in a block where texts of one label meet others
MARKS = 1 << 15  # bits of a text's marks, at most
BINS = 128  # classes of words by which texts are compared before they are aligned; a power of 2
_CELLS = 1 << 18  # hashes of a text, or words of marks, that are held at a time
_HELD = 1 << 18  # pairs that are held at a time


def order_minhash(words: np.ndarray, sketch: Sketch) -> np.ndarray:
    """The sketch of a text's word hashes; a text under k words is one k-mer, none has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kmers = shingle_hashes(words, min(sketch.words, len(words)))
    labelled = mixed(kmers + _occurrence(kmers) * np.uint64(0xD6E8FEB86659FD93))
    seeds = mixed(np.arange(1, sketch.components + 1, dtype=np.uint64))
    taken, out = min(sketch.sampled, len(kmers)), np.empty(len(seeds), np.uint64)
    step = max(1, _CELLS // len(kmers))
    for at in range(0, len(seeds), step):
        own = seeds[at : at + step]
        hashes = (labelled ^ own[:, None]) * (own | np.uint64(1))[:, None]
        rows = np.arange(len(own))
        places = np.empty((len(own), taken), np.int64)
        for j in range(taken):
            places[:, j] = hashes.argmin(axis=1)
            hashes[rows, places[:, j]] = ~np.uint64(0)
        places.sort(axis=1)
        value = own.copy()
        for j in range(taken):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + kmers[places[:, j]])
        out[at : at + step] = value
    return out


def _occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    ordered = np.sort(values)
    if not (ordered[1:] == ordered[:-1]).any():
        return np.zeros(len(values), np.uint64)
    order = np.argsort(values, kind="stable")
    fresh = np.flatnonzero(np.append(True, np.diff(values[order]) != 0)[: len(values)])
    runs = np.diff(np.append(fresh, len(values)))
    out = np.empty(len(values), np.uint64)
    out[order] = (np.arange(len(values)) - np.repeat(fresh, runs)).astype(np.uint64)
    return out


SHORT = 14  # words of texts that are found by what is left after deletions
_WIDE_FROM, _NARROW_TO = 41, 50  # words of texts with dense components of 3, and of 2 words


def candidate_keys(words: np.ndarray, sketch: Sketch) -> np.ndarray:
    """What texts must share one of to be candidates: the sketch, dense components, deletions."""
    out = [order_minhash(words, sketch)]
    if sketch.dense and len(words):
        # Similar texts are of the same kind: the lengths of both kinds overlap by over a fifth.
        narrow_to = max(_NARROW_TO, math.ceil((_WIDE_FROM - 1) / max(sketch.similarity, 0.01)))
        for width, fits in ((3, len(words) >= _WIDE_FROM), (2, len(words) <= narrow_to)):
            if fits:
                dense = order_minhash(words, Sketch(width, 1, sketch.dense))
                out.append(mixed(dense + np.uint64(width)))
        if len(words) <= SHORT:
            out.append(_with_deletions(words, sketch.similarity))
    return np.concatenate(out)


def _with_deletions(words: np.ndarray, similarity: float) -> np.ndarray:
    """A hash of each rest of a short text after as many deletions as its longest like text allows.

    Texts that e edits make equal have a common rest after at most e deletions in each.
    """
    n = len(words)
    most = max(_edits(m, similarity) for m in range(n, SHORT + 1) if m - _edits(m, similarity) <= n)
    out = []
    for left in range(max(0, n - most), n + 1):
        kept = words[_choices(n, left)]
        total = np.full(len(kept), left + 1, dtype=np.uint64)
        for j in range(left):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + kept[:, j])
        out.append(total)
    return np.unique(np.concatenate(out))


@lru_cache(256)
def _choices(n: int, taken: int) -> np.ndarray:
    every = list(combinations(range(n), taken))
    return np.array(every, dtype=np.int64).reshape(len(every), taken)


def within(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """For each (a, b, limit), whether the edit distance of a and b is at most limit."""
    out = np.zeros(len(pairs), dtype=bool)
    for i, (a, b, limit) in enumerate(pairs):
        known = _quickly(*(ends := _without_ends(a, b)), limit)
        out[i] = _band(*ends, limit) if known is None else known
    return out


def _without_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b, the longer first, without what they have in common at both ends."""
    if len(a) < len(b):
        a, b = b, a
    differ = a[: len(b)] != b
    head = int(differ.argmax()) if differ.any() else len(b)
    a, b = a[head:], b[head:]
    differ = (a[len(a) - len(b) :] != b)[::-1]
    tail = int(differ.argmax()) if differ.any() else len(b)
    return a[: len(a) - tail], b[: len(b) - tail]


def _quickly(a: np.ndarray, b: np.ndarray, limit: int) -> bool | None:
    """The answer where lengths, or the words that both have in any order, give it."""
    if len(a) <= limit:  # substitutions and deletions alone
        return True
    if len(a) - len(b) > limit or not len(b):
        return False
    if len(a) - _shared(a, b) > limit:
        return False
    # An edit takes at most two of the pairs of neighbours in a.
    if len(a) - 1 > 2 * limit and len(b) > 1:
        first, second = ((x[:-1].astype(np.int64) << 32) + x[1:] for x in (a, b))
        if len(first) - _shared(first, second) > 2 * limit:
            return False
    return None


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values a and b share, each as often as both have it."""
    words = np.sort(b)
    kinds = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    counts = np.diff(np.append(kinds, len(words)))
    place = np.minimum(np.searchsorted(words[kinds], a), len(kinds) - 1)
    shared = np.bincount(place[words[kinds][place] == a], minlength=len(kinds))
    return int(np.minimum(shared, counts).sum())


def _band(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Banded alignment of a with the no longer b, whose band is a number of 2 limit + 2 bits.

    A bit stands for a place of a; what a column of costs adds from place to place, up or down
    by one, is held as two such numbers, so a word of b takes a few operations whatever the
    band's width. The cost follows the band's lower edge until a ends, then the end of a.
    """
    m, n, width = len(a), len(b), 2 * limit + 2
    whole = (1 << width) - 1
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << i)
    rises, falls = whole ^ ((1 << (width - limit - 1)) - 1), 0
    cost, most = limit, 2 * limit + n - m  # as many steps as follow the edge's end may lower it
    edge, start = 1 << (width - 1), limit + 1 - width
    end = edge >> 1
    for i, word in enumerate(b.tolist()):
        own = places.get(word, 0)
        own = (own >> start if start >= 0 else own << -start) & whole
        start += 1
        level = ((((own & rises) + rises) & whole) ^ rises) | own | falls
        right_rises = falls | (whole ^ (level | rises))
        right_falls = level & rises
        if i < m - limit:
            cost += not level & edge
            if cost > most:
                return False
        else:
            cost += bool(right_rises & end) - bool(right_falls & end)
            end >>= 1
        moved = level >> 1
        rises = right_falls | (whole ^ (moved | right_rises))
        falls = moved & right_rises
    return cost <= limit


def _edits(longer: int, similarity: float) -> int:
    return int((1 - similarity) * longer + 1e-9)


def _bags(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each text, how many of its words lie in each of BINS classes, up to 127."""
    of_text = np.repeat(np.arange(len(counts)), counts)
    kinds = (words >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    bags = np.bincount(of_text * BINS + kinds, minlength=len(counts) * BINS)
    offsets = np.arange(0, len(bags) + 1, BINS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.minimum(bags, 127).astype(np.int8)))


def _marks(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each text, bits that its words, each with the number of its occurrence, change in turn.

    There are two to four for each word and MARKS at most, a power of 2: half as many come from
    those of both halves by exclusive or.
    """
    of_text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    times = _occurrence(mixed(words ^ mixed(of_text + np.uint64(1))))
    sizes = 1 << np.ceil(np.log2(np.clip(2 * counts, 64, MARKS))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = mixed(words + times * np.uint64(0xD6E8FEB86659FD93))
    bits = (hashes & np.repeat(sizes - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(starts[:-1], counts)
    odd = np.packbits(np.bincount(bits, minlength=starts[-1]) & 1, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((starts // 64).astype(np.int32)), pa.array(odd))


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only for texts whose lengths and bags already need too many edits.

    An edit changes two counts of the bags by one, or one count and the length: so twice the
    edits are at least the difference of the counts and that of the lengths together.
    """
    longer = F.greatest(f"{a}.n_words", f"{b}.n_words")
    apart = F.abs(F.col(f"{a}.n_words") - F.col(f"{b}.n_words"))
    limit = 2 * F.floor((1 - similarity) * longer + 1e-9)
    counts = F.zip_with(f"{a}.bag", f"{b}.bag", lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    return (2 * apart <= limit) & (F.aggregate(counts, F.lit(0), lambda s, x: s + x) + apart <= limit)


def _sketched(texts: DataFrame, sketch: Sketch) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, words in word_hashes(batch["text"]):
                ends = np.cumsum(counts)
                rows = [candidate_keys(words[e - n : e], sketch) for n, e in zip(counts, ends, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows).view(np.int64)
                words_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(first, len(counts)),
                        batch["key"].slice(first, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        _bags(words, counts),
                        _marks(words, counts),
                        pa.ListArray.from_arrays(pa.array(words_at), pa.array((words >> np.uint64(33)).astype(np.int32))),
                    ],
                    names=["id", "key", *_OF_TEXT],
                )

    return texts.mapInArrow(
        make, "id long, key binary, n_words long, sketch array<long>, bag array<tinyint>, marks array<long>, words array<int>"
    )


_OF_TEXT = ("n_words", "sketch", "bag", "marks", "words")


def _nodes(texts: DataFrame, sketch: Sketch) -> tuple[DataFrame, list[DataFrame]]:
    """node, id, key, n_words, sketch, bag, marks and words of each text, which its least id stands for.

    A text's node is its id. Where several texts have one least id, that of the least key goes
    by the id and each other by a number of 62 bits made from its key. The tables that hold
    them come second.
    """
    firsts = _distinct(texts, sketch)
    of_id = firsts.groupBy("id").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    shared = settle(of_id.where("n > 1").select("id", "least"))
    own = F.col("least").isNull() | (F.col("least") == F.col("key"))
    number = F.xxhash64("key").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 61)
    node = F.when(own, F.col("id")).otherwise(number).alias("node")
    return firsts.join(shared, "id", "left").select(node, "id", "key", *_OF_TEXT), [firsts, shared]


def _distinct(texts: DataFrame, sketch: Sketch) -> DataFrame:
    """A settled table of key, least id, sketch, bag, marks and words of each text.

    Only ids and keys are shuffled, and the sketches of texts that rows share: a text of one row stays where it is.
    """
    rows = texts.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    copied = settle(rows.where("n > 1").select("key", "least"))
    few = _if_few(copied)
    single = _sketched(texts.join(few, "key", "left_anti"), sketch)
    of_text = [F.first(c).alias(c) for c in ("id", *_OF_TEXT)]
    firsts = _sketched(texts.join(few, "key").where("id = least"), sketch).groupBy("key").agg(*of_text)
    distinct = settle(single.unionByName(firsts))
    discard(copied)
    return distinct


def _if_few(nodes: DataFrame) -> DataFrame:
    """A settled table of nodes, marked to be broadcast if it has up to FEW rows; else it is shuffled."""
    return F.broadcast(nodes) if nodes.count() <= FEW else nodes


def _aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose texts are similar. Only words of the texts in them are moved."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("a_words", "b_words"):
                offsets = batch[name].offsets.to_numpy()
                sides.append((batch[name].values.to_numpy(), offsets))
            (a_flat, a_at), (b_flat, b_at) = sides
            for first in range(0, len(batch), 1000):
                pairs = []
                for i in range(first, min(first + 1000, len(batch))):
                    a, b = a_flat[a_at[i] : a_at[i + 1]], b_flat[b_at[i] : b_at[i + 1]]
                    pairs.append((a, b, _edits(max(len(a), len(b)), similarity)))
                kept = first + np.flatnonzero(within(pairs))
                yield batch.select(["a", "b"]).take(pa.array(kept))

    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = settle(words.join(_if_few(needed), "node", "left_semi"))
    of_b = own.select(F.col("node").alias("b"), F.col("words").alias("b_words"))
    of_a = own.select(F.col("node").alias("a"), F.col("words").alias("a_words"))
    full = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "a_words", "b_words")
    return full.mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label, the least id of its component, of each id in the links (a, b).

    Each round gives an id the least of its neighbours and itself, then links what still
    differs, so links get fewer from round to round; in the end the rounds are followed
    backwards. Links and rounds are settled.
    """
    left = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
        rounds.append(near)
        of_a = near.select(F.col("id").alias("a"), F.col("label").alias("new_a"))
        of_b = near.select(F.col("id").alias("b"), F.col("label").alias("new_b"))
        moved = left.join(of_a, "a").join(of_b, "b").where("new_a <> new_b")
        before, left = left, settle(moved.select(F.greatest("new_a", "new_b").alias("a"), F.least("new_a", "new_b").alias("b")).distinct())
        discard(before)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = rounds.pop()
    while rounds:
        earlier, later = rounds.pop(), labels.select(F.col("id").alias("label"), F.col("label").alias("last"))
        labels = settle(earlier.join(later, "label", "left").select("id", F.coalesce("last", "label").alias("label")))
        discard(earlier)
    return labels


def classes(
    docs: DataFrame,
    sketch: Sketch = Sketch(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and class_id, the least id of its class, of each row of docs.

    Equal texts are one text throughout, which its least id stands for. Words are runs of
    letters and digits, A-Z as a-z. A null or empty text is in a class of its own, of its own
    id; texts without words are only like equal texts. Null ids get the class of their text
    where it has one, else null. Rows of one id are judged each by its text. Other columns
    are not read; an empty table gives none.
    """
    keyed = _keyed(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        nodes, labels = _labelled(keyed, sketch)
    of_text = nodes.select("key", "node").join(labels, "node").select("key", F.col("label").alias("class_id"))
    of_row = keyed.select(F.col("id").alias("doc_id"), "key").join(of_text, "key", "left")
    return of_row.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and key, which is null for a text that is null or empty."""
    key = F.when(F.length(text_col) > 0, F.unhex(F.sha2(text_col, 256)))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key.alias("key"))


def _labelled(keyed: DataFrame, sketch: Sketch) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, id, key), and the label of each node: the least node of its class."""
    texts = keyed.where((F.length("text") > 0) & F.col("id").isNotNull())
    full, tables = _nodes(texts, sketch)
    held = settle(_held(full))
    met = settle(held.select("a", F.col("node").alias("b")).distinct())
    bags, words = full.select("node", "n_words", "bag"), full.select("node", "words")
    labels = settle(full.select("node", F.col("node").alias("label")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The labels of pairs (a, b, a_label, b_label) whose texts are similar."""
        pairs = settle(pairs)
        found = _aligned(pairs.select("a", "b"), words, sketch.similarity).join(pairs, ["a", "b"])
        links = settle(found.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
        discard(pairs)
        return links

    def joined(links: DataFrame) -> DataFrame:
        after = settle(_relabelled(labels, components(links)))
        discard(links, labels)
        return after

    first = _near(met, bags, sketch.similarity)
    labels = joined(linked(first.select("a", "b", F.col("a").alias("a_label"), F.col("b").alias("b_label"))))
    still = settle(_still_open(_by_length(held.where("n > 2"), bags, sketch.similarity), labels))
    marks = full.select("node", "n_words", "marks")
    drawn = _pivot_pairs(still.where(F.col("n") > LARGE))
    labels = joined(linked(_near(drawn, bags, sketch.similarity)))
    left = settle(_still_open(still.select("bucket", "node", "up", "block"), labels))
    labels = joined(linked(_nearest(left, marks, sketch.similarity)))
    discard(left)
    alone = labels.groupBy("label").agg((F.count("*") == 1).alias("alone"))
    left = settle(_still_open(still.select("bucket", "node", "up", "block"), labels.join(alone, "label")))
    texts = full.select("node", "n_words", "bag", "marks", "words")
    labels = joined(_met_groups(left, texts, labels, sketch.similarity))
    nodes = settle(full.select("node", "id", "key"))
    discard(*tables, held, met, still, left)
    return nodes, labels


def _held(nodes: DataFrame) -> DataFrame:
    """bucket, n, a and node: the texts of buckets of n texts, without the bucket's least node a.

    Buckets are counted before they are joined, so one of many texts costs a row for each.
    """
    spread = nodes.select("node", F.explode(F.array_distinct("sketch")).alias("bucket"))
    several = spread.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return spread.join(several, "bucket").where("node <> a")


def _by_length(rows: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """bucket, node, up and block of rows, each bucket split in two ways: by classes of length, and by them moved by one (up).

    Classes are a little wider than the lengths that similar texts may differ by, so texts
    that can be linked lie in one class or in neighbouring ones, and share a bucket in which one isn't up.
    block: texts in a block of the bucket, as many more as their marks are short.
    """
    width = -math.log(max(similarity - 0.01, 0.01))
    level = F.floor(F.log(F.greatest(F.col("n_words"), F.lit(1))) / width)
    both = []
    for i in (0, 1):
        block = F.when(F.exp((level + i + 1) * width) <= NARROW, 4 * BLOCK).otherwise(BLOCK)
        both.append(F.struct(F.xxhash64("bucket", level + i).alias("bucket"), "node", F.lit(i > 0).alias("up"), block.alias("block")))
    return rows.join(bags.select("node", "n_words"), "node").select(F.inline(F.array(*both)))


def _still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, n, node, up, block and label of rows (bucket, node, up, block) in buckets of n rows and several labels, not all up.

    The least node of a whole bucket isn't among them: it has met all others. If labels say
    which are alone, buckets of such ones only are left out.
    """
    labelled = rows.join(labels, "node")
    lonely = F.bool_and("alone") if "alone" in labels.columns else F.lit(False)
    several = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("n"),
        (lonely | F.bool_and("up")).alias("left_out"),
    )
    return labelled.join(several.where("low <> high AND NOT left_out").select("bucket", "n"), "bucket")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Members of each bucket with the one of least hash, if their labels differ."""
    drawn = F.min_by(F.struct("node", "label"), F.xxhash64("node", "bucket"))
    pivots = members.groupBy("bucket").agg(drawn.alias("pivot"))
    met = members.join(pivots, "bucket").where("label <> pivot.label")
    first = F.col("node") < F.col("pivot.node")
    return met.select(
        F.least("node", "pivot.node").alias("a"),
        F.greatest("node", "pivot.node").alias("b"),
        F.when(first, F.col("label")).otherwise(F.col("pivot.label")).alias("a_label"),
        F.when(first, F.col("pivot.label")).otherwise(F.col("label")).alias("b_label"),
    ).distinct()


def _near(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose lengths and bags allow a link."""
    x, y = bags.withColumnRenamed("node", "a"), bags.withColumnRenamed("node", "b")
    with_a = pairs.join(x, "a").alias("x")
    both = with_a.join(y.alias("y"), (F.col("x.b") == F.col("y.b")) & _may_be_similar("x", "y", similarity))
    return both.select(*[f"x.{c}" for c in pairs.columns])


def _in_marked_blocks(members: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of members (bucket, n, node, up, block, label, ...) with n_words, marks and large, by the blocks that meet.

    A large bucket's texts are dealt out to blocks, of which each meets itself and each other.
    Those that meet lie together, in order. large: the text's large buckets, whose lowest bit says whether it is up
    there, in rows of large buckets; null in others.
    """
    blocks = F.ceil(F.col("n") / F.col("block"))
    bucket = F.col("bucket").bitwiseAND(-2).bitwiseOR(F.col("up").cast("long"))
    lists = members.where(F.col("n") > LARGE).groupBy("node").agg(F.collect_list(bucket).alias("large"))
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    meeting = dealt.join(marks.join(lists, "node", "left"), "node").withColumn("large", F.when(F.col("n") > LARGE, F.col("large")))
    meeting = meeting.withColumn("other", other).withColumn("low", F.least("own", "other"))
    keys = ("bucket", "low", "high")
    meeting = meeting.withColumn("high", F.greatest("own", "other")).drop("n", "block", "other")
    return meeting.repartition(*keys).sortWithinPartitions(*keys)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, in tables that end where a group of blocks ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("bucket", "low", "high")])
        fresh = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held and (keys[:, 0] != last).any():
            fresh = np.append(0, fresh)
        if len(fresh):
            held.append(batch.slice(0, fresh[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(fresh[-1] if len(fresh) else 0))
        last = keys[:, -1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _first_meeting(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of which pairs of places the rows' bucket is the least large one where they meet; all in buckets that aren't large."""
    large = rows["large"].combine_chunks()
    flat, at = large.values.to_numpy(), large.offsets.to_numpy()
    of_large, bucket = large.is_valid().to_numpy(zero_copy_only=False), rows["bucket"].to_numpy() >> 1
    known: dict[int, tuple[set[int], set[int]]] = {}

    def buckets(i: int) -> tuple[set[int], set[int]]:
        if i not in known:
            if len(known) >= BLOCK:
                known.clear()
            own = flat[at[i] : at[i + 1]]
            known[i] = set((own >> 1).tolist()), set((own[(own & 1) > 0] >> 1).tolist())
        return known[i]

    def is_first(i: int, j: int) -> bool:
        (own, own_up), (others, others_up) = buckets(i), buckets(j)
        return min((own & others) - (own_up & others_up)) == bucket[i]

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        told = [not of_large[x] or is_first(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return np.array(told, dtype=bool)

    return first


def _near_by_marks(rows: pa.Table, similarity: float, also) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and the distance of marks of the rows that meet, if labels differ, also(i, j) and a link is possible.

    Two that are up meet in another bucket as well, where they are not.
    """
    bucket, low, high, own, label, size = (
        rows[c].to_numpy() for c in ("bucket", "low", "high", "own", "label", "n_words")
    )
    lists = rows["marks"].combine_chunks()
    flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    widths = np.diff(at)
    begins = np.flatnonzero(
        np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    )
    counts = np.diff(np.append(begins, len(bucket)))
    ends, width = np.repeat(begins + counts, counts), np.repeat(np.minimum.reduceat(widths, begins), counts)
    both, down = low == high, ~rows["up"].to_numpy()
    for w in np.unique(width).tolist():
        of_width = np.flatnonzero(width == w)
        marks, place = np.empty((len(of_width), w), np.uint64), np.full(len(bucket), -1)
        place[of_width] = np.arange(len(of_width))
        for v in np.unique(widths[of_width]).tolist():
            whole = of_width[widths[of_width] == v]
            bits = flat[at[whole][:, None] + np.arange(v)].reshape(len(whole), v // w, w)
            marks[place[whole]] = np.bitwise_xor.reduce(bits, axis=1)
        left, away, step = of_width, 0, max(1, _CELLS // w)
        while len(left):
            away += 1
            left = left[left + away < ends[left]]
            other = left + away
            fits = (label[left] != label[other]) & (both[left] | (own[left] != own[other]))
            fits &= (down[left] | down[other]) & also(left, other)
            i, j = left[fits], other[fits]
            apart = np.abs(size[i] - size[j])
            limit = 2 * np.floor((1 - similarity) * np.maximum(size[i], size[j]) + 1e-9)
            fits = 2 * apart <= limit
            i, j, most = i[fits], j[fits], (limit - apart)[fits]
            for first in range(0, len(i), step):
                a, b = i[first : first + step], j[first : first + step]
                far = np.bitwise_count(marks[place[a]] ^ marks[place[b]]).sum(axis=1, dtype=np.int64)
                near = far <= most[first : first + step]
                if near.any():
                    yield a[near], b[near], far[near]


def _nearest(members: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members that are each the other's nearest of its label in a bucket's blocks, if a link is possible.

    Texts whose labels no others have give all such pairs. A pair that meets in several large buckets is given by one.
    """

    def best(i: np.ndarray, j: np.ndarray, far: np.ndarray, label: np.ndarray) -> np.ndarray:
        order = np.lexsort((j, far, label[j], i))
        first = np.append(True, (np.diff(i[order]) != 0) | (np.diff(label[j][order]) != 0))
        kept = np.zeros(len(i), bool)
        kept[order[first]] = True
        return kept

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
            first_meeting = _first_meeting(rows)
            found, n = [np.zeros((3, 0), np.int64)], 0

            def reduced(found):
                i, j, far = np.concatenate(found, axis=1)
                kept = best(i, j, far, label) & best(j, i, far, label) if len(i) else np.zeros(0, bool)
                return np.stack([i, j, far])[:, kept]

            for some in _near_by_marks(rows, similarity, lambda i, j: True):
                found.append(np.stack(some))
                n += len(some[0])
                if n > _HELD:
                    found, n = [reduced(found)], 0
            i, j, _ = reduced(found)
            fresh = first_meeting(i, j)
            i, j = i[fresh], j[fresh]
            first = node[i] < node[j]
            ends = (np.where(first, i, j), np.where(first, j, i))
            columns = np.stack([node[ends[0]], node[ends[1]], label[ends[0]], label[ends[1]]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "a_label", "b_label"])

    blocks = _in_marked_blocks(members, marks)
    return blocks.mapInArrow(meet, "a long, b long, a_label long, b_label long").distinct()


def _met_groups(members: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of labels that share a bucket, of which one is that of several texts.

    members: bucket, n, node, label and alone, which says that no other text has the label. Texts meet in blocks of both sides, so what travels is texts and not their pairs.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
            alone = rows["alone"].to_numpy()
            found = [np.zeros((3, 0), np.int64)]
            for i, j, _ in _near_by_marks(rows, similarity, lambda i, j: ~(alone[i] & alone[j])):
                first = label[i] < label[j]
                low, high = np.where(first, i, j), np.where(first, j, i)
                found.append(np.stack([label[low], label[high], node[high]]))
                if sum(f.shape[1] for f in found) > _HELD:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
            columns = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "node"])

    blocks = _in_marked_blocks(members, texts.select("node", "n_words", "marks"))
    near = settle(blocks.mapInArrow(meet, "a long, b long, node long").distinct())
    needed = settle(near.select(F.explode(F.array("a", "b")).alias("label")).distinct())
    of_needed = settle(labels.join(_if_few(needed), "label", "left_semi"))
    own = settle(texts.drop("marks").join(_if_few(of_needed), "node"))
    of_b = near.select("a", "node").join(own.withColumnRenamed("label", "b"), "node")
    links = settle(_in_blocks(near, of_b, own, similarity).select("a", "b").distinct())
    discard(near, needed, of_needed, own)
    return links


def _in_blocks(meeting: DataFrame, of_b: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b and node of texts of_b (a, b, node, ...) that are similar to one of label a."""
    of_a = meeting.select("a").distinct().join(texts.withColumnRenamed("label", "a"), "a")
    a_parts = of_a.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("a_part_of"))
    b_parts = of_b.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("b_part_of"))
    sizes = settle(a_parts.join(b_parts, "a"))
    key, rest = ("a", "a_part", "b_part"), ("label", "node", "n_words", "bag", "words")

    def side(rows: DataFrame, label: str, own: str, other: str, name: str) -> DataFrame:
        placed = rows.join(sizes, "a").withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}_of")))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_of") - 1)))
        placed = placed.withColumn("label", F.col(label))
        # New names, as both sides come from the same columns.
        return placed.select(*[F.col(c).alias(f"{name}_{c}") for c in key + rest]).groupBy(*[f"{name}_{c}" for c in key])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (side.rename_columns([c[2:] for c in side.column_names]) for side in (left, right))
        (_, a_label, a_size, a_bag), (b, b_label, b_size, b_bag) = _arrays(left), _arrays(right)
        a_words, b_words = (list(_lists(x["words"])) for x in (left, right))
        found: list[tuple] = []
        for j in range(len(b_label) if len(a_label) else 0):
            at = _may_be_similar_to(j, (b_size, b_bag), (a_size, a_bag), similarity)
            at = at[np.argsort(np.abs(a_bag[at] - b_bag[j]).sum(axis=1), kind="stable")]
            limits = (_edits(max(a_size[i], b_size[j]), similarity) for i in at)
            like = any(within([(a_words[i], b_words[j], e)])[0] for i, e in zip(at, limits, strict=True))
            if like:
                found.append((a_label[0], b_label[j], b[j]))
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("a", "b", "node"))})

    x, y = side(of_a, "a", "a_part", "b_part", "x"), side(of_b, "b", "b_part", "a_part", "y")
    return x.cogroup(y).applyInArrow(meet, "a long, b long, node long").distinct()


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for x in column.chunks:
        flat, ends = x.values.to_numpy(), x.offsets.to_numpy()
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            yield flat[start:end]


def _arrays(side: pa.Table) -> tuple[np.ndarray, ...]:
    """node, label, n_words and bag of the texts of a block."""
    nodes, labels, sizes = (side[c].to_numpy() for c in ("node", "label", "n_words"))
    bags = np.concatenate([x.flatten().to_numpy() for x in side["bag"].chunks]) if len(side) else np.zeros(0, np.int8)
    return nodes, labels, sizes, bags.reshape(len(nodes), BINS).astype(np.int16)


def _may_be_similar_to(i: int, own: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], similarity: float) -> np.ndarray:
    """Places of the others for which _may_be_similar holds with text i."""
    (size, bag), (sizes, bags) = own, others
    apart = np.abs(sizes - size[i])
    limit = 2 * np.floor((1 - similarity) * np.maximum(sizes, size[i]) + 1e-9)
    at = np.flatnonzero(2 * apart <= limit)
    return at[np.abs(bags[at] - bag[i]).sum(axis=1) + apart[at] <= limit[at]]


def _relabelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows with the new label of each label, where joined (id, label) has one."""
    new = joined.select(F.col("id").alias("label"), F.col("label").alias("new"))
    return rows.join(new, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def deduplicate(
    docs: DataFrame,
    sketch: Sketch = Sketch(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of each class of docs: of its first text, which stands for it, that of the least id.

    Rows with a null id, or a null or empty text, all stay. Of several texts of one id each is
    judged by itself. Columns are those of docs.
    """
    marked = _keyed_rows(docs, id_col, text_col)
    bare = F.col("__id").isNull() | F.col("__key").isNull()
    with small_batches(docs.sparkSession):
        nodes, labels = _labelled(_keyed(docs, id_col, text_col), sketch)
    firsts = nodes.join(labels.where("node = label"), "node").select(F.col("id").alias("__id"), F.col("key").alias("__key"))
    whole = marked.where(~bare).join(firsts, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return marked.where(bare).unionByName(whole).select(*[F.col(f"`{c}`") for c in docs.columns])


def _keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.when(F.length(text_col) > 0, F.unhex(F.sha2(text_col, 256)))
    return docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__key", key)
