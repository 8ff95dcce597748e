"""SentencePiece encoding and decoding for models of the merge (BPE) type.

The merges of such a model are found without merging the text. A split of a text into pieces
is the model's own if every piece, and every pair of neighbours, comes out unchanged when it
is merged on its own: the first merge across a border would also happen within that pair. So
the encoder takes the longest piece at a place (an Aho-Corasick automaton finds it), checks
it against the piece before (``_Merges.agree``), falls back to shorter pieces and then to the
place before, and keeps a bitfield of places from which no split goes on.

Pieces never reach over a space that follows other text, and seldom from letters to digits
or other signs (the vocabulary tells), so texts are cut there and the parts' ids are kept in
dictionaries of bounded size by each Python worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "  # what the library decodes an unknown id to
CACHED_PARTS = 150_000  # in each of two generations
BATCH = 500  # texts whose results a worker holds at a time

_SIGNS = (r"[^\W\d_]", r"[\d_]", r"[^\w ]")  # letters, digits, all else but the space


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores and kinds (n: normal, c: control, u: unknown, b: byte)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    eos: int
    dummy_prefix: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file on the driver; executors get the table, not the path."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("only merge-type models with byte fallback are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models without normalisation are supported")
    names = {kinds.NORMAL: "n", kinds.CONTROL: "c", kinds.UNKNOWN: "u", kinds.BYTE: "b"}
    if not {p.type for p in model.pieces} <= set(names):
        raise ValueError("user-defined and unused pieces are not supported")
    return Vocabulary(
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        "".join(names[p.type] for p in model.pieces),
        sentencepiece.SentencePieceProcessor(model_file=path).eos_id(),
        norm.add_dummy_prefix,
    )


class _Merges:
    """Merging of short strings, and whether two pieces stay as they are side by side."""

    def __init__(self, v: Vocabulary) -> None:
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "n"}
        self.pieces, self.scores = v.pieces, v.scores
        self.known: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        if (out := self.known.get(pair)) is None:
            a, b = self.pieces[left], self.pieces[right]
            out = self.known[pair] = self.merge(a + b) == [a, b]
        return out


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        import ahocorasick

        self.v, self.merges = v, _Merges(v)
        ids = self.merges.ids
        # A piece that merging never gives can't be in any encoding.
        whole = {p: i for p, i in ids.items() if len(p) == 1 or self.merges.merge(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p, i in whole.items():
            self.longest.add_word(p, (len(p), i))
        self.longest.make_automaton()
        self.shorter: dict[int, tuple[int, int]] = {}
        for p, i in whole.items():
            for n in range(len(p) - 1, 0, -1):
                if (j := whole.get(p[:n])) is not None:
                    self.shorter[i] = (n, j)
                    break
        self.single = {p for p in whole if len(p) == 1}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == "b"}
        kind = {c: next((i for i, r in enumerate(_SIGNS) if re.match(r, c)), None) for c in self.single}
        borders = {
            a + b
            for p in ids
            for a, b in zip(p, p[1:], strict=False)
            if a != SPACE and kind[a] != kind[b]
        }
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids) or {c for p in ids for c in p} - self.single:
            raise ValueError("this vocabulary's pieces can't be cut at spaces or into characters")
        self.borders = re.compile("|".join(map(re.escape, sorted(borders)))) if borders else None
        self.fine = re.compile("|".join(f" *{r}+" for r in _SIGNS) + "| +")
        self.coarse = re.compile(" *[^ ]+| +")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def text(self, text: str) -> bytes:
        """The ids of a whole text as bytes of int32, without an end id."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")  # both are the same symbol to the model
        if self.v.dummy_prefix:
            text = " " + text
        cut = self.coarse if self.borders and self.borders.search(text) else self.fine
        parts, young = cut.findall(text), self.young
        try:
            return b"".join([young[p] for p in parts])
        except KeyError:
            return b"".join([young.get(p) or self._add(p) for p in parts])

    def _add(self, part: str) -> bytes:
        if (out := self.old.get(part)) is None:
            out = array("i", self.part(part.replace(" ", SPACE))).tobytes()
        if len(part) <= 64:
            if len(self.young) >= CACHED_PARTS:
                self.old = self.young.copy()
                self.young.clear()
            self.young[part] = out
        return out

    def part(self, part: str) -> list[int]:
        out, begin = [], 0
        for i, c in enumerate(part):
            if c not in self.single:
                out += self._split(part[begin:i])
                out += [self.bytes[b] for b in c.encode()]
                begin = i + 1
        return out + self._split(part[begin:])

    def _split(self, text: str) -> list[int]:
        """Backtracking over a text whose characters are all pieces."""
        n, known, shorter, longest = len(text), self.merges.known, self.shorter, self.longest
        out: list[int] = []
        lengths: list[int] = []
        failed, at, before = 0, 0, -1
        while at < n:
            size, piece = next(longest.iter_long(text, at))[1]
            while True:
                end = at + size
                if not failed >> end & 1:
                    fits = before < 0 or known.get(before << 32 | piece)
                    if fits or fits is None and self.merges.agree(before, piece):
                        break
                while (less := shorter.get(piece)) is None:
                    failed |= 1 << at
                    piece = out.pop()
                    at -= lengths.pop()
                    before = out[-1] if out else -1
                size, piece = less
            out.append(piece)
            lengths.append(size)
            at, before = end, piece
        return out


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.controls = v, [i for i, k in enumerate(v.kinds) if k == "c"]
        self.bytes = [
            {"c": "", "u": UNKNOWN_SURFACE}.get(k, p.replace(SPACE, " ")).encode()
            if k != "b"
            else bytes([int(p[3:5], 16)])
            for p, k in zip(v.pieces, v.kinds, strict=True)
        ]

    def ids(self, ids: list[int]) -> str:
        """As the library: bytes that form no character each give U+FFFD."""
        if ids and (min(ids) < 0 or max(ids) >= len(self.bytes)):
            raise ValueError("an id is not in the vocabulary")
        inner = ids[:-1]
        try:
            if any(i in inner for i in self.controls):  # it parts the bytes beside it
                text = self._in_runs(ids)
            else:
                text = b"".join([self.bytes[i] for i in ids]).decode()
        except UnicodeDecodeError:
            text = self._in_runs(ids)
        first = next((i for i in ids if self.v.kinds[i] != "c"), None)
        starts = first is not None and self.v.kinds[first] == "n" and self.v.pieces[first][0] == SPACE
        return text[1:] if self.v.dummy_prefix and starts else text

    def _in_runs(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.v.kinds[i] == "b":
                run += self.bytes[i]
                continue
            out.append(_valid(run))
            run = b""
            if i >= 0:
                out.append(self.bytes[i].decode())
        return "".join(out)


def _valid(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_made: dict[tuple[type, int], object] = {}


def _once(kind: type, v: Vocabulary):
    """One encoder or decoder for each worker and vocabulary."""
    key = (kind, hash((v.pieces, v.scores)))
    if key not in _made:
        _made[key] = kind(v)
    return _made[key]


def _small(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows in batches of few, whose results take little memory in a worker."""
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            yield batch.slice(at, BATCH)


def _encoded(encoder: Encoder, texts: pa.Array, last: bytes) -> pa.Array:
    ids = [encoder.text(s.as_py() or "") + last for s in texts]
    ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def _decoded(decoder: Decoder, rows: pa.Array) -> pa.Array:
    ids, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    there = rows.is_valid().to_pylist()
    texts = [decoder.ids(ids[ends[i] : ends[i + 1]].tolist()) if there[i] else None for i in range(len(rows))]
    return pa.array(texts, pa.string())


def _end(v: Vocabulary, eos: bool) -> bytes:
    return np.array([v.eos] if eos else [], dtype=np.int32).tobytes()


def encode_column(spark: SparkSession, v: Vocabulary, eos: bool = True):
    """A function of a string column that gives array<int>; null is encoded as empty."""
    shared, last = spark.sparkContext.broadcast(v), _end(v, eos)  # of the vocabulary's size

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _once(Encoder, shared.value)
        for batch in _small(batches):
            yield _encoded(encoder, batch, last)

    return encode


def decode_column(spark: SparkSession, v: Vocabulary):
    """A function of an array<int> column that gives its text; null gives null."""
    shared = spark.sparkContext.broadcast(v)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _once(Decoder, shared.value)
        for batch in _small(batches):
            yield _decoded(decoder, batch)

    return decode


def coded_column(spark: SparkSession, v: Vocabulary, eos: bool = True):
    """A function of a string column that gives its ids and the text decoded from them; null is encoded as empty.

    Both are made in one worker; encode_column and decode_column in one stage take two for each task.
    """
    shared, last = spark.sparkContext.broadcast(v), _end(v, eos)

    @F.arrow_udf("struct<ids: array<int>, text: string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _once(Encoder, shared.value), _once(Decoder, shared.value)
        for batch in _small(batches):
            ids = _encoded(encoder, batch, last)
            yield pa.StructArray.from_arrays([ids, _decoded(decoder, ids)], names=["ids", "text"])

    return coded


def encode_texts(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    eos: bool = True,
) -> DataFrame:
    """id and ids (array<int>) of each row of docs.

    Null texts are encoded as empty ones, ids may be null or repeat, texts have any length;
    other columns are left out. An empty table gives none.
    """
    encode = encode_column(docs.sparkSession, vocabulary, eos)
    return docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text_col)).alias("ids"))


def decode_texts(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded with text, decoded from ids; null ids give null, an id out of range fails."""
    decode = decode_column(encoded.sparkSession, vocabulary)
    return encoded.withColumn("text", decode(F.col("ids")))
