"""Secret scans: three patterns, and windows of high entropy in candidate strings.

Only DataFrame expressions are used. A pattern's places come from the lengths of the texts
between its matches. In a candidate (a long run of one class of characters) a window of fixed
width slides over the string; the counts of its characters and the sum of c*log2(c) over them
are changed by the character that comes in and the one that goes out, and the entropy follows
from that sum. Windows at or over the class's limit are joined into spans, unless the
candidate is on the allow list.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length, what a text must hold to be looked at
BASE = (
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        r"""[dDtTnNyY]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"[0-9a-f]+", 0, 32, r"(?<![0-9a-f])[0-9a-f]{32}"),
)
WINDOW = 20
#: kind, candidates, what a text must hold, what a candidate must hold of each, least entropy in bits
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]+", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20}", (r"[0-9]",), 3.0001),
    (
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]+",
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}",
        (r"[0-9]", r"[A-Z]", r"[a-z]"),
        3.8001,
    ),
)
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxxx|00000000|abcdefgh|12345678"
    r"|^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
_PLACES = "array<struct<start:int,end:int,value:string>>"
_RUNS = "array<struct<start:int,end:int>>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def _places(text: Column, pattern: str, group: int, least: int, guard: str) -> Column:
    """start, end and text of each leftmost match whose group has ``least`` characters.

    Matches that fail still use up their text. Null where the guard finds nothing.
    """
    each = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), _nothing(_PLACES).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["all"]), F.lit(0))
        place = F.struct(begin.alias("start"), end.alias("end"), x["all"].alias("value"))
        kept = F.when(F.length(x["part"]) >= least, F.concat(s["out"], F.array(place)))
        return F.struct(end.alias("at"), F.coalesce(kept, s["out"]).alias("out"))

    return F.when(text.rlike(guard), F.aggregate(each, start, step, lambda s: s["out"]))


def _weight(count: Column) -> Column:
    """count * log2(count), from a table: a count is at most the window's width."""
    table = [x * math.log2(x) if x else 0.0 for x in range(WINDOW + 2)]
    return F.element_at(F.array(*[F.lit(x) for x in table]), count + 1)


def entropy_runs(value: Column, limit: float) -> Column:
    """Stretches of value that are covered by windows of at least ``limit`` bits."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    codes = F.transform(chars, lambda c: F.array_position(kinds, c).cast("int"))
    start = F.struct(
        F.lit(0).alias("i"),
        F.transform(kinds, lambda _: F.lit(0)).alias("counts"),
        F.lit(0.0).cast("double").alias("sum"),
        _nothing(_RUNS).alias("runs"),
    )

    def moved(counts: Column, total: Column, code: Column, by: int) -> tuple[Column, Column]:
        old = F.element_at(counts, code)
        return (
            F.transform(counts, lambda c, k: F.when(k == code - 1, c + by).otherwise(c)),
            total + _weight(old + by) - _weight(old),
        )

    def step(s: Column, x: Column) -> Column:
        """x: the code that comes in and, once the window is full, the one that goes out."""
        left_counts, left_sum = moved(s["counts"], s["sum"], x["out"], -1)
        counts = F.when(x["out"] > 0, left_counts).otherwise(s["counts"])
        total = F.when(x["out"] > 0, left_sum).otherwise(s["sum"])
        counts, total = moved(counts, total, x["in"], 1)
        i = s["i"] + 1
        high = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
        begin, last = i - WINDOW, F.try_element_at(s["runs"], F.lit(-1))
        joins = F.coalesce(last["end"] >= begin, F.lit(False))
        run = F.struct(
            F.when(joins, last["start"]).otherwise(begin).alias("start"), i.alias("end")
        )
        before = F.when(joins, F.slice(s["runs"], 1, F.size(s["runs"]) - 1)).otherwise(s["runs"])
        runs = F.when(high, F.concat(before, F.array(run))).otherwise(s["runs"])
        return F.struct(i.alias("i"), counts.alias("counts"), total.alias("sum"), runs.alias("runs"))

    out = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    pairs = F.transform(
        codes, lambda c, i: F.struct(c.alias("in"), F.element_at(out, i + 1).alias("out"))
    )
    return F.aggregate(pairs, start, step, lambda s: s["runs"])


def secret_spans(text: Column) -> Column:
    """All spans of a text by start, then kind: base kinds first, then those of the method.

    start and end count code points, end exclusive. A null text is empty and has none.
    """
    text = F.coalesce(text, F.lit(""))
    found = []
    for rank, (kind, pattern, group, least, guard) in enumerate(BASE):
        places = _places(text, pattern, group, least, guard)
        found.append(F.transform(places, _marked(kind, rank)))
    for rank, (kind, pattern, guard, must, limit) in enumerate(CLASSES, len(BASE)):
        candidates = F.filter(_places(text, pattern, 0, WINDOW, guard), _suspicious(must))
        runs = F.transform(candidates, _high_runs(limit))
        found.append(F.transform(F.flatten(runs), _marked(kind, rank)))
    none = _nothing(SPANS)
    return F.array_sort(F.concat(*[F.coalesce(x.cast(SPANS), none) for x in found]))


def _marked(kind: str, rank: int):
    def mark(place: Column) -> Column:
        return F.struct(
            place["start"], F.lit(rank).alias("rank"), place["end"], F.lit(kind).alias("kind")
        )

    return mark


def _suspicious(must: tuple[str, ...]):
    def test(place: Column) -> Column:
        holds = [place["value"].rlike(m) for m in must]
        return reduce(lambda a, b: a & b, holds) & ~place["value"].rlike(ALLOWED)

    return test


def _high_runs(limit: float):
    def runs(place: Column) -> Column:
        return F.transform(
            entropy_runs(place["value"], limit),
            lambda r: F.struct(
                (place["start"] + r["start"]).alias("start"),
                (place["start"] + r["end"]).alias("end"),
            ),
        )

    return runs


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of each row of docs.

    One row for each row: repeated ids stay, null texts are empty, an empty table gives none.
    """
    spans = secret_spans(F.col(text_col)).alias("spans")
    return docs.select(F.col(id_col).alias("doc_id"), spans)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"),
        )

    rest = F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
