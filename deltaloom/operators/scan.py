"""The exact scan: chunks and their index hits to matches. [F2-F5, D6]

Spark deals out the chunks with their old versions; in a task their offsets are probed
(``block_index.Index``), and what is left is the ordered choice among the hits, a fold over
the hits of one chunk, with state that starts anew in each chunk. Chunks are
scanned apart from each other. Between hits nothing can end a segment, so the fold goes from
hit to hit and counts equal bytes of whole stretches with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import batches
from ..functions.bytesops import as_array, prefix_of
from .block_index import Index

BETTER_BY = 8  # fixed: equal bytes by which a hit must beat the current alignment

MATCHES = (
    "pair_id string, chunk_idx int, seq int, add_old_start long, add_new_start long, "
    "add_length long, copy_end long, old_part binary, new_part binary"
)


def _equal_between(old: np.ndarray, new: np.ndarray, start: int, end: int, shift: int) -> int:
    """Positions i in [start, end) with new[i] == old[i + shift]."""
    start, end = max(start, -shift), min(end, len(old) - shift)
    return int(np.count_nonzero(old[start + shift : end + shift] == new[start:end])) if start < end else 0


def _best_length(gain: np.ndarray) -> int:
    """How many leading elements have the greatest positive sum; the fewest of equals."""
    if not len(gain):
        return 0
    sums = np.cumsum(gain)
    at = int(sums.argmax())
    return at + 1 if sums[at] > 0 else 0


def _votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where bytes agree, -1 where not."""
    return np.where(a == b, 1, -1)


class _Alignment:
    """Where the last segment began, and by how much old lies ahead of new there."""

    def __init__(self) -> None:
        self.new = self.old = self.shift = 0

    def close(self, old: np.ndarray, new: np.ndarray, scan: int, pos: int) -> tuple[int, ...]:
        """The segment up to scan, where new continues at pos of old; starts the next."""
        n = min(scan - self.new, len(old) - self.old)
        forward = _best_length(_votes(old[self.old : self.old + n], new[self.new : self.new + n]))
        back = 0
        if scan < len(new):
            n = min(scan - self.new, pos)
            back = _best_length(_votes(old[pos - n : pos], new[scan - n : scan])[::-1])
        overlap = self.new + forward - (scan - back)
        if overlap > 0:
            begin = scan - back
            ours = old[begin - self.new + self.old :][:overlap] == new[begin : begin + overlap]
            theirs = old[pos - back :][:overlap] == new[begin : begin + overlap]
            kept = _best_length(ours.astype(np.int64) - theirs)
            forward, back = forward - overlap + kept, back - kept
        out = (self.old, self.new, forward, scan - back)
        self.new, self.old, self.shift = scan - back, pos - back, pos - scan
        return out


def scan_chunk(
    old: np.ndarray, new: np.ndarray, at: np.ndarray, of: np.ndarray, block: int
) -> Iterator[tuple[int, ...]]:
    """(add_old_start, add_new_start, add_length, copy_end) of each match, in order.

    at, of: offsets of the hits in new, rising, and in old.
    """
    n, scan, length, pos, now = len(new), 0, 0, 0, _Alignment()
    while scan < n:
        scan += length
        equal, counted, stopped = 0, scan, False
        last_hit = last_pos = last_length = -1
        for i in range(int(np.searchsorted(at, scan)), len(at)):
            hit, start = int(at[i]), int(of[i])
            equal -= _equal_between(old, new, scan, min(hit, counted), now.shift)
            scan = hit
            if start - hit == last_pos - last_hit and hit < last_hit + last_length - block + 1:
                size = last_length - (hit - last_hit)  # on the same run as the hit before
            else:
                size = prefix_of(old[start:], new[hit:])
                if size < block:  # two blocks of one hash
                    continue
            last_hit, last_pos, last_length = hit, start, size
            begin, counted = max(counted, hit), max(counted, hit + size)
            equal += _equal_between(old, new, begin, counted, now.shift)
            if size > equal + BETTER_BY or size == equal:
                stopped = True
                break
        if stopped:
            pos, length = start, size
        else:
            scan, length, equal = n, 0, -1
        if length != equal or scan == n:
            yield now.close(old, new, scan, pos)


def exact_matches(spans: DataFrame, block: int) -> DataFrame:
    """Matches (MATCHES) of each chunk of spans, with offsets of new relative to it. [F5]

    One index serves all chunks of a span; a chunk has a hit for each of its bytes at most.
    An empty chunk has no matches.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for pair, first, size, old, new in zip(*(part[c] for c in _SPAN), strict=True):
                pair, first, size = pair.as_py(), first.as_py(), size.as_py()
                old, new = as_array(old.as_py()), as_array(new.as_py())
                index = Index(old, block)
                for i, start in enumerate(range(0, len(new), size)):
                    own = new[start : start + size]
                    for seq, (o, s, n, end) in enumerate(scan_chunk(old, own, *index.probe(own), block)):
                        yield pair, first + i, seq, o, s, n, end, old[o : o + n].tobytes(), own[s:end].tobytes()

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), _SCANNED)

    return spans.select(*_SPAN).mapInArrow(scan, MATCHES)


_SPAN = ("pair_id", "chunk_idx", "size", "old", "bytes")
_SCANNED = pa.schema(
    [("pair_id", pa.string()), ("chunk_idx", pa.int32()), ("seq", pa.int32())]
    + [(x, pa.int64()) for x in ("add_old_start", "add_new_start", "add_length", "copy_end")]
    + [("old_part", pa.binary()), ("new_part", pa.binary())]
)
