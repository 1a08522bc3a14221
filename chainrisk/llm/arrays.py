"""Array helpers for the tasks: texts as byte arrays, words, hashes.

Tasks get Arrow batches.  A batch is cut into chunks of whole texts, so that
the 64-bit temporaries stay at a few dozen MB however large a batch is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15  # base of the polynomial; any odd number has an inverse
_INVERSE = pow(_ODD, -1, 1 << 64)
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class SpanHash:
    """64-bit hashes of any spans of one byte array, from one pass over it."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def grams(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, by start."""
        raw = (self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length]
        return mix(raw)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and where each text starts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    whole = np.frombuffer(data, np.uint8)[start:end] if end > start else np.zeros(0, np.uint8)
    return whole, offsets - start


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole texts of about ``limit`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_arrays(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            lo, hi = offsets[first], offsets[last]
            yield batch.slice(first, last - first), data[lo:hi], offsets[first : last + 1] - lo
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster than hashing for 64-bit numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; equal segments have equal sums wherever they lie."""
    out = np.zeros(len(starts))
    some = np.flatnonzero(ends > starts)
    if len(some):
        cuts = np.stack([starts[some], ends[some]], axis=1).reshape(-1)
        out[some] = np.add.reduceat(np.append(values, 0.0), cuts)[::2]
    return out


def split_by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (top bits) present in sorted hashes, and where each lies."""
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)]):
        if hi > lo:
            yield int(buckets[lo]), slice(lo, hi)


def longs(lists: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list<int64> column of 64-bit arrays."""
    ends = np.cumsum([0, *(len(x) for x in lists)])
    flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
