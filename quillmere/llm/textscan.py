"""Words, spans and window hashes of whole Arrow text columns, in numpy.

Everything works on the UTF-8 bytes of many documents at once; nothing loops
over words in Python. Hashes are 64 bits wide and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text handled at once; a longer document is handled alone.
PIECE_BYTES = 1 << 20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers[base]
    if len(table) < n:
        steps = np.full(max(n, 2 * PIECE_BYTES), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.multiply.accumulate(steps)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of two parts that cover it."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, offsets = text_buffer(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each document's range."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Where the words of some documents are: byte ranges, owners, counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~WHITE[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        first = inside & ~before
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.count = per_doc(first, offsets)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)


class SpanHasher:
    """Content hashes of arbitrary byte ranges, independent of position."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data)), out=self.prefix[1:])
        self.inverse = _power_table(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by doubling the length.

    Windows across document ends are included; the caller masks them.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    current, have = words, 1
    while 2 * have <= length:
        current = join_hashes(current[:-have], current[have:])
        have *= 2
    if have < length:
        extra = length - have
        current = join_hashes(current[:-extra], current[extra:])
    return current


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values (doubling again)."""
    current, have = values, 1
    while 2 * have <= width:
        current = np.minimum(current[:-have], current[have:])
        have *= 2
    if have < width:
        extra = width - have
        current = np.minimum(current[:-extra], current[extra:])
    return current
