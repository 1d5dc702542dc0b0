"""64-bit hashes of words and of runs of words, straight from the UTF-8 bytes of a batch of texts.

A run's hash is a polynomial over the hashes of its words (modulo 2**64, odd base), so that of
any run follows from one running sum over the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once, and powers that a worker keeps.
SLICE_BYTES = 1 << 20
KEPT_POWERS = SLICE_BYTES + 2

_M = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE, _WORD_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _M
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those of the usual sizes are kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, KEPT_POWERS), base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= KEPT_POWERS:
            _POWERS[base] = kept
    return kept[:n]


class _Sums:
    """Running sums from which the polynomial of any stretch follows."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = _powers(pow(base, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.multiply(values, _powers(base, n), out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _M)


class Words:
    """The words of a batch of texts in a row.

    count: words of each text; first: where each text's words begin; hash: of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        edges = offsets - offsets[0]
        if lower:
            raw = _LOWER[raw]
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        cut = np.zeros(len(raw) + 1, bool)  # texts touch in the buffer
        cut[edges] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.hash = _Sums(_BYTES[raw], _BYTE_BASE).of(start, end)
        self.first = np.searchsorted(start, edges)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]
        self._runs = None

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the words from start up to end."""
        if self._runs is None:
            self._runs = _Sums(self.hash, _WORD_BASE)
        return self._runs.of(start, end)

    def run_starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of n words within one text start, and how many each text has."""
        have = np.maximum(self.count - (n - 1), 0)
        total = int(have.sum())
        return np.arange(total) + np.repeat(self.first - (np.cumsum(have) - have), have), have


def slices(batch: pa.RecordBatch, rows: int = 1024, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows, and of so many bytes (of a list: items) in a column at most where a slice has several rows: hashing takes some 30 bytes of memory for each."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    of = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    of = of.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(of)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[at] - of[at] + size, side="right"))
        n = min(max(fits - at, 1), rows)
        yield batch.slice(at, n)
        at += n
