"""Words of Arrow string columns as arrays: places and 64-bit hashes, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 500_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _tables[size] = out[0], out[1]
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words [^\\x20\\x09-\\x0D]+ of some texts, one after another."""

    data: np.ndarray  # the texts' bytes, as they are
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # by text, its first word's number; one more at the end
    hash: np.ndarray  # of each word's bytes, after folding if asked for

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def words(column: pa.Array, fold: bool = False) -> Words:
    at, data = _buffers(column)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    n = len(data)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & ~(before & ~cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(((LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, start, end, np.searchsorted(start, at), h)


def blocks(batch: pa.RecordBatch, text: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about size bytes of text; a longer text stands alone."""
    at, _ = _buffers(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
