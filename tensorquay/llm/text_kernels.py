"""Vectorised text kernels on the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than the six ASCII white-space characters; as those are
single bytes in UTF-8, working on bytes equals working on code points.  Hashes are 64-bit:
a word's is a polynomial over random byte codes, read off a prefix sum, so the cost per byte
does not depend on the words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text handled by one call of a kernel; a longer single document is a slice of its own.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose outputs look independent (splitmix64's last steps)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=U) + U(start)) * U(_MULT)) | U(1)


_CODE = seeds(256, 1000)
_CODE_LOWER = _CODE[LOWER]
_GRAM = seeds(64, 5000)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _BASE_INV):
            t = np.full(size, U(base))
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers[:] = both
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text each; every row is in one."""
    if not batch.num_rows:
        return
    _, o = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, then give memory back to the system: workers live on after a task, and so would their peaks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


class Words:
    """The words of a slice: byte spans, hashes, and the number of words before each document."""

    def __init__(self, b: np.ndarray, offs: np.ndarray, lower: bool = False, separator: np.ndarray = SPACE):
        self.b, self.offs, n = b, offs, len(b)
        sep = np.ones(n + 1, bool)
        sep[:n] = separator[b]
        before = np.ones(n + 1, bool)
        before[1:] = sep[:-1]
        before[offs] = True
        start = ~sep & before
        self.start = np.flatnonzero(start)
        stop = before
        stop[0] = True
        inside = np.zeros(n + 1, bool)
        inside[1:] = ~sep[:-1]
        edge = sep.copy()
        edge[offs] = True
        self.stop = np.flatnonzero(inside & edge)
        self.first = np.searchsorted(self.start, offs)  # index of each document's first word
        self.count = np.diff(self.first)
        self._lower = lower
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.b, self.start, self.stop, self._lower)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _power_tables(len(b))
    total = np.zeros(len(b) + 1, U)
    np.cumsum((_CODE_LOWER if lower else _CODE)[b] * up[: len(b)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U) * U(_MULT))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` neighbours, across the whole array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n] * _GRAM[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _GRAM[j]
    return mix(out)


def whole(hashes: np.ndarray) -> U:
    """A hash of a whole sequence shorter than a window; differs from those of windows."""
    with np.errstate(over="ignore"):
        return mix(np.array([(hashes * _GRAM[: len(hashes)]).sum(dtype=U) + U(_MULT) * U(len(hashes) + 1)], U))[0]


def shingle_sets(b: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct ``k``-word shingles as sorted 64-bit hashes, A-Z lower-cased.

    Fewer than ``k`` words make one shingle of the whole sequence; no words, no shingle.
    """
    w = Words(b, offs, lower=True)
    h, out = w.hash, []
    g = grams(h, k)
    for first, n in zip(w.first[:-1].tolist(), w.count.tolist()):
        if n >= k:
            s = np.sort(g[first : first + n - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(np.array([whole(h[first : first + n])], U))
        else:
            out.append(np.zeros(0, U))
    return out
