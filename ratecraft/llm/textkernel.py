"""Vectorised byte-level text kernels shared by the corpus operators.

Every kernel works on one chunk: a flat ``uint8`` buffer and the offsets of its
documents.  Chunks are cut from Arrow batches so that temporaries stay small; a
document is never divided, so one chunk can be longer than the target when a
single text is.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Target bytes of a chunk. Temporaries take about 50 bytes for each.
CHUNK_BYTES = 1 << 19

_MASK = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words from a seed."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D  # 5 modulo 8, so powers have a long period
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _stream(11, 256)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_COMBINE = _stream(23, 64) | np.uint64(1)
_LENGTH = _stream(37, 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        out = np.empty(size, np.uint64)
        out[0], filled, step = 1, 1, base
        while filled < size:
            take = min(filled, size - filled)
            np.multiply(out[:take], np.uint64(step), out=out[filled : filled + take])
            filled += take
            step = step * step & _MASK
        _powers[base] = have = out
    return have


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a partition's batches that gives freed memory back to the system at its end.

    Python workers are used again by later stages, so what one leaves to the allocator would add to what the next needs.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := _trim()) is not None:
            trim(0)

    return tidied


class Chunk(NamedTuple):
    """Documents ``first`` .. of a batch: bytes, and offsets with one more entry than documents."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts an Arrow string column into chunks; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(at, at[start] + target, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield Chunk(start, raw[at[start] : at[stop]], at[start : stop + 1] - at[start])
        start = stop


class Words(NamedTuple):
    """Byte spans of words, and for each document the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(chunk: Chunk) -> Words:
    """Maximal runs without the bytes 0x20 and 0x09-0x0D, within documents."""
    data, offsets = chunk.data, chunk.offsets
    inside = ~SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    cut = offsets[1:-1]
    ends_here = inside & ~after[1:]
    inner = cut[(cut > 0) & (cut < len(data))]
    ends_here[inner - 1] |= inside[inner - 1]
    ends = np.flatnonzero(ends_here) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; ``lower`` folds A-Z. Equal bytes give equal hashes in any chunk."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * _power(_BASE, n)[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * _power(_BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashes of its k-word shingles.

    A document of fewer words gives its whole sequence as one; one without words gives none.
    """
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1] * _COMBINE[0]
        for j in range(1, k):
            rolled += hashes[j : n - k + 1 + j] * _COMBINE[j]
        rolled = mix64(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield mix64((hashes[a:b] * _COMBINE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[b - a])
        else:
            yield hashes[:0]


def lines(chunk: Chunk) -> Words:
    """Spans between newlines, empty ones included; every document has one at least."""
    data, offsets = chunk.data, chunk.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    owner_end = np.repeat(offsets[1:], np.diff(first))
    ends = np.minimum(np.append(starts[1:] - 1, len(data)), owner_end)
    last = first[1:] - 1
    ends[last] = offsets[1:]
    return Words(starts, ends, first)


def per_document(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of a flat array between edges, as int64; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]
