"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string arrays; their UTF-8 buffers are viewed as numpy bytes and
worked on in slices of bounded size, so that memory does not follow the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on and later stages use it again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold() -> None:
    """Lets freed arrays of up to 32 MB be used again, and 64 MB of free memory stay, until release().

    These are the bounds that the C library itself goes up to. Below them each array of a slice is fresh memory,
    and a page that is touched for the first time costs more than the step that fills it."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def released(run: Callable[[Iterator], Iterator], holding: bool = False) -> Callable[[Iterator], Iterator]:
    """run, with release() at the end of each task, and hold() before it if that is asked for."""

    def whole(batches: Iterator) -> Iterator:
        if holding:
            hold()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the len + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `size` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other characters stay."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes outside [\\x20\\x09-\\x0D]; none spans two texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


BLOCK = 64
_STEP = _U(0xD6E8FEB86659FD93)


def _mixed_in(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """mix(h * _STEP + x), written into h."""
    h *= _STEP
    h += x
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> _U(shift)
        h *= _U(odd)
    h ^= h >> _U(31)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a step, each step multiplied and mixed whole, so that no two
    arrangements of the same blocks meet by construction. A span of more than BLOCK bytes is the hash of its
    blocks' hashes. Unlike seeds give independent hashes."""
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    out = mix(size.astype(np.uint64) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1))
    at = np.flatnonzero((size > 0) & (size <= BLOCK))
    place, left, h = start[at], size[at], out[at]
    while len(at):
        x = eight[place]
        short = left < 8
        x[short] &= (_U(1) << (left[short] * 8).astype(np.uint64)) - _U(1)
        h = _mixed_in(h, x)
        done = left <= 8
        out[at[done]] = h[done]
        more = ~done
        at, place, left, h = at[more], place[more] + 8, left[more] - 8, h[more]
    long = np.flatnonzero(size > BLOCK)
    if len(long):
        blocks = -(-size[long] // BLOCK)
        upto = np.cumsum(blocks)
        first = np.repeat(start[long] - BLOCK * (upto - blocks), blocks) + BLOCK * np.arange(upto[-1])
        # all blocks but the last of each span are whole: no masks, and all are done after the same steps
        last, inner = upto - 1, np.ones(len(first), dtype=bool)
        inner[last] = False
        place, parts = first[inner], np.empty(len(first), np.uint64)
        h = np.full(len(place), mix(np.full(1, BLOCK, np.uint64) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1))[0])
        for k in range(0, BLOCK, 8):
            h = _mixed_in(h, eight[place + k])
        parts[inner] = h
        parts[last] = span_hashes(data, first[last], (start + size)[long], seed)
        whole = span_hashes(parts.astype("<u8").view(np.uint8), 8 * (upto - blocks), 8 * upto, seed + 1)
        out[long] = _mixed_in(out[long], whole)
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each run of n words of one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = mix(h * _U(0xD6E8FEB86659FD93) + hashes[at + k] + _U(k + 1))
    return h, at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, sorted by text and hash, and the len + 1 bounds.

    A text of 1 to n - 1 words has one shingle, its whole sequence; one without words has none."""
    start, end, doc = words(data, offsets)
    hashes, m = span_hashes(data, start, end), len(offsets) - 1
    h, at = windows(hashes, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=m)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            short[more] = mix(short[more] * _U(0xD6E8FEB86659FD93) + hashes[first[more] + k] + _U(k + 1))
        h, owner = np.concatenate([h, mix(short + count[few].astype(np.uint64))]), np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(m + 1))


def minhashes(h: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima for each set, a column for each seed; an empty set has the largest value."""
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.full((len(bounds) - 1, len(seeds)), 0xFFFFFFFF, dtype=np.uint32)
    if len(full):
        low, high, at = h.astype(np.uint32), (h >> _U(32)).astype(np.uint32), bounds[full]
        x, y = np.empty_like(low), np.empty_like(low)  # written again for each seed
        for k, s in enumerate(seeds):
            np.multiply(low, np.uint32(s & 0xFFFFFFFF | 1), out=x)
            np.multiply(high, np.uint32(s >> 32 | 1), out=y)
            x ^= y
            np.right_shift(x, np.uint32(15), out=y)
            x ^= y
            x *= np.uint32(0x2C1B3C6D)
            np.right_shift(x, np.uint32(12), out=y)
            x ^= y
            out[full, k] = np.minimum.reduceat(x, at)
    return out
