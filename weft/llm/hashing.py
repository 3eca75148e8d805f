"""Vectorised word hashes over UTF-8 bytes, without a Python object for each word, and digests."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
SLICE = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Bytes of a word that are hashed eight at a time; longer words have a digest.
LANED = 64
#: Masks of the first 0 to 8 bytes of eight.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, mod 2 ** 64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _MUL), ("down", _INV)):
            out = np.ones(1, U64)
            while len(out) < size:  # doubled: base ** (i + len) = base ** i * base ** len
                out = np.concatenate([out, out * U64(pow(base, len(out), 2**64))])
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values, len(values) - width + 1 of them."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    up, down = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def words(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end, and a 64-bit hash of each; words are runs without ``space`` bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space[data], [True]])))
    start, end = edge[::2], edge[1::2]
    return start, end, word_hashes(data, start, end)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some runs of bytes.

    Eight bytes at a time are scrambled into the hash of those before, which unlike a polynomial has no
    strings that it takes for each other whatever its constants; a word of more than LANED bytes has its
    BLAKE2b digest. Words of up to 8 bytes never share a hash with others of their length.
    """
    size = end - start
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))  # the eight bytes from each place on
    out = size.astype(U64) * U64(_MUL)
    todo, left, at = np.arange(len(start)), size, start
    for _ in range(LANED // 8):
        if not len(todo):
            return out
        lane = eight[at] & HEAD[np.minimum(left, 8)]
        out[todo] = mix(out[todo] * U64(5) ^ lane)
        more = left > 8
        todo, left, at = todo[more], left[more] - 8, at[more] + 8
    for k in todo.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2b digests of some runs of bytes, as two columns. Texts are taken for equal by these alone, never by the hashes above."""
    view, blake = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row's begin (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes together; a longer row is a run of its own."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j
        i = j


def row_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: word starts, ends and hashes, and the index of each row's first word (one more at the end).

    A word never runs from one row into the next.
    """
    starts, ends, hashes, counts = [], [], [], []
    for i, j in slices(at):
        part, bound = data[at[i] : at[j]], at[i : j + 1] - at[i]
        wide = np.full(len(part) + (j - i), 32, np.uint8)  # a space after each row
        shift = np.repeat(np.arange(j - i), np.diff(bound))
        wide[np.arange(len(part)) + shift] = part
        a, b, h = words(wide, space)
        row = np.searchsorted(bound[1:] + np.arange(1, j - i + 1), a, side="right")
        starts.append(a - row + at[i])
        ends.append(b - row + at[i])
        hashes.append(h)
        counts.append(np.bincount(row, minlength=j - i))
    if not counts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def release() -> None:
    """Give what a task has freed back to the system: workers live on from task to task beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with GNU's library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches_of(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column of text holds about ``size`` bytes; a longer row comes alone."""
    for b in batches:
        _, at = texts_of(b.column(column))
        for i, j in slices(at, size):
            yield b.slice(i, j - i)
    release()
