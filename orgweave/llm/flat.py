"""Texts of an Arrow batch as one run of bytes: words are found and equal ones grouped without a Python step for each.

A text is cut at ASCII white space, so no piece ends inside a character.  Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the contracts, by byte.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)``: all texts one after the other, and where each begins, then the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, n + 1, 8 * texts.offset)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _array(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of the texts, A-Z lower-cased if asked, and where each text's words begin, then the end."""
    buf, bounds = flat(texts)
    if not len(buf):
        return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    at = np.r_[np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)]
    return _array(buf[inside], at), np.searchsorted(starts, bounds)


def replaced(pieces: pa.LargeStringArray, values: Callable[[list[str]], list[tuple[bytes, bytes]]]) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
    """The two values of each piece; ``values`` is asked for the distinct pieces."""
    if not len(pieces):
        return (pa.array([], pa.large_binary()),) * 2
    d = pieces.dictionary_encode()
    found = values(d.dictionary.to_pylist())
    return tuple(pa.array([x[i] for x in found], pa.large_binary()).take(d.indices) for i in range(2))


def joined(pieces: pa.LargeBinaryArray, bounds: np.ndarray) -> list[memoryview]:
    """The pieces of each text, one after the other."""
    if not len(pieces):
        return [memoryview(b"")] * (len(bounds) - 1)
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64, len(pieces) + 1, 8 * pieces.offset)[bounds].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [data[a:z] for a, z in zip(at, at[1:])]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's begin, then the end."""
    import xxhash

    found, bounds = words(texts, lower)
    if not len(found):
        return np.zeros(0, np.uint64), bounds
    d = found.dictionary_encode()
    known = d.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[d.indices.to_numpy()], bounds
