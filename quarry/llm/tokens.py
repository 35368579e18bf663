"""Word boundaries and word hashes of many texts at once, in NumPy.

Texts come as Arrow's flat UTF-8 buffer; no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: SplitMix64's constants.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Where the hashes begin.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Keeps the first k bytes of a little-endian word.
HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offsets of each text's words."""
    low, high = int(offsets[0]), int(offsets[-1])
    solid = ~SPACE[data[low:high]]
    edge = np.zeros(high - low + 1, bool)
    edge[np.minimum(offsets, high) - low] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first) + low, np.flatnonzero(last) + 1 + low
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each word's length and bytes: eight at a time, each time mixed with all before."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = mixed((ends - starts).astype(np.uint64) ^ np.uint64(seed))
    low, high = int(starts[0]), int(ends[-1])
    padded = np.concatenate((data[low:high], np.zeros(8, np.uint8)))
    eights = np.ndarray((high - low + 1,), "<u8", padded, strides=(1,))
    at, left = starts - low, ends - starts
    some = None  # the words that are longer than what was read; all of them at first
    while True:
        x = eights[at] & HEAD[np.minimum(left, 8)]
        if some is None:
            out = mixed(out ^ x)
        else:
            out[some] = mixed(out[some] ^ x)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        some = more if some is None else some[more]
        at, left = at[more] + 8, left[more] - 8


def rolling(hashes: np.ndarray, k: int, seed: int = SEEDS[0]) -> np.ndarray:
    """A hash of each run of ``k`` word hashes; runs across texts are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * MIX_A
        out ^= out >> np.uint64(32)
    return mixed(out)


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses small numbers well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
