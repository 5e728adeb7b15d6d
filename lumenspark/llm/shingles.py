"""Hashed word shingles of many texts at once, in numpy on the bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_RANDOM = np.random.default_rng(20240501)
_PLACE = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 8 + 5
_SEED = _RANDOM.integers(0, 1 << 64, 1, np.uint64)[0] | np.uint64(1)
#: Words up to this many bytes are hashed eight bytes at a time, longer ones by xxh3.
SHORT = 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _BASE % 2**64, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (with a last entry for the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places of bytes in lower case.  Each eight bytes are mixed in before the next, so no sum of
    powers can cancel out: words of up to eight bytes differ always, others but for chance."""
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))
    out = size.astype(np.uint64) * _SEED
    left = np.flatnonzero(size <= SHORT)
    for k in range(0, SHORT, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        out[left] = mixed(out[left] ^ (eight[starts[left] + k] & _FIRST[np.minimum(size[left] - k, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts (bytes, places as by ``text_bytes``), and the number of words before each text and in all."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_WHITE[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return word_hashes(_LOWER[raw], starts, ends), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles (64-bit hashes as int64, ascending) of each text; with fewer words, the whole sequence as one."""
    word, first = words(*text_bytes(column))
    m = len(word) - size + 1
    if m > 0:
        grams = np.zeros(m, np.uint64)
        for k in range(size):
            grams += word[k : k + m] * _PLACE[k]
        grams = mixed(grams).view(np.int64)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        c = high - low
        if c >= size:
            out.append(np.unique(grams[low : high - size + 1]))
        elif c:
            out.append(mixed((word[low:high] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
