"""NumPy helpers over the UTF-8 bytes of whole texts, used inside Spark tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the word contracts: space and the controls 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trim() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and where each begins and ends; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(int(base), filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word `[^\\x20\\x09-\\x0D]+`, in order."""
    return word_spans(~WHITE[data], offsets)


def word_spans(dark: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each run of true bytes in one document, in order."""
    if not len(dark):
        return (np.zeros(0, np.int64),) * 3
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    first[heads] = dark[heads]
    last[:-1] &= ~dark[1:]
    last[tails] = dark[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, np.repeat(np.arange(len(counts)), counts)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial in a fixed odd base, mixed with the length.

    Prefix sums over about `step` bytes give every word in them; a longer word is added up in pieces.
    """
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    table, inverse = powers(MULTIPLIER, 2 * step), powers(INVERSE, 2 * step)
    prefix = np.zeros(2 * step + 1, np.uint64)

    def sums(a: int, b: int) -> np.ndarray:
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * table[: b - a], out=prefix[1 : b - a + 1])
        return prefix

    i = 0
    while i < len(start):
        at = int(start[i])
        j = int(np.searchsorted(end, at + step, "right"))
        if j > i:
            s, e = start[i:j] - at, end[i:j] - at
            p = sums(at, int(end[j - 1]))
            out[i:j] = (p[e] - p[s]) * inverse[s]
            i = j
        else:
            for k in range(at, int(end[i]), step):
                stop = min(k + step, int(end[i]))
                scale = np.uint64(pow(int(MULTIPLIER), k - at, 1 << 64))
                out[i : i + 1] += sums(k, stop)[stop - k : stop - k + 1] * scale
            i += 1
    return mix(out + ((end - start).astype(np.uint64) << np.uint64(48)))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every `width` consecutive words of one document, and their first words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(MULTIPLIER, len(hashes)), out=prefix[1:])
    out = prefix[inside + width] - prefix[inside]
    out *= powers(INVERSE, n)[inside]
    return mix(out), inside
