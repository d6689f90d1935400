"""Numpy kernels over the texts of an Arrow batch: words, their hashes and n-grams.

A batch is read as one run of UTF-8 bytes.  Words of all its texts are found and hashed at
once, without a Python object for each word.  Long runs are cut at word ends into blocks, so
the memory that hashing needs is bounded whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte tables: 0 separates words, other bytes are themselves (or what they fold to); NUL is 256.
LINES = np.arange(256, dtype=np.uint16)
LINES[0] = 256
LINES[0x0A] = 0
WHITE_SPACE = LINES.copy()
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
FOLDED_WHITE_SPACE = WHITE_SPACE.copy()
FOLDED_WHITE_SPACE[65:91] += 32
ALPHANUMERIC = FOLDED_WHITE_SPACE.copy()
ALPHANUMERIC[:128][[not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(128)]] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def batches(texts: pa.Array, most: int = 2 * BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes (one text at least), each with the index of its first text."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, hash) of every word, in order, and the number of words of each text.

    Start and end are byte positions in the batch's data; hashes depend on the folded bytes only.
    """
    data, offsets = buffers(texts)
    low, high = int(offsets[0]) if len(texts) else 0, int(offsets[-1]) if len(texts) else 0
    if high == low:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.zeros(high - low + 1, bool)
    first[offsets[:-1] - low] = True
    starts, ends, hashes = [], [], []
    at = low
    while at < high:
        end = min(high, at + BLOCK)
        while end < high and table[data[end]] and not first[end - low]:  # to the end of the word
            some = slice(end, min(high, end + 4096))
            stop = np.flatnonzero((table[data[some]] == 0) | first[some.start - low : some.stop - low])
            end = end + int(stop[0]) if len(stop) else some.stop
        b = table[data[at:end]]
        word = b > 0
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[at - low + 1 : end - low]
        s = np.flatnonzero(begins)
        stops = word.copy()
        stops[:-1] &= ~word[1:] | first[at - low + 1 : end - low]
        e = np.flatnonzero(stops) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(b) + 1, _BASE, np.uint64))
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            inverse = np.cumprod(np.full(len(b) + 1, _BASE_INVERSE, np.uint64))
            h = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        starts.append(s + at), ends.append(e + at), hashes.append(mix(h))
        at = end
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    cuts = np.searchsorted(s, offsets)
    counts = np.diff(cuts)
    return np.repeat(np.arange(len(texts)), counts), s, e, h, counts


def ngrams(document: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the n consecutive words at each place, within one text."""
    if len(hashes) < n:
        return document[:0], hashes[:0]
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = mix(h * _BASE + hashes[k : k + size])
    whole = document[:size] == document[n - 1 :]
    return document[:size][whole], h[whole]
