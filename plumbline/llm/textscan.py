"""Words of whole Arrow batches as numpy arrays, without a Python loop over words.

UTF-8 is scanned as bytes: a byte class table says which bytes belong to words
and folds A-Z, which is exact for classes that treat every byte over 0x7F alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes scanned at once; a doc is never cut, so one doc may exceed it.
SLICE_BYTES = 1 << 21


def byte_table(is_word) -> np.ndarray:
    """256 entries: the folded byte, or 0 for a byte outside words."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if is_word(low):
            out[b] = low
    return out


#: Words are runs of anything but space, tab, newline, VT, FF and CR.
SPACED = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
SPACED[0] = 255  # a NUL is part of a word; 255 occurs nowhere in UTF-8
#: Words are runs of letters, digits and anything over 0x7F.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so sums of products become well spread hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) else column.type
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(kind)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first doc, last doc + 1) of runs of docs with about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """(start, end, doc, folded bytes) of every word; docs end words."""
    folded = classes[data]
    inside = folded != 0
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, folded
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc, folded


def scattered(code: np.ndarray, key: int) -> np.ndarray:
    """A pseudo-random number of each (place << 8 | byte), one set of numbers by key."""
    return mix(mix(code.astype(np.uint64) * MULTIPLIER + np.uint64(key)) + MULTIPLIER)


#: Bytes of a word whose numbers are looked up; those of later bytes are worked out.
_NEAR = 64
_tables: dict[int, np.ndarray] = {}


def _codes(folded: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(place << 8 | byte of every byte of words, first byte of each word, its length)."""
    length = end - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    return within << 8 | folded[folded != 0], first, length


def _hash(code: np.ndarray, first: np.ndarray, length: np.ndarray, key: int) -> np.ndarray:
    if key not in _tables:
        _tables[key] = scattered(np.arange(_NEAR << 8), key)
    table = _tables[key]
    if int(length.max()) <= _NEAR:
        value = table[code]
    else:
        near = code < len(table)
        value = np.empty(len(code), np.uint64)
        value[near] = table[code[near]]
        value[~near] = scattered(code[~near], key)
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * MULTIPLIER)


def word_hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes; folded holds no others but zeros.

    It is the sum of a pseudo-random number for every (place, byte), so, unlike a
    polynomial in an odd base, it has no words that collide by their structure.
    """
    return _hash(*_codes(folded, start, end), 0) if len(start) else np.zeros(0, np.uint64)


def word_digests(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word's folded bytes."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    codes = _codes(folded, start, end)
    return _hash(*codes, 1), _hash(*codes, 2)


def window_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entry i starts at word i (n - k + 1 entries)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = [pow(int(MULTIPLIER), j + 1, 1 << 64) for j in range(k)]
    total = word[:n] * np.uint64(factor[0])
    for j in range(1, k):
        total = total + word[j : j + n] * np.uint64(factor[j])
    return mix(total + np.uint64(k))
