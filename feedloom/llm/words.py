"""Words of whole texts and their 64-bit hashes, for Arrow batches inside tasks.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z may be lowered. Texts are read from Arrow's
buffers and cut at word boundaries into stretches of bounded size, so a very long text needs no more working memory
than a short one beyond eight bytes or so per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
LENGTH = np.uint64(0xBF58476D1CE4E5B9)  # the weight of a word's length in its hash
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word, in order
    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    bounds: np.ndarray  # word offsets of the texts: text i has words bounds[i]:bounds[i + 1]
    data: np.ndarray  # the bytes


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 1)
        up = np.full(size, _ODD, dtype=np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = True) -> Words:
    data, offsets = text_bytes(column)
    return words_in(data, offsets, lower)


def words_in(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    hashes, starts, ends = [], [], []
    inner = offsets[:-1][offsets[:-1] < n]
    a = 0
    while a < n:
        b = min(a + STRETCH, n)
        while b < n and not (_SEPARATOR[data[b]] or _SEPARATOR[data[b - 1]]):  # a word does not end in the middle
            b += 1
        part = data[a:b]
        sep = _SEPARATOR[part]
        first = np.ones(b - a + 1, dtype=bool)  # a text starts here, or the stretch ends
        first[1:-1] = False
        first[inner[np.searchsorted(inner, a) : np.searchsorted(inner, b)] - a] = True
        word = ~sep
        is_start = word & (first[:-1] | np.concatenate(([True], sep[:-1])))
        is_end = word & (first[1:] | np.concatenate((sep[1:], [True])))
        s, e = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
        up, down = power_tables(b - a + 1)
        low = _LOWER[part] if lower else part
        total = np.empty(b - a + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _M1))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(h, start, end, np.searchsorted(start, offsets), data)


def hash_of(word: str | bytes, lower: bool = True) -> int:
    """The hash of one word, as ``words_of`` gives it."""
    raw = word.encode() if isinstance(word, str) else word
    return int(words_in(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), lower).hashes[0])


def word_hash(raw: bytes) -> int:
    """The same without arrays, as the word is written."""
    h, power = len(raw) * int(LENGTH), 1
    for b in raw:
        h += (b + 1) * power
        power = power * _ODD & _ALL
    h &= _ALL
    h = (h ^ h >> 30) * int(_M1) & _ALL
    h = (h ^ h >> 27) * int(_M2) & _ALL
    return h ^ h >> 31


def doc_of_word(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` items inside one text, and the index of their first item."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        g = g * _M2 + hashes[j : j + n]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(g[at]), at


def pieces(batches, most: int = 4 << 20):
    """Cut Arrow batches into slices of about ``most`` bytes each (at least one row), so working memory stays bounded."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most // max(batch.nbytes, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, min(step, n - i))
