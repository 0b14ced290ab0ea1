"""Whole texts as arrays: word hashes and distinct word shingles of many documents at once.

Everything works on the UTF-8 bytes of an Arrow text column, a few megabytes at a time, so that
a task's memory depends on the longest document and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 2_000_000

#: Words in a shingle.
SHINGLE_WORDS = 5

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLDED_CODE = _BYTE_CODE[_LOWER]
_PLACE = mix(np.arange(901, 901 + 2 * SHINGLE_WORDS, dtype=np.uint64)) | _U(1)
_BASE = 0x9E3779B97F4A7C17 | 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES // 4), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Texts(NamedTuple):
    """Documents ``first`` .. of a batch: their bytes, and where each begins (one more entry
    for the end)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column in runs of about ``size`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words (runs without white space) begin and end."""
    white = _WHITE[texts.data]
    n = len(white)
    begin, end = ~white, ~white
    begin[1:] &= white[:-1]
    end[:-1] &= white[1:]
    edges = texts.starts[(texts.starts > 0) & (texts.starts < n)]
    begin[edges] |= ~white[edges]
    end[edges - 1] |= ~white[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(texts: Texts, fold: bool = True):
    """A function from begins and ends of spans to their 64-bit hashes, with A-Z lower-cased if
    ``fold``.

    One polynomial over all bytes, as running sums; a span's part of it is divided by the power
    of its place (the base is odd, so it has an inverse), which makes it the span's own.
    """
    n = len(texts.data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED_CODE if fold else _BYTE_CODE)[texts.data] * _power(_BASE, n), out=sums[1:])
    unshift = _power(_BASE_INV, n + 1)

    def hashes(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        own = (sums[end] - sums[begin]) * unshift[begin]
        return mix(own + (end - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    return hashes


def word_hashes(
    texts: Texts, begin: np.ndarray, end: np.ndarray, fold: bool = True
) -> np.ndarray:
    """A 64-bit hash of each span."""
    return span_hashes(texts, fold)(begin, end)


class Shingles(NamedTuple):
    """Distinct shingle hashes of documents, sorted within each; document i has
    ``hashes[ptr[i]:ptr[i + 1]]``."""

    ptr: np.ndarray
    hashes: np.ndarray


def shingles(texts: Texts, k: int = SHINGLE_WORDS) -> Shingles:
    """Distinct ``k``-word shingles of every document of the chunk; a document of fewer words
    has its whole sequence as the only one, and one without words has none."""
    begin, end = word_spans(texts)
    words = word_hashes(texts, begin, end)
    word_ptr = np.searchsorted(begin, texts.starts)
    n_words = np.diff(word_ptr)
    n_raw = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    raw_ptr = np.concatenate([[0], np.cumsum(n_raw)])
    raw = np.zeros(raw_ptr[-1], np.uint64)
    doc = np.repeat(np.arange(texts.count), n_raw)
    at = word_ptr[doc] + np.arange(len(raw)) - raw_ptr[doc]
    left = n_words[doc]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        raw += np.where(left > j, padded[at + j] * _PLACE[j], _PLACE[SHINGLE_WORDS + j])
    raw = mix(raw)
    for i in np.flatnonzero(n_raw > 1):
        raw[raw_ptr[i] : raw_ptr[i + 1]].sort()
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != raw[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Shingles(kept[raw_ptr], raw[keep])
