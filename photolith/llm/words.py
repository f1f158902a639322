"""Words of a batch of texts as 64-bit hashes, all texts at once in numpy.

A word is a run of bytes other than the six ASCII white space characters; A-Z are lower-cased. Its hash is a polynomial
in an odd base modulo 2^64 over random numbers for bytes: two words have one hash with a chance of about 2^-60. Where
single bits of a hash matter, ``mix`` spreads it. Batches are worked on in slices of about ``SLICE`` bytes, cut between words, so memory beside the words
themselves doesn't depend on a text's length.

Nulls count as empty texts; texts without words have no hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C1B
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (splitmix64's finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Random numbers for bytes, and those by which upper and lower case A-Z are one.
EXACT = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE = EXACT[_LOWER]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0], have, step = 1, 1, x
        while have < n:
            p[have : 2 * have] = p[: min(have, n - have)] * _U(step)
            have, step = 2 * have, step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of string, large_string or binary arrays, without a copy; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not (wide or pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words; none reaches over the end of its text."""
    turns, before = [], False
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE]
        inside = np.empty(len(part) + 1, bool)
        inside[0] = before
        np.logical_and(part != 32, part - np.uint8(9) > 4, out=inside[1:])
        before = inside[-1]
        found = np.flatnonzero(inside[1:] != inside[:-1])
        # where a text begins within a word, the word before ends and another starts
        texts = np.unique(offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(part))]) - at
        texts = np.repeat(texts[inside[texts] & inside[texts + 1]], 2)
        turns.append(np.insert(found, np.searchsorted(found, texts), texts) + at if len(texts) else found + at)
    if before:
        turns.append(np.array([len(raw)]))
    both = np.concatenate(turns) if turns else np.zeros(0, np.int64)
    return both[::2], both[1::2]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray = _BYTE) -> np.ndarray:
    """The hash of each word, or of other slices that follow each other, over ``numbers`` for bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        size = int(e[-1])
        power, inverse = _powers(SLICE if size <= SLICE else 1 << size.bit_length())
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.take(numbers, raw[low : low + size], out=sums[1:], mode="clip")
        sums[1:] *= power[:size]
        np.cumsum(sums[1:], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end): text i has the words first[i] to first[i + 1]."""
    raw, offsets = utf8(texts)
    starts, ends = bounds(raw, offsets)
    return hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def last_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's last three bytes (or as many as it has) as a number."""
    found = _LOWER[raw[ends - 1]].astype(np.int32)
    for k in (2, 3):
        at = ends - k
        has = at >= starts
        found[has] |= _LOWER[raw[at[has]]].astype(np.int32) << 8 * (k - 1)
    return found


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mixed hash, last bytes) of every word, and each text's first word as in ``word_hashes``."""
    raw, offsets = utf8(texts)
    starts, ends = bounds(raw, offsets)
    return mix(hashes(raw, starts, ends)), last_bytes(raw, starts, ends), np.searchsorted(starts, offsets)
