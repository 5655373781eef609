"""Vectorised hashing of pieces of UTF-8 texts inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once, unless one text is longer.
CHUNK = 1 << 20
_BASES, _GOLDEN = (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20260101).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = b"words"
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; ``span_hash`` gets the hash of any span from them. There are two."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_VALUES[which][data] * _power(_BASES[which], len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    inverse = _power(pow(_BASES[which], -1, 2**64), len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the keyed BLAKE2b digest of each span; spans are in order and don't overlap. A span that occurs again is
    digested once. Unlike the polynomial above, equal hashes of unlike spans can't be made up."""
    if not len(start):
        return np.zeros(0, np.uint64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, end, 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    lead = np.concatenate([[0], np.cumsum(end - start)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(lead), pa.py_buffer(data[inside])]).dictionary_encode()
    digests = b"".join(hashlib.blake2b(w, digest_size=8, key=_KEY).digest() for w in coded.dictionary.to_pylist())
    return np.frombuffer(digests, np.uint64)[coded.indices.to_numpy()]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; ``is_word``: a flag for each byte value. Runs end with rows."""
    return _spans(offsets, is_word[data], offsets[1:-1])


def _spans(offsets: np.ndarray, inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of what is inside, which end at every position of ``cut``."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = cut[(cut > 0) & (cut < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


#: ASCII letters (lower-case) and digits, and all bytes of other characters.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Second bytes of the letters and digits among U+0080 to U+00BF.
_LATIN_SIGNS = np.array([0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE], np.uint8)


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the tokens of lower-case UTF-8: runs of letters and digits, and single characters of scripts
    that are written without spaces. Spaces, punctuation and symbols of every script separate."""
    inside, cut = _TOKEN[data], offsets[1:-1]
    if not len(data) or data.max() < 128:
        return _spans(offsets, inside, cut)
    lead = np.flatnonzero(data >= 0xC2)
    after = lambda k: data[np.minimum(lead + k, len(data) - 1)]
    a, b, c = data[lead], after(1), after(2)
    wide = np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4))
    apart = (a == 0xC2) & ~np.isin(b, _LATIN_SIGNS) | (a == 0xC3) & ((b == 0x97) | (b == 0xB7))
    apart |= (a == 0xE2) & (b < 0xB0) | (a == 0xE3) & (b == 0x80) & ~((c >= 0x85) & (c <= 0x87)) | (a == 0xF0) & (b == 0x9F)
    apart |= (a == 0xEF) & (b == 0xBC) & ((c < 0x90) | (c >= 0x9A) & (c < 0xA1) | (c >= 0xBB))
    apart |= (a == 0xEF) & ((b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c < 0xA6)) | (b == 0xB8) | (b == 0xB9) | (b == 0xBB) & (c == 0xBF))
    for k in range(4):
        at = lead[apart & (wide > k)] + k
        inside[at[at < len(data)]] = False
    alone = (a >= 0xE4) & (a <= 0xE9) | (a == 0xE3) & (b > 0x80) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    alone |= (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a == 0xF0) & (b >= 0xA0) & (b < 0xB0)
    return _spans(offsets, inside, np.concatenate([cut, lead[alone], lead[alone] + wide[alone]]))


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each): the distinct word shingles of each row, sorted by row and hash. Words are runs of
    non-white-space with A-Z lower-cased; a row of fewer words than ``size`` has its whole sequence as one shingle."""
    start, end, row = word_spans(data, offsets, NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = word_hash(LOWER[data], start, end)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(word)) - first[row]
    h = np.zeros(len(word), np.uint64)
    for k in range(size):  # the words that exist; -1 marks those after a short row's end
        at = np.minimum(np.arange(len(word)) + k, len(word) - 1)
        there = place + k < n[row]
        h = mix(h * np.uint64(3) + np.where(there, word[at], np.uint64(k)))
    ok = (place + size <= n[row]) | (place == 0)
    h, row = h[ok], row[ok]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]
