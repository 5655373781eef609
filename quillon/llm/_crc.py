"""CRC-32 of many byte strings at once, put together from the CRCs of their parts."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_LANES = np.arange(256, dtype=np.uint32)


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for lane in (1, 2, 3):
        out = out ^ table[lane][(state >> np.uint32(8 * lane)) & np.uint32(255)]
    return out


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """The linear map of a CRC that 2**power zero bytes follow, as a table for each of its four bytes."""
    if power:
        half = _shift(power - 1)
        return _apply(half, half)
    step = _LANES.copy()
    for _ in range(8):
        step = np.where(step & np.uint32(1), (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    lanes = np.stack([_LANES << np.uint32(8 * lane) for lane in range(4)])
    return (lanes >> np.uint32(8)) ^ step[lanes & np.uint32(255)]


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of concatenations: of byte strings with CRC ``first``, and others with CRC ``second`` and ``length`` bytes."""
    out, power = np.asarray(first, np.uint32), 0
    while len(length) and int(length.max()) >> power:
        out = np.where((length >> power) & 1, _apply(_shift(power), out), out)
        power += 1
    return out ^ second


def crc_of(strings: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(x) for x in strings), np.uint32, len(strings))
