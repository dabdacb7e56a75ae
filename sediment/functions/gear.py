"""The rolling hash of content cuts, for all positions of a buffer at once.

h = 2 h + T[byte] modulo 2^64 sees the last 64 bytes only, so at position p it is the sum of T[b[p - k]] 2^k
over k below 64, whatever came before. Six doublings, H_2m(p) = H_m(p) + 2^m H_m(p - m), give it for every
position; a test of its n lowest bits needs the last n bytes only and runs in 32 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sediment.functions.blake3 import blake3
from sediment.functions.profiles import SEED

#: Bytes hashed at a time: what a pass holds is bounded and stays in cache.
SEGMENT = 1 << 19


@lru_cache(maxsize=None)
def table(profile: str) -> np.ndarray:
    return np.frombuffer(blake3(SEED.format(profile).encode(), 2048), ">u8").astype(np.uint64)


def _doubled(values: np.ndarray, window: int) -> np.ndarray:
    h, m = values, 1
    while m < window:
        nxt = h.copy()
        nxt[m:] += h[:-m] << h.dtype.type(m)
        h, m = nxt, 2 * m
    return h


def _segments(data: np.ndarray, lead: int):
    for a in range(0, len(data), SEGMENT):
        yield a, data[max(0, a - lead) : a + SEGMENT], min(lead, a)


def low_cuts(data: np.ndarray, profile: str, masks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ends (position + 1) at which the low bits of the hash are zero under the strict and the relaxed mask."""
    values = table(profile).astype(np.uint32)
    strict, relaxed = [], []
    for a, part, lead in _segments(data, 31):
        h = _doubled(values[part], 32)[lead:]
        loose = np.flatnonzero((h & np.uint32(masks[1])) == 0)
        relaxed.append(loose + a + 1)
        strict.append(loose[(h[loose] & np.uint32(masks[0])) == 0] + a + 1)
    return _joined(strict), _joined(relaxed)


def hashes_at(data: np.ndarray, profile: str, wanted: np.ndarray) -> np.ndarray:
    """The full hash at the sorted positions `wanted`."""
    values, out = table(profile), []
    for a, part, lead in _segments(data, 63):
        lo, hi = np.searchsorted(wanted, [a, a + SEGMENT])
        if lo < hi:
            h = _doubled(values[part], 64)[lead:]
            out.append(h[wanted[lo:hi] - a])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def first_in(ends: np.ndarray, lo: int, hi: int) -> int | None:
    """The least of the sorted ends in [lo, hi]."""
    i = int(np.searchsorted(ends, lo))
    return int(ends[i]) if i < len(ends) and ends[i] <= hi else None
