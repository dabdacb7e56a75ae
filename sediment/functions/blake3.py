"""The public BLAKE3 hash, its output vectorised: the box has no module for it.

Chunks of 1024 bytes are lanes of one array and go through the compression together, tree levels likewise,
and an extended output of any length is one lane per output block.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the published algorithm.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK_BYTES, CHUNK_BYTES = 64, 1024

COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15))
DIAGONALS = ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(chain: list, words: list, counter: np.ndarray, length, flags) -> list[np.ndarray]:
    """All 16 output words of the compression, for any number of lanes at once."""
    lanes = len(counter)
    wide = lambda x: np.broadcast_to(np.asarray(x, np.uint32), (lanes,)).copy()
    low = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (counter >> np.uint64(32)).astype(np.uint32)
    chain = [wide(c) for c in chain]
    v = [*(c.copy() for c in chain), *(wide(x) for x in IV[:4]), low, high, wide(length), wide(flags)]
    m = list(words)
    for rnd in range(7):
        for i, (a, b, c, d) in enumerate(COLUMNS + DIAGONALS):
            v[a] = v[a] + v[b] + m[2 * i]
            v[d] = _turn(v[d] ^ v[a], 16)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], 12)
            v[a] = v[a] + v[b] + m[2 * i + 1]
            v[d] = _turn(v[d] ^ v[a], 8)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], 7)
        if rnd < 6:
            m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ chain[i] for i in range(8)]


def _words(blocks: np.ndarray) -> list[np.ndarray]:
    """(lanes, 64) bytes -> 16 little-endian words of each lane."""
    w = np.ascontiguousarray(blocks).view("<u4").astype(np.uint32)
    return [w[:, i].copy() for i in range(16)]


def _root(data: bytes) -> tuple[list, list, int, int]:
    """(chain, words, length, flags) of the node whose output is the hash."""
    n = len(data)
    chunks = max(1, -(-n // CHUNK_BYTES))
    padded = np.zeros(chunks * CHUNK_BYTES, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    lanes = padded.reshape(chunks, 16, BLOCK_BYTES)
    sizes = np.full(chunks, CHUNK_BYTES)
    sizes[-1] = n - (chunks - 1) * CHUNK_BYTES
    blocks = np.maximum(1, -(-sizes // BLOCK_BYTES))
    counter = np.arange(chunks, dtype=np.uint64)
    chain = [np.full(chunks, x, np.uint32) for x in IV]
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        length = np.minimum(BLOCK_BYTES, sizes[live] - b * BLOCK_BYTES).astype(np.uint32)
        flags = (np.uint32(CHUNK_START if b == 0 else 0) | np.where(last, np.uint32(CHUNK_END), np.uint32(0))).astype(np.uint32)
        words = _words(lanes[live, b])
        if chunks == 1 and last[0]:
            return [c[:1] for c in chain], words, int(length[0]), int(flags[0])
        out = compress([c[live] for c in chain], words, counter[live], length, flags)
        for i in range(8):
            chain[i][live] = out[i]
    level = np.stack(chain, 1)
    while True:
        pairs = len(level) // 2
        joined = [level[0 : 2 * pairs : 2, i] for i in range(8)] + [level[1 : 2 * pairs : 2, i] for i in range(8)]
        joined = [x.copy() for x in joined]
        if len(level) == 2:
            return list(IV), joined, BLOCK_BYTES, PARENT
        out = compress(list(IV), joined, np.zeros(pairs, np.uint64), BLOCK_BYTES, PARENT)
        above = np.stack(out[:8], 1)
        level = np.concatenate([above, level[2 * pairs :]])


def blake3(data: bytes, length: int = 32) -> bytes:
    """The unkeyed hash with `length` bytes of output."""
    chain, words, size, flags = _root(data)
    lanes = max(1, -(-length // BLOCK_BYTES))
    wide = [np.repeat(w, lanes) for w in words]
    out = compress([np.repeat(np.atleast_1d(np.asarray(c, np.uint32)), lanes) for c in chain], wide, np.arange(lanes, dtype=np.uint64), size, flags | ROOT)
    return np.stack(out, 1).astype("<u4").tobytes()[:length]
