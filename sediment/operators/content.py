"""The profiles that look at content alone: any bytes, and UTF-8 text."""

from __future__ import annotations

import numpy as np

from sediment.functions.gear import first_in, hashes_at, low_cuts
from sediment.functions.profiles import GENERIC, GENERIC_MASKS, MAX_CHUNK, MIN_CHUNK, TARGET_CHUNK, TEXT, TEXT_MASKS, Rejected
from sediment.operators.cuts import select

# Bytes at which text may be cut.
LINE_END = 0x0A
SOFT_SEAMS = b"\t\r ,;.}]>)"


def generic(data: bytes) -> list[int]:
    if len(data) <= MIN_CHUNK:
        return [len(data)] if data else []
    return select(len(data), *low_cuts(np.frombuffer(data, np.uint8), GENERIC, GENERIC_MASKS))


def check_utf8(data: bytes, before: int = 0, final: bool = True) -> int:
    """How far data, which stands behind `before` bytes, is whole scalars; a scalar cut off by the end is refused if it is final."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data":
            if not final:
                return before + e.start
            raise Rejected("stream ends inside a UTF-8 scalar", before + len(data)) from None
        if e.reason == "invalid start byte":
            raise Rejected("invalid UTF-8 lead byte", before + e.start) from None
        raise Rejected("invalid UTF-8 continuation byte", before + e.end) from None
    return before + len(data)


_SEAM = np.zeros(256, bool)
_SEAM[[LINE_END, *SOFT_SEAMS]] = True


def text_cuts(body: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ends at line ends by the strict mask, and at any seam by the relaxed one; `before` bytes precede body."""
    places = np.flatnonzero(_SEAM[body])
    h = hashes_at(body, TEXT, places)
    strict = places[((h & np.uint64(TEXT_MASKS[0])) == 0) & (body[places] == LINE_END)]
    return strict + 1 + before, places[(h & np.uint64(TEXT_MASKS[1])) == 0] + 1 + before


def text_end(strict: np.ndarray, relaxed: np.ndarray, start: int) -> int | None:
    """The end that the hash gives the chunk from `start` on; None if only the limit is left."""
    end = first_in(strict, start + MIN_CHUNK, start + TARGET_CHUNK - 1)
    return first_in(relaxed, start + TARGET_CHUNK, start + MAX_CHUNK - 1) if end is None else end


def text(data: bytes) -> list[int]:
    """Cuts behind line ends, later also behind softer seams; never inside a scalar."""
    check_utf8(data)
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    strict, relaxed = text_cuts(np.frombuffer(data, np.uint8))
    ends, start = [], 0
    while n - start > 0:
        end = text_end(strict, relaxed, start)
        if end is None:
            end = start + MAX_CHUNK
            while end < n and data[end] & 0xC0 == 0x80:
                end -= 1
        end = min(end, n)
        ends.append(end)
        start = end
    return ends
