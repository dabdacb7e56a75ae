"""Selecting chunk ends among cut candidates: content only, and content with structure."""

from __future__ import annotations

import numpy as np

from sediment.functions.gear import first_in
from sediment.functions.profiles import MAX_CHUNK, MIN_CHUNK, TARGET_CHUNK


def next_cut(strict: np.ndarray, relaxed: np.ndarray, start: int, after: int) -> int:
    """The end of the chunk that begins at `start`, judged from position `after` + 1 on: the limit at the latest."""
    lo = max(after + 1, start + MIN_CHUNK)
    if lo < start + TARGET_CHUNK and (end := first_in(strict, lo, start + TARGET_CHUNK - 1)) is not None:
        return end
    lo = max(lo, start + TARGET_CHUNK)
    if lo < start + MAX_CHUNK and (end := first_in(relaxed, lo, start + MAX_CHUNK - 1)) is not None:
        return end
    return max(after + 1, start + MAX_CHUNK)


def select(n: int, strict: np.ndarray, relaxed: np.ndarray) -> list[int]:
    """Greedy ends over a stream of n bytes; what is left at the end is the last chunk."""
    ends, start = [], 0
    while n - start > 0:
        end = next_cut(strict, relaxed, start, start)
        if end >= n:
            ends.append(n)
            break
        ends.append(end)
        start = end
    return ends


class Assembly:
    """Chunk ends of a stream of structural units.

    `units` are events in stream order: ("unit", at) where a unit begins, ("large", at, header) once the
    header of a unit with a large payload has passed. The last chunk is held back so that a small rest can
    join it; content cuts fall between events.
    """

    def __init__(self, strict: np.ndarray, relaxed: np.ndarray, unit_min: int = MIN_CHUNK) -> None:
        self.strict, self.relaxed, self.unit_min = strict, relaxed, unit_min
        self.ends: list[int] = []
        #: The held chunk is [held, start), the open one [start, at); no chunk is held while held == start.
        self.held = self.start = self.at = 0

    def close(self, at: int) -> None:
        if self.held < self.start:
            self.ends.append(self.start)
        self.held, self.start = self.start, at

    def join(self, at: int) -> bool:
        """Let the open bytes up to `at` join the held chunk, if there is one and they fit."""
        if self.held == self.start or at - self.held > MAX_CHUNK:
            return False
        self.start = at
        return True

    def advance(self, at: int) -> None:
        while self.at < at:
            end = next_cut(self.strict, self.relaxed, self.start, self.at)
            if end > at:
                break
            self.close(end)
            self.at = end
        self.at = at

    def unit(self, at: int) -> None:
        self.advance(at)
        if at - self.start >= self.unit_min:
            self.close(at)
        elif at > self.start:
            self.join(at)

    def large(self, at: int, header: int) -> None:
        self.advance(at)
        if at - self.start > header and not self.join(at - header):
            self.close(at - header)

    def finish(self, n: int) -> list[int]:
        self.advance(n)
        if self.held < self.start:
            self.ends.append(self.start)
        if self.start < n:
            self.ends.append(n)
        return self.ends


def assemble(n: int, units: list[tuple], strict: np.ndarray, relaxed: np.ndarray, unit_min: int = MIN_CHUNK) -> list[int]:
    assembly = Assembly(strict, relaxed, unit_min)
    for unit in units:
        if unit[0] == "unit":
            assembly.unit(unit[1])
        else:
            assembly.large(unit[1], unit[2])
    return assembly.finish(n)
