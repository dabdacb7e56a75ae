"""Reading a stream of which only a part is at hand: bytes that arrive in windows, and readers that can wait for more.

A reader takes one record a step. A step that lacks bytes changes nothing and is tried again when more have
come, so what a reader holds between windows is its few fields and the bytes of one open record; payloads it
has no use for are stepped over before they arrive.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

from sediment.functions.profiles import Rejected


class Starved(Exception):
    """A record goes on behind what has arrived."""


class Tape:
    """The bytes [base, end) of a stream. `final`: no more will come."""

    def __init__(self, data: bytes = b"", final: bool = True) -> None:
        self.data, self.base, self.final = data, 0, final

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def append(self, window: bytes) -> None:
        self.data = self.data + window if self.data else bytes(window)

    def drop(self, upto: int) -> None:
        """Forget the bytes below `upto`."""
        upto = min(upto, self.end)
        if upto > self.base:
            self.data, self.base = self.data[upto - self.base :], upto

    def byte(self, at: int) -> int:
        return self.data[at - self.base]

    def cut(self, a: int, b: int) -> bytes:
        return self.data[a - self.base : b - self.base]

    def find(self, wanted: bytes, at: int) -> int:
        found = self.data.find(wanted, at - self.base)
        return found + self.base if found >= 0 else -1

    def match(self, pattern, at: int):
        """pattern.match at a place; its positions are relative to `base`."""
        return pattern.match(self.data, at - self.base)

    def search(self, pattern, at: int, upto: int | None = None):
        return pattern.search(self.data, at - self.base, len(self.data) if upto is None else max(0, upto - self.base))


class Reader:
    """Records of a format, in stream order. `pos` is where the next record begins, perhaps behind what has arrived."""

    def __init__(self) -> None:
        self.pos = 0

    def fault(self, kind: str, at: int) -> Rejected:
        raise NotImplementedError

    #: What a stream that ends inside a record is refused for.
    cut_off = "truncated"

    def reach(self, tape: Tape, end: int) -> int:
        """`end`, once the bytes before it have arrived."""
        if end > tape.end:
            if not tape.final:
                raise Starved
            raise self.fault(self.cut_off, tape.end)
        return end

    def step(self, tape: Tape) -> list | None:
        """The events of the next record; None if it can't go on, though what it has learnt stays."""
        raise NotImplementedError

    def more(self, tape: Tape) -> bool:
        return self.pos < tape.end

    def feed(self, tape: Tape) -> Iterator:
        """Events as they are read, so that who takes one may refuse it before the next is read."""
        while self.more(tape):
            mark = {k: copy.copy(v) if isinstance(v, list) else v for k, v in vars(self).items()}
            try:
                found = self.step(tape)
            except Starved:
                vars(self).update(mark)
                break
            if found is None:
                break
            yield from found

    def finish(self, n: int) -> None:
        """Refuse a stream of n bytes that ends too early."""

    def read(self, data: bytes) -> list:
        """All events of a value in memory."""
        out = list(self.feed(Tape(data)))
        self.finish(len(data))
        return out
