"""Where the items of a PDF body begin. Streams of known length are stepped over; objects are read token by token."""

from __future__ import annotations

import re

from sediment.functions.profiles import Rejected
from sediment.operators.tape import Reader, Starved, Tape

# Fixed values of the format, its bounds, and the frozen rejection texts.
MAGIC, END_STREAM, EOF = b"%PDF-", b"endstream", b"%%EOF"
BLANK = frozenset(b"\0\t\n\x0c\r ")
ASCII_BLANK = frozenset(b"\t\n\x0c\r ")
TOKEN_LIMIT, LINE_LIMIT, XREF_ENTRY = 10, 128, 20
TEXTS = {
    "NotPdf": "stream does not begin with %PDF-",
    "BadObjectHeader": "indirect object header is not 'number generation obj'",
    "BadKeyword": "unknown body keyword",
    "BadStreamEol": "stream keyword is not followed by a line end",
    "XrefGeometry": "malformed xref subsection",
    "Truncated": "document ends inside an object, stream, xref table, or trailer",
    "MissingEof": "document ends without %%EOF",
}

_PIECE = re.compile(rb"(?P<blank>[\0\t\n\x0c\r ]+)|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<open><<)|(?P<close>>>)|(?P<hex><[^<])|(?P<string>\()|(?P<comment>%)|(?P<name>/)|(?P<mark>[\[\]{})>])", re.S)
_PAREN = re.compile(rb"[()\\]")
_LINE_END = re.compile(rb"[\r\n]")
_INT = re.compile(rb"[0-9]+\Z")
_WORD = re.compile(rb"[a-z]+")


def fault(kind: str, at: int) -> Rejected:
    return Rejected(TEXTS[kind], at)


class Tokens:
    """Tokens of an object or trailer from a position on, with what a dictionary says of a stream's length.

    Every token read is kept in the fields, so a run that lacks bytes goes on where it stopped.
    """

    def __init__(self, at: int) -> None:
        self.at, self.depth, self.opened, self.named = at, 0, False, False
        #: The direct /Length of the outermost dictionary, and how many integers came behind it.
        self.length: int | None = None
        self.wanted, self.behind = False, 0

    def word(self, token: bytes) -> str | None:
        """What a finished token means: the start of a stream, the end of the object, or nothing."""
        value = int(token) if _INT.match(token) and len(token) <= TOKEN_LIMIT else None
        if len(token) <= TOKEN_LIMIT and not self.named:
            if token == b"stream":
                return "stream"
            if token == b"endobj":
                return "end"
            if token == b"R":
                if self.length is not None and self.behind == 1:
                    self.length = None
                return None
        if self.named:
            value = None
            if token == b"Length" and self.depth == 1:
                self.wanted, self.length = True, None
                return None
        if self.wanted:
            self.wanted, self.length, self.behind = False, value, 0
        elif self.length is not None and value is not None:
            self.behind += 1
        return None

    def run(self, reader: Reader, tape: Tape, until: str) -> str:
        """Go on to the next signal of interest; `at` is then behind the byte that gave it."""
        lacking = lambda: reader.reach(tape, tape.end + 1)
        while True:
            m = tape.match(_PIECE, self.at)
            if m is None:
                lacking()
            kind, end = m.lastgroup, m.end() + tape.base
            if end == tape.end and (kind == "word" or not tape.final and m.group() == b">"):
                lacking()
            if kind == "word":
                signal = self.word(tape.cut(self.at, end))
                self.named = False
                if signal and until == "object":
                    self.at = end + 1
                    return signal
                self.at = end
                continue
            after = end
            if kind == "hex" and tape.byte(end - 1) != 0x3E:
                after = tape.find(b">", end) + 1 or lacking()
            elif kind == "comment":
                stop = tape.search(_LINE_END, end)
                after = stop.end() + tape.base if stop else lacking()
            elif kind == "string":
                level = 1
                while level:
                    p = tape.search(_PAREN, after)
                    if p is None:
                        lacking()
                    after = p.end() + tape.base + (p.group() == b"\\")
                    level += {b"(": 1, b")": -1}.get(p.group(), 0)
                if after > tape.end:
                    lacking()
            self.at, self.named = after, kind == "name"
            if kind == "open":
                self.depth, self.opened = self.depth + 1, True
            elif kind == "close":
                self.depth = max(0, self.depth - 1)
                if not self.depth and self.opened and until == "dict":
                    return "closed"


class Items(Reader):
    """A unit wherever an item of the body may begin and no white space follows.

    Payloads of known length are stepped over, others searched for their end as they come.
    """

    fault = staticmethod(fault)
    cut_off = "Truncated"

    def __init__(self) -> None:
        super().__init__()
        self.state, self.ended = "magic", False
        self.tokens: Tokens | None = None
        #: Bytes of the word that ends a stream found so far; where the trailer's first word ends; what follows it.
        self.matched, self.until, self.floor = 0, 0, 0

    def more(self, tape: Tape) -> bool:
        # at the end of a final tape an open item has its say
        return self.pos < tape.end or tape.final and self.pos == tape.end and self.state != "item"

    def step(self, tape: Tape) -> list | None:
        return getattr(self, f"_{self.state}")(tape)

    def _magic(self, tape: Tape) -> list:
        for k, byte in enumerate(MAGIC):
            if k >= tape.end:
                if not tape.final:
                    raise Starved
                raise fault("NotPdf", tape.end)
            if tape.byte(k) != byte:
                raise fault("NotPdf", k + 1)
        self.state, self.pos = "first_line", len(MAGIC)
        return []

    def _first_line(self, tape: Tape) -> list | None:
        stop = tape.search(_LINE_END, self.pos)
        if stop is None:
            if tape.final:
                raise fault("NotPdf", tape.end)
            self.pos = tape.end
            return None
        self.state, self.pos = "item", stop.end() + tape.base
        return []

    def _item(self, tape: Tape) -> list:
        at, byte = self.pos, tape.byte(self.pos)
        out = [("unit", at)] if byte not in ASCII_BLANK else []
        if byte in BLANK:
            self.pos += 1
            return out
        self.ended = False
        if byte == 0x25:
            stop = tape.search(_LINE_END, at)
            if stop is None:
                if not tape.final:
                    raise Starved
                raise fault("MissingEof", tape.end)
            self.pos = stop.end() + tape.base
            self.ended = tape.cut(at, stop.start() + tape.base) == EOF
        elif 0x30 <= byte <= 0x39:
            self._open(self._header(tape, at + 1))
        elif byte in b"xts":
            self._keyword(tape, at)
        else:
            raise fault("BadKeyword", at + 1)
        return out

    def _open(self, at: int) -> None:
        self.tokens, self.state, self.pos = Tokens(at), "object", at

    def _header(self, tape: Tape, at: int) -> int:
        """From behind the first digit of an object's header to behind the word obj."""
        numbers, digits = 0, True
        while True:
            self.reach(tape, at + 1)
            byte = tape.byte(at)
            at += 1
            if 0x30 <= byte <= 0x39:
                digits = True
                continue
            numbers, digits = numbers + digits, False
            if byte in BLANK:
                if numbers > 2:
                    raise fault("BadObjectHeader", at)
            elif byte not in b"obj" or numbers != 2:
                raise fault("BadObjectHeader", at)
            elif byte == 0x6A:
                return at

    def _keyword(self, tape: Tape, at: int) -> None:
        word = tape.match(_WORD, at)
        end = word.end() + tape.base
        if end - at > TOKEN_LIMIT:
            raise fault("BadKeyword", at + TOKEN_LIMIT + 1)
        self.reach(tape, end + 1)
        if word.group() == b"xref":
            self.state, self.pos = "xref", end + 1
        elif word.group() == b"trailer":
            self.tokens, self.state, self.pos, self.until, self.floor = Tokens(end), "trailer", end, 0, 0
        elif word.group() == b"startxref":
            digits, end = tape.cut(end, end + 1).isdigit(), end + 1
            while True:
                self.reach(tape, end + 1)
                c = tape.byte(end)
                end += 1
                if 0x30 <= c <= 0x39:
                    digits = True
                elif c not in BLANK:
                    raise fault("BadKeyword", end)
                elif digits:
                    break
            self.pos = end
        else:
            raise fault("BadKeyword", end + 1)

    def _ran(self, tape: Tape, until: str) -> str | None:
        """The next signal of the open tokens; None if they lack bytes, though what they have read stays read."""
        try:
            signal = self.tokens.run(self, tape, until)
        except Starved:
            signal = None
        self.pos = self.tokens.at
        return signal

    def _object(self, tape: Tape) -> list | None:
        signal = self._ran(tape, "object")
        if signal is None:
            return None
        self.state = "item" if signal == "end" else "stream"
        return []

    def _stream(self, tape: Tape) -> list:
        at = self.pos
        if tape.byte(at - 1) == 0x0D:
            at = self.reach(tape, at + 1)
        if tape.byte(at - 1) != 0x0A:
            raise fault("BadStreamEol", at)
        length = self.tokens.length
        self.matched, self.state = 0, "search" if length is None else "behind"
        self.pos = at + (length or 0)
        return []

    def _behind(self, tape: Tape) -> list:
        """Behind a payload of known length: white space and the word that ends it, else a search for that word."""
        at = self.pos
        while at < tape.end and tape.byte(at) in BLANK:
            at += 1
        for byte in END_STREAM:
            self.reach(tape, at + 1)
            at += 1
            if tape.byte(at - 1) != byte:
                self.matched, self.state, self.pos = int(tape.byte(at - 1) == END_STREAM[0]), "search", at
                return []
        self.tokens.at, self.state, self.pos = at, "object", at
        return []

    def _search(self, tape: Tape) -> list | None:
        """The word that ends a stream. A failed match starts over at the byte that failed it, no earlier."""
        at = self.pos
        while self.matched < len(END_STREAM):
            if not self.matched:
                found = tape.find(END_STREAM[:1], at)
                at, self.matched = (found + 1, 1) if found >= 0 else (tape.end, 0)
            if at >= tape.end:
                if tape.final:
                    raise fault("Truncated", tape.end)
                self.pos = at
                return None
            if self.matched:
                byte = tape.byte(at)
                self.matched = self.matched + 1 if byte == END_STREAM[self.matched] else int(byte == END_STREAM[0])
                at += 1
        self.tokens.at, self.state, self.pos = at, "object", at
        return []

    def _xref(self, tape: Tape) -> list:
        """One line of a table; the entries that it announces are stepped over."""
        at = self.pos
        stop = tape.search(_LINE_END, at, at + LINE_LIMIT + 1)
        if stop is None:
            if tape.end > at + LINE_LIMIT:
                raise fault("XrefGeometry", at + LINE_LIMIT + 1)
            self.reach(tape, tape.end + 1)
        line, start, at = tape.cut(at, stop.start() + tape.base), at, stop.end() + tape.base
        parts = re.split(rb"[\0\t\n\x0c\r ]+", line.strip(b"\0\t\n\x0c\r "))
        self.pos = at
        if parts == [b""]:
            return []
        if len(parts) == 2:
            if not (_INT.match(parts[0]) and _INT.match(parts[1])):
                raise fault("XrefGeometry", at)
            self.pos = at + XREF_ENTRY * int(parts[1])
        elif parts[0].startswith(b"trailer"):
            # a dictionary that closes within the first word doesn't end the trailer
            self.until, self.floor = start + line.index(parts[0]) + len(parts[0]), at
            first = start + line.index(b"trailer") + len(b"trailer")
            self.tokens, self.state, self.pos = Tokens(first), "trailer", first
        else:
            raise fault("XrefGeometry", at)
        return []

    def _trailer(self, tape: Tape) -> list | None:
        while True:
            if self._ran(tape, "dict") is None:
                return None
            if self.tokens.at > self.until:
                self.state, self.pos = "item", max(self.floor, self.tokens.at)
                return []

    def finish(self, n: int) -> None:
        if self.pos > n or self.state != "item":
            raise fault("Truncated" if self.state not in ("magic", "first_line") else "NotPdf", n)
        if not self.ended:
            raise fault("MissingEof", n)


def units(data: bytes) -> list[tuple]:
    return Items().read(data)
