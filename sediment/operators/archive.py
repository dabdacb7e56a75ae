"""Reading a ZIP archive front to back as a sequence of records.

`walk` yields what a one-pass reader learns, in stream order; payloads are stepped over, not read. A fault
carries the count of bytes a reader has taken when it notices.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from sediment.functions.profiles import MIN_CHUNK, Rejected
from sediment.operators.tape import Reader, Tape

# Fixed values of the ZIP format and the bounds put on it.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
FIXED = {LOCAL: 26, CENTRAL: 42, END: 18, END64: 52, LOCATOR: 16}
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATE, DEFLATE64 = 0, 8, 9
MAX_RATIO, RATIO_SLACK = 1032, 64

TEXTS = {
    "UnknownSignature": "unknown ZIP record signature",
    "MemberAfterCentralDirectory": "local file header after the central directory",
    "RecordOutOfSequence": "end-of-archive record out of sequence",
    "MissingZip64Sizes": "size field is 0xFFFFFFFF without a ZIP64 extra field",
    "MalformedExtraField": "extra field runs past its area",
    "StoredSizesDisagree": "stored member declares unequal sizes",
    "ImplausibleExpansion": "deflated member declares an impossible expansion ratio",
    "DescriptorSizeMismatch": "data descriptor disagrees with the member bytes",
    "CentralOffsetOutOfRange": "central directory entry offset is out of range",
    "EntryCountMismatch": "end-of-central-directory entry count mismatch",
    "CentralDirectoryGeometry": "central directory offset or size mismatch",
    "TrailingBytes": "bytes after the archive comment",
    "Truncated": "archive ends inside a record or before its end record",
}


@dataclass
class Unit:
    """A record starts where members may still come."""

    at: int


@dataclass
class Member:
    """A local header has passed. Sizes are None where only a descriptor tells them."""

    at: int
    data: int
    name: bytes
    method: int
    utf8: bool
    encrypted: bool
    compressed: int | None
    uncompressed: int | None
    crc: int

    @property
    def large(self) -> bool:
        return self.compressed is not None and self.compressed >= MIN_CHUNK


@dataclass
class MemberEnd:
    """The member's bytes are data[member.data : data_end]; `at` is where its end was certain."""

    data_end: int
    at: int
    uncompressed: int
    crc: int


@dataclass
class Directory:
    """No members come any more."""

    at: int


def fault(kind: str, at: int) -> Rejected:
    return Rejected(TEXTS[kind], at)


def check_sizes(method: int, compressed: int, uncompressed: int, at: int) -> None:
    if method == STORED and compressed != uncompressed:
        raise fault("StoredSizesDisagree", at)
    if method in (DEFLATE, DEFLATE64) and uncompressed > min(compressed * MAX_RATIO + RATIO_SLACK, 2**64 - 1):
        raise fault("ImplausibleExpansion", at)


def wide_fields(extra: bytes, at: int) -> Iterator[int]:
    """The 64-bit fields of the extra area, in order; asking for one that isn't there is a fault."""
    pos, found = 0, b""
    while pos < len(extra):
        if len(extra) - pos < 4:
            raise fault("MalformedExtraField", at)
        kind, size = struct.unpack_from("<HH", extra, pos)
        if pos + 4 + size > len(extra):
            raise fault("MalformedExtraField", at)
        if kind == 1:
            found = extra[pos + 4 : pos + 4 + size]
            break
        pos += 4 + size
    for i in range(len(found) // 8):
        yield struct.unpack_from("<Q", found, 8 * i)[0]
    raise fault("MissingZip64Sizes", at)


def widened(values: list[int], extra: bytes, at: int) -> list[int]:
    """Values that stand at the 32-bit mark come from the extra area instead."""
    if MARK32 not in values:
        return values
    fields = wide_fields(extra, at)
    return [next(fields) if v == MARK32 else v for v in values]


class Records(Reader):
    """One archive. Between windows it holds at most the header it reads; payloads of known size are stepped over."""

    fault = staticmethod(fault)
    cut_off = "Truncated"

    def __init__(self) -> None:
        super().__init__()
        self.members = self.entries = 0
        self.directory = self.directory_end = self.wide_end = None
        self.phase = "members"
        #: The member whose end is awaited, how its descriptor is written, and whether it has one.
        self.member: Member | None = None
        self.wide = self.flagged = self.unchecked = False

    def more(self, tape: Tape) -> bool:
        return self.unchecked or self.pos < tape.end or self.member is not None and self.pos == tape.end

    def descriptor(self, tape: Tape, at: int) -> tuple[int, int, int]:
        """(crc, compressed, uncompressed) at a position."""
        return struct.unpack("<IQQ", tape.cut(at, at + 20)) if self.wide else struct.unpack("<III", tape.cut(at, at + 12))

    def ended(self, end: MemberEnd) -> list:
        self.member, self.pos = None, end.at
        return [end]

    def known_end(self, tape: Tape) -> list:
        m, end = self.member, self.pos
        if not self.flagged or not m.compressed:
            return self.ended(MemberEnd(end, end, m.uncompressed, m.crc))
        self.reach(tape, end + 4)
        at = end + 4 if tape.cut(end, end + 4) == DESCRIPTOR else end
        after = self.reach(tape, at + (20 if self.wide else 12))
        crc, compressed, uncompressed = self.descriptor(tape, at)
        if compressed != m.compressed:
            raise fault("DescriptorSizeMismatch", after)
        check_sizes(m.method, compressed, uncompressed, after)
        return self.ended(MemberEnd(end, after, uncompressed, crc))

    def scanned_end(self, tape: Tape) -> list | None:
        """The first signed descriptor that counts exactly the bytes before it."""
        m, body = self.member, 20 if self.wide else 12
        while (at := tape.find(DESCRIPTOR, self.pos)) >= 0:
            self.pos = at
            if not tape.final and at + 4 + body > tape.end:
                return None
            after = self.reach(tape, at + 4 + body)
            crc, compressed, uncompressed = self.descriptor(tape, at + 4)
            if compressed == at - m.data:
                check_sizes(m.method, compressed, uncompressed, after)
                return self.ended(MemberEnd(at, after, uncompressed, crc))
            self.pos = at + 1
        if tape.final:
            raise fault("Truncated", tape.end)
        self.pos = max(self.pos, tape.end - 3)
        return None

    def step(self, tape: Tape) -> list | None:
        if self.unchecked:  # a step of its own: who gets the member may refuse it first
            self.unchecked, m = False, self.member
            check_sizes(m.method, m.compressed, m.uncompressed, m.data)
            return []
        if self.member is not None:
            return self.scanned_end(tape) if self.member.compressed is None else self.known_end(tape)
        start = self.pos
        if self.phase == "complete":
            raise fault("TrailingBytes", start + 1)
        out: list = [Unit(start)] if self.phase == "members" else []
        pos = self.reach(tape, start + 4)
        kind = tape.cut(start, pos)
        if kind not in FIXED:
            raise fault("UnknownSignature", pos)
        if kind == LOCAL:
            if self.phase != "members":
                raise fault("MemberAfterCentralDirectory", pos)
        elif not (kind == LOCATOR and self.phase == "end64" or kind == END and self.phase in ("members", "central", "locator") or kind in (CENTRAL, END64) and self.phase in ("members", "central")):
            raise fault("RecordOutOfSequence", pos)
        elif kind != LOCATOR and self.phase in ("members", "central"):
            if self.phase == "members":
                self.directory = start
                out.append(Directory(start))
            if kind != CENTRAL:
                self.directory_end = start
            self.phase = {CENTRAL: "central", END64: "end64"}.get(kind, self.phase)
        after = self.reach(tape, pos + FIXED[kind])
        fixed, pos = tape.cut(pos, after), after
        if kind == LOCAL:
            return out + self.local(tape, start, fixed, pos)
        if kind == CENTRAL:
            pos = self.central(tape, fixed, pos)
        elif kind == END64:
            size = struct.unpack_from("<Q", fixed)[0]
            if size < 44:
                raise fault("CentralDirectoryGeometry", pos)
            self.wide_end = struct.unpack_from("<QQQ", fixed, 28)
            pos += size - 44
        elif kind == LOCATOR:
            self.phase = "locator"
        else:
            told = list(struct.unpack_from("<HII", fixed, 6))
            if self.wide_end is not None:
                told = [w if t == mark else t for t, w, mark in zip(told, self.wide_end, (MARK16, MARK32, MARK32), strict=True)]
            if not told[0] == self.entries == self.members:
                raise fault("EntryCountMismatch", pos)
            if told[2] != self.directory or told[1] != self.directory_end - self.directory:
                raise fault("CentralDirectoryGeometry", pos)
            pos = self.reach(tape, pos + struct.unpack_from("<H", fixed, 16)[0])
            self.phase = "complete"
        self.pos = pos
        return out

    def local(self, tape: Tape, start: int, fixed: bytes, pos: int) -> list:
        flags, method = struct.unpack_from("<HH", fixed, 2)
        crc, compressed, uncompressed, name_len, extra_len = struct.unpack_from("<IIIHH", fixed, 10)
        head, pos = tape.cut(pos, pos + name_len + extra_len), self.reach(tape, pos + name_len + extra_len)
        self.members += 1
        self.wide, self.flagged = MARK32 in (compressed, uncompressed), bool(flags & 8)
        m = Member(start, pos, head[:name_len], method, bool(flags & 0x800), bool(flags & 1), None, None, 0)
        self.member, self.pos = m, pos
        if not (self.flagged and compressed == 0):
            m.uncompressed, m.compressed = widened([uncompressed, compressed], head[name_len:], pos)
            m.crc = crc
            self.pos, self.unchecked = pos + m.compressed, True
        return [m]

    def central(self, tape: Tape, fixed: bytes, pos: int) -> int:
        method = struct.unpack_from("<H", fixed, 6)[0]
        compressed, uncompressed, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", fixed, 16)
        offset = struct.unpack_from("<I", fixed, 38)[0]
        self.entries += 1
        head, pos = tape.cut(pos, pos + name_len + extra_len), self.reach(tape, pos + name_len + extra_len + comment_len)
        uncompressed, compressed, offset = widened([uncompressed, compressed, offset], head[name_len:], pos)
        check_sizes(method, compressed, uncompressed, pos)
        if offset >= self.directory:
            raise fault("CentralOffsetOutOfRange", pos)
        return pos

    def finish(self, n: int) -> None:
        if self.phase != "complete" or self.pos > n:
            raise fault("Truncated", n)


class Walk:
    """One archive in memory."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def records(self) -> Iterator[Unit | Member | MemberEnd | Directory]:
        reader, tape = Records(), Tape(self.data)
        while reader.more(tape):
            yield from reader.step(tape)
        reader.finish(len(self.data))


def units(data: bytes) -> list[tuple]:
    """The events of an assembly: where records start, and the headers of large members."""
    out: list[tuple] = []
    for r in Walk(data).records():
        if isinstance(r, Unit):
            out.append(("unit", r.at))
        elif isinstance(r, Member) and r.large:
            out.append(("large", r.data, r.data - r.at))
    return out
