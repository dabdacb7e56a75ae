"""Office packages: a canonical form that forgets how a package was compressed, and the bytes as they are."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from sediment.functions.gear import hashes_at, low_cuts
from sediment.functions.profiles import DOCUMENT_UNIT_MIN, GENERIC_MASKS, OFFICE_PARTS, OOXML, OOXML_BER, TEXT_MASKS, Rejected
from sediment.operators import archive
from sediment.operators.cuts import assemble

# Fixed values of packages and the frozen rejection texts.
CONTENT_TYPES = b"[Content_Types].xml"
SIGNATURES = b"_xmlsignatures/"
MAX_MEMBERS, MAX_NAME_BYTES = 100_000, 8 << 20
#: Bytes inflated at a time.
INFLATED = 1 << 20
STRICT_SEAMS, SOFT_SEAMS = b"\n>", b'\t\r ,;.}])"'
PLAIN_VERSION, WIDE_VERSION = 20, 45
TEXTS = {
    "NotOoxmlPackage": "first member is not [Content_Types].xml",
    "MissingMainPart": "declared Office kind's main part is missing",
    "UnrecognizedPackage": "no Word, Excel, or PowerPoint main part",
    "SignedPackage": "package is digitally signed; canonicalization would invalidate the signature — store it byte-exact under ooxml-ber-v1",
    "UnsupportedMethod": "member compression method is not stored or deflate",
    "MalformedDeflate": "member deflate stream is malformed",
    "InflatedSizeMismatch": "member inflates to a size other than declared",
    "CrcMismatch": "member inflates to bytes with a different CRC-32 than declared",
    "DeflateGeometry": "member deflate stream ends out of step with its bytes",
    "MetadataOverBound": "package exceeds the canonicalization metadata bound",
    "UnknownSizeMemberTooLarge": "unknown-size member exceeds what a canonical descriptor can express",
}


def fault(kind: str, at: int) -> Rejected:
    return Rejected(TEXTS[kind], at)


class Package:
    """What makes an archive a package: its first member, a main part, no signature."""

    def __init__(self, expected: str | None) -> None:
        self.expected, self.members, self.kinds, self.signed = expected, 0, [], False

    def member(self, name: bytes, at: int) -> None:
        if not self.members and name != CONTENT_TYPES:
            raise fault("NotOoxmlPackage", at)
        self.members += 1
        self.kinds += [k for k, part in OFFICE_PARTS.items() if part.encode() == name and k not in self.kinds]
        self.signed |= name.startswith(SIGNATURES)

    def close(self, at: int) -> None:
        if not self.members:
            raise fault("NotOoxmlPackage", at)
        if self.expected and self.expected not in self.kinds:
            raise fault("MissingMainPart", at)
        if not self.kinds:
            raise fault("UnrecognizedPackage", at)


def inflate(raw: bytes, declared: int | None = None) -> tuple[bytes | None, str | None]:
    """(bytes, None), or (None, why not): broken, not ending where its bytes end, or longer than declared.

    Of a stream that is longer than declared no more than that and a window is held.
    """
    decoder, out, size, rest = zlib.decompressobj(-15), [], 0, raw
    try:
        while rest and not decoder.eof:
            piece, rest = decoder.decompress(rest, INFLATED), decoder.unconsumed_tail
            size += len(piece)
            if declared is None or size <= declared:
                out.append(piece)
        out.append(decoder.flush())
    except zlib.error:
        return None, "malformed"
    size += len(out[-1])
    if not decoder.eof or decoder.unused_data:
        return None, "geometry"
    return (None, "size") if declared is not None and size > declared else (b"".join(out), None)


@dataclass
class Entry:
    name: bytes
    utf8: bool
    crc: int
    size: int
    offset: int
    descriptor: bool


def local_header(name: bytes, utf8: bool, crc: int = 0, size: int | None = None) -> bytes:
    """A stored member's header with every clock and source field at zero; without a size it announces a descriptor."""
    wide = size is not None and size >= archive.MARK32
    extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
    flags = (0x800 if utf8 else 0) | (8 if size is None else 0)
    told = archive.MARK32 if wide else size or 0
    return archive.LOCAL + struct.pack("<HHHHHIIIHH", WIDE_VERSION if wide else PLAIN_VERSION, flags, 0, 0, 0, crc, told, told, len(name), len(extra)) + name + extra


def descriptor(crc: int, size: int) -> bytes:
    return archive.DESCRIPTOR + struct.pack("<III", crc, size, size)


def directory(entries: list[Entry], offset: int) -> bytes:
    """Central headers and end records; the wide forms only where a value needs them."""
    out, wide_any = [], False
    for e in entries:
        wide_size, wide_offset = e.size >= archive.MARK32, e.offset >= archive.MARK32
        body = (struct.pack("<QQ", e.size, e.size) if wide_size else b"") + (struct.pack("<Q", e.offset) if wide_offset else b"")
        extra = struct.pack("<HH", 1, len(body)) + body if body else b""
        version = WIDE_VERSION if body else PLAIN_VERSION
        size = archive.MARK32 if wide_size else e.size
        at = archive.MARK32 if wide_offset else e.offset
        flags = (0x800 if e.utf8 else 0) | (8 if e.descriptor else 0)
        out.append(archive.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, flags, 0, 0, 0, e.crc, size, size, len(e.name), len(extra), 0, 0, 0, 0, at) + e.name + extra)
        wide_any |= bool(body)
    count, size = len(entries), sum(map(len, out))
    if wide_any or count >= archive.MARK16 or size >= archive.MARK32 or offset >= archive.MARK32:
        out.append(archive.END64 + struct.pack("<QHHIIQQQQ", 44, WIDE_VERSION, WIDE_VERSION, 0, 0, count, count, size, offset))
        out.append(archive.LOCATOR + struct.pack("<IQI", 0, offset + size, 1))
        count, size, offset = archive.MARK16, archive.MARK32, archive.MARK32
    out.append(archive.END + struct.pack("<HHHHIIH", 0, 0, count, count, size, offset, 0))
    return b"".join(out)


class Packer:
    """An archive's records -> the canonical form, piece by piece: members in their order and under their names,
    stored, with zeroed metadata."""

    def __init__(self, package: Package) -> None:
        self.package, self.entries, self.names, self.at = package, [], 0, 0
        self.member, self.header_at = None, 0
        #: (name, where its header stands, size) of each member.
        self.members: list[tuple[bytes, int, int]] = []

    def put(self, data: bytes, is_text: bool = False) -> tuple:
        self.at += len(data)
        return ("bytes", data, is_text)

    def is_text(self) -> bool:
        return self.member.name.lower().endswith((b".xml", b".rels"))

    def take(self, r, cut) -> list[tuple]:
        """What a record adds: ("unit", at), ("large", at, header) and ("bytes", data, is_text). cut(a, b): the archive's bytes."""
        if isinstance(r, archive.Member):
            return self.begin(r)
        if isinstance(r, archive.MemberEnd):
            return self.end(r, cut(self.member.data, r.data_end))
        if isinstance(r, archive.Directory):
            return [("unit", self.at), self.put(directory(self.entries, self.at))]
        return []

    def begin(self, r: archive.Member) -> list[tuple]:
        if r.encrypted:
            raise fault("UnsupportedMethod", r.data)
        self.package.member(r.name, r.data)
        if self.package.signed:
            raise fault("SignedPackage", r.data)
        if len(self.entries) >= MAX_MEMBERS or self.names + len(r.name) > MAX_NAME_BYTES:
            raise fault("MetadataOverBound", r.data)
        if r.method not in (archive.STORED, archive.DEFLATE):
            raise fault("UnsupportedMethod", r.data)
        self.names += len(r.name)
        self.member, self.header_at = r, self.at
        out = [("unit", self.at), self.put(local_header(r.name, r.utf8, r.crc, r.uncompressed), self.is_text())]
        if r.uncompressed is None or r.uncompressed >= DOCUMENT_UNIT_MIN:
            out.append(("large", self.at, self.at - self.header_at))
        return out

    def end(self, r: archive.MemberEnd, raw: bytes) -> list[tuple]:
        m = self.member
        body, why = (raw, None) if m.method == archive.STORED else inflate(raw, r.uncompressed)
        if why:
            raise fault({"malformed": "MalformedDeflate", "geometry": "DeflateGeometry", "size": "InflatedSizeMismatch"}[why], r.at)
        crc, unknown = zlib.crc32(body), m.uncompressed is None
        if len(body) != r.uncompressed:
            raise fault("InflatedSizeMismatch", r.at)
        if crc != r.crc or not unknown and crc != m.crc:
            raise fault("CrcMismatch", r.at)
        out = [self.put(body, self.is_text())]
        if unknown:
            if len(body) > archive.MARK32:
                raise fault("UnknownSizeMemberTooLarge", r.at)
            out.append(self.put(descriptor(crc, len(body)), self.is_text()))
        self.members.append((m.name, self.header_at, len(body)))
        self.entries.append(Entry(m.name, m.utf8, crc, len(body), self.header_at, unknown))
        return out


@dataclass
class Canonical:
    """The canonical bytes, the events and text ranges of their assembly, and the members in them."""

    data: bytes = b""
    units: list[tuple] = field(default_factory=list)
    text: list[tuple[int, int]] = field(default_factory=list)
    members: list[tuple[bytes, int, int]] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)


def canonical(data: bytes, expected: str | None = None) -> Canonical:
    package, out, parts, at = Package(expected), Canonical(), [], 0
    packer = Packer(package)
    for r in archive.Walk(data).records():
        for made in packer.take(r, lambda a, b: data[a:b]):
            if made[0] != "bytes":
                out.units.append(made)
                continue
            parts.append(made[1])
            if made[2]:
                out.text.append((at, at + len(made[1])))
            at += len(made[1])
    package.close(len(data))
    out.data, out.members, out.kinds = b"".join(parts), packer.members, package.kinds
    return out


_CLASSES = np.zeros(256, np.uint8)
_CLASSES[list(SOFT_SEAMS)], _CLASSES[list(STRICT_SEAMS)] = 1, 2


def seams_at(body: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strict and relaxed ends among the seams at `places`."""
    h = hashes_at(body, OOXML, places)
    return places[((h & np.uint64(TEXT_MASKS[0])) == 0) & (_CLASSES[body[places]] == 2)] + 1, places[(h & np.uint64(TEXT_MASKS[1])) == 0] + 1


def text_seams(body: np.ndarray, before: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends in a text range that begins at `since`; `before` bytes precede body."""
    places = np.flatnonzero(_CLASSES[body] > 0)
    strict, relaxed = seams_at(body, places[places >= since - before])
    return strict + before, relaxed + before


def seam_cuts(data: bytes, text: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cut candidates: any byte outside the text ranges, seams inside them."""
    body = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(body), bool)
    for a, b in text:
        inside[a:b] = True
    seams = seams_at(body, np.flatnonzero(inside & (_CLASSES[body] > 0)))
    return tuple(np.union1d(c[~inside[c - 1]], s) for c, s in zip(low_cuts(body, OOXML, GENERIC_MASKS), seams, strict=True))


def ooxml(data: bytes, expected: str | None = None) -> list[int]:
    """Ends in the canonical form."""
    form = canonical(data, expected)
    return assemble(len(form.data), form.units, *seam_cuts(form.data, form.text), unit_min=DOCUMENT_UNIT_MIN)


def ooxml_ber(data: bytes, expected: str | None = None) -> list[int]:
    """Ends in the package's own bytes."""
    package, units = Package(expected), []
    for r in archive.Walk(data).records():
        if isinstance(r, archive.Unit):
            units.append(("unit", r.at))
        elif isinstance(r, archive.Member):
            package.member(r.name, r.data)
            if r.large:
                units.append(("large", r.data, r.data - r.at))
    package.close(len(data))
    return assemble(len(data), units, *low_cuts(np.frombuffer(data, np.uint8), OOXML_BER, GENERIC_MASKS), unit_min=DOCUMENT_UNIT_MIN)
