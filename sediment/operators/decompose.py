"""Taking containers apart: ZIP, TAR, gzip and tar.gz, one inside the other, into typed events.

A container is taken apart as a whole or not at all: `Opaque` says why not. Events come in stream order, a
nested container's between the start and the end of the member that holds it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from sediment.functions.media_type import parse
from sediment.functions.probe import confirms, detect
from sediment.functions.profiles import EXTENSIONS, GENERIC, OFFICE_PARTS, OOXML, PROBE_BYTES, ZIP, Rejected, registry
from sediment.operators import archive
from sediment.operators.office import CONTENT_TYPES, inflate

# Bounds and frozen texts.
BLOCK = 512
MAX_DEPTH, MAX_MEMBERS, MAX_PATH, MAX_OVERRIDE, MAX_NAME = 8, 1_000_000, 4096, 16 << 10, 4096
REASONS = {
    "EncryptedWithoutKey": "encrypted without a supplied key",
    "UnsupportedCompression": "unsupported compression method",
    "UnsafePath": "member path is absolute or escapes the root",
    "DepthExceeded": "container nesting exceeds the depth cap",
    "MetadataOverBound": "container metadata exceeds the bound",
    "NotAContainer": "input is not a recognized container",
}
ZIP_CONTAINERS = (ZIP, OOXML)
OTHER_CONTAINERS = ("application/x-tar", "application/gzip")


@dataclass
class Opaque(Exception):
    """Why a container can't be taken apart."""

    kind: str
    detail: str | None = None
    offset: int = 0

    def __str__(self) -> str:
        if self.kind == "Malformed":
            return f"malformed at byte {self.offset}: {self.detail}"
        return f"unsupported feature: {self.detail}" if self.kind == "UnsupportedFeature" else REASONS[self.kind]


def malformed(detail: str, offset: int = 0) -> Opaque:
    return Opaque("Malformed", detail, offset)


@dataclass
class Event:
    """kind: container_start, member_start, member_end, entry or container_end."""

    kind: str
    depth: int
    container: str | None = None
    path: bytes | None = None
    ordinal: int | None = None
    size: int | None = None
    mode: int | None = None
    mtime: int | None = None
    media_type: str | None = None
    nested: bool = False
    content: bytes | None = None
    entry: str | None = None
    target: bytes | None = None
    members: int | None = None
    entries: int | None = None
    office: str | None = None


# ---------------------------------------------------------------- names and prefixes


def extension(path: bytes) -> str | None:
    name = path.rsplit(b"/", 1)[-1]
    stem, dot, ext = name.rpartition(b".")
    if not dot or not 1 <= len(ext) <= 8:
        return None
    try:
        return "".join(c.lower() if c.isascii() else c for c in ext.decode())
    except UnicodeDecodeError:
        return None


def octal(field: bytes) -> int | None:
    text = field.lstrip(b" ").split(b"\0", 1)[0].split(b" ", 1)[0]
    return int(text, 8) if text and all(c in b"01234567" for c in text) else None


def checksum_matches(block: bytes) -> bool:
    told = octal(block[148:156])
    return told is not None and told != 0 and told == sum(block[:148]) + 8 * 0x20 + sum(block[156:BLOCK])


def is_tar(prefix: bytes) -> bool:
    return len(prefix) >= BLOCK and (prefix[257:262] == b"ustar" or checksum_matches(prefix[:BLOCK]))


def container_of(prefix: bytes) -> str | None:
    if prefix[:2] == b"\x1f\x8b":
        return "gzip"
    if prefix[:4] in (b"PK\3\4", b"PK\5\6"):
        return "zip"
    return "tar" if is_tar(prefix) else None


def infer_member(path: bytes, prefix: bytes) -> tuple[str | None, str | None]:
    """(media type, container): bytes make a container unless the name says otherwise; a name types the rest unless the bytes gainsay it."""
    named = EXTENSIONS.get(extension(path) or "")
    profile = registry(2).get(named, GENERIC)
    lower = bytes(path).lower()
    holds = named is not None and (profile in ZIP_CONTAINERS or named in OTHER_CONTAINERS) or lower.endswith((b".tar.gz", b".tgz"))
    kind = container_of(prefix)
    if kind and (holds or named is None):
        return named, kind
    return named if named and confirms(detect(prefix, 2), profile) else None, None


def check_path(path: bytes) -> None:
    if len(path) > MAX_PATH:
        raise Opaque("MetadataOverBound")
    if path[:1] in (b"/", b"\\") or b".." in path.split(b"/"):
        raise Opaque("UnsafePath")


# ---------------------------------------------------------------- readers: (meta, entry kind, target, body)


@dataclass
class Item:
    path: bytes
    size: int | None
    mode: int | None = None
    mtime: int | None = None
    entry: str | None = None
    target: bytes | None = None
    body: bytes = b""


def zip_items(data: bytes) -> Iterator[Item]:
    member = None
    try:
        for r in archive.Walk(data).records():
            if isinstance(r, archive.Member):
                if r.encrypted:
                    raise Opaque("EncryptedWithoutKey")
                if r.name.endswith(b"/"):
                    if r.uncompressed:
                        raise malformed("zip directory entry declares a payload")
                    yield Item(r.name, r.uncompressed, entry="directory")
                    member = None
                    continue
                if r.method not in (archive.STORED, archive.DEFLATE):
                    raise Opaque("UnsupportedCompression")
                member = r
            elif isinstance(r, archive.MemberEnd) and member is not None:
                raw = data[member.data : r.data_end]
                body, why = (raw, None) if member.method == archive.STORED else inflate(raw, r.uncompressed)
                if why in ("malformed", "geometry"):
                    raise malformed("zip member deflate stream is malformed" if why == "malformed" else "zip member deflate stream ends out of step")
                if why or len(body) != r.uncompressed:
                    raise malformed("zip member inflates to a size other than declared")
                yield Item(member.name, member.uncompressed, body=body)
    except Rejected as e:
        raise malformed(e.detail, e.offset) from None


def _pax(records: bytes, at: int) -> dict[str, bytes | int]:
    out: dict[str, bytes | int] = {}
    while records:
        head, space, _ = records.partition(b" ")
        if not space:
            raise malformed("pax record has no length", at)
        if not head.isdigit():
            raise malformed("pax record length is not decimal", at)
        size = int(head)
        if not len(head) + 1 < size <= len(records):
            raise malformed("pax record length out of range", at)
        record, records = records[len(head) + 1 : size], records[size:]
        if not record.endswith(b"\n"):
            raise malformed("pax record does not end in newline", at)
        key, equals, value = record[:-1].partition(b"=")
        if not equals:
            raise malformed("pax record has no '='", at)
        if key == b"size":
            if not value.isdigit():
                raise malformed("pax size is not decimal", at)
            out["size"] = int(value)
        elif key in (b"path", b"linkpath"):
            out[key.decode()] = value
    return out


TAR_ENTRIES = {b"5": "directory", b"2": "symlink", b"1": "hardlink", b"3": "other", b"4": "other", b"6": "other"}
TAR_OVERRIDES = b"xXgLK"


def tar_items(data: bytes) -> Iterator[Item]:
    """Entries with their name overrides. Padding follows the size that holds, an override's where there is one."""
    at, n, zeros, seen = 0, len(data), 0, False
    told: dict[str, bytes | int] = {}
    while at < n:
        if zeros == 2:
            rest = data[at:].lstrip(b"\0")
            if rest:
                raise malformed("bytes after the tar end marker", n - len(rest))
            return
        if at + BLOCK > n:
            raise malformed("tar archive is truncated", n)
        block, last, at = data[at : at + BLOCK], at + BLOCK - 1, at + BLOCK
        if not any(block):
            zeros += 1
            continue
        if zeros:
            raise malformed("lone zero block inside the archive", last)
        if not checksum_matches(block):
            raise malformed("tar header checksum mismatch", last)
        flag, size = block[156:157], octal(block[124:136])
        if size is None:
            raise malformed("tar size field is not octal", last)
        if flag == b"S":
            raise Opaque("UnsupportedFeature", "sparse tar member")

        def body_of(size: int, at: int = at) -> tuple[bytes, int]:
            end = at + size
            stop = end + -end % BLOCK
            bad = next((i for i, b in enumerate(data[end:stop]) if b), None)
            if bad is not None:
                raise malformed("nonzero tar padding", end + bad)
            if stop > n:
                raise malformed("tar archive is truncated", n)
            return data[at:end], stop

        if flag in (b"x", b"X", b"g", b"L", b"K"):
            if size > MAX_OVERRIDE:
                raise Opaque("MetadataOverBound")
            body, at = body_of(size)
            if size and flag in (b"x", b"X"):
                told |= _pax(body, at - 1)
            elif size and flag != b"g":
                told["path" if flag == b"L" else "linkpath"] = body.split(b"\0", 1)[0]
            continue
        path = told.pop("path", None)
        if path is None:
            path, prefix = block[:100].split(b"\0", 1)[0], block[345:500].split(b"\0", 1)[0]
            if prefix and block[257:262] == b"ustar":
                path = prefix + b"/" + path
        link = told.pop("linkpath", block[157:257].split(b"\0", 1)[0])
        held = told.pop("size", size)
        regular = flag in (b"0", b"\0", b"7")
        if not regular and flag not in TAR_ENTRIES:
            raise malformed("unknown tar entry type", last)
        if not regular and size:
            raise malformed("tar metadata entry declares a payload", last)
        item = Item(path, held, octal(block[100:108]), octal(block[136:148]))
        if regular:
            item.body, at = body_of(held)
        else:
            item.entry = TAR_ENTRIES[flag]
            item.target = link if item.entry in ("symlink", "hardlink") else flag if item.entry == "other" else None
        seen = True
        yield item
    if zeros != 2 and not seen:
        raise malformed("tar archive is truncated", n)


def gunzip(data: bytes) -> tuple[bytes, bytes]:
    """(first member's stored name, all members' bytes joined); checksums and lengths are verified."""
    out, name, at, n, first = [], b"", 0, len(data), True
    cut = lambda: malformed("gzip stream is truncated", n)
    while at < n:
        if at + 10 > n:
            raise cut()
        if data[at : at + 2] != b"\x1f\x8b":
            raise malformed("not a gzip header", at + 9)
        if data[at + 2] != 8:
            raise Opaque("UnsupportedCompression")
        flags = data[at + 3]
        if flags & 0xE0:
            raise malformed("reserved gzip flag bits set", at + 9)
        at += 10
        if flags & 4:
            if at + 2 > n:
                raise cut()
            at += 2 + struct.unpack_from("<H", data, at)[0]
        for bit in (8, 16):
            if flags & bit:
                stop = data.find(b"\0", at)
                if bit == 8 and first and (stop if stop >= 0 else n) - at > MAX_NAME:
                    raise Opaque("MetadataOverBound")
                if stop < 0:
                    raise cut()
                if bit == 8 and first:
                    name = data[at:stop]
                at = stop + 1
        at += 2 * bool(flags & 2)
        if at >= n:
            raise cut()
        decoder = zlib.decompressobj(-15)
        try:
            body = decoder.decompress(data[at:])
        except zlib.error:
            raise malformed("gzip deflate body is malformed", at) from None
        if not decoder.eof or len(decoder.unused_data) < 8:
            raise cut()
        at = n - len(decoder.unused_data)
        crc, size = struct.unpack_from("<II", data, at)
        at += 8
        if crc != zlib.crc32(body):
            raise malformed("gzip CRC mismatch", at - 1)
        if size != len(body) & 0xFFFFFFFF:
            raise malformed("gzip ISIZE mismatch", at - 1)
        out.append(body)
        first = False
    if first:
        raise cut()
    return name, b"".join(out)


# ---------------------------------------------------------------- the descent


class Decomposer:
    def __init__(self) -> None:
        self.counted = 0

    def level(self, data: bytes, kind: str, depth: int) -> Iterator[Event]:
        if kind == "zip":
            items = zip_items(data)
        elif kind == "tar":
            items = tar_items(data)
        else:
            name, inner = gunzip(data)
            kind = "tar+gzip" if is_tar(inner[:BLOCK]) else "gzip"
            items = tar_items(inner) if kind == "tar+gzip" else iter([Item(name, None, body=inner)])
        yield Event("container_start", depth, container=kind)
        members = entries = 0
        package, office = False, None
        for ordinal, item in enumerate(items):
            check_path(item.path)
            self.counted += 1
            if self.counted > MAX_MEMBERS:
                raise Opaque("MetadataOverBound")
            meta = {"path": item.path, "ordinal": ordinal, "size": item.size, "mode": item.mode, "mtime": item.mtime}
            if item.entry:
                entries += 1
                yield Event("entry", depth, entry=item.entry, target=item.target, **meta)
                continue
            if kind == "zip":
                package |= ordinal == 0 and item.path == CONTENT_TYPES
                if package and office is None:
                    office = next((k for k, part in OFFICE_PARTS.items() if part.encode() == item.path), None)
            media, inside = infer_member(item.path, item.body[:PROBE_BYTES])
            if inside and depth + 1 >= MAX_DEPTH:
                raise Opaque("DepthExceeded")
            yield Event("member_start", depth, media_type=media, nested=bool(inside), **meta)
            if inside:
                yield from self.level(item.body, inside, depth + 1)
            members += 1
            yield Event("member_end", depth, media_type=media, nested=bool(inside), content=None if inside else item.body, **{**meta, "size": len(item.body)})
        yield Event("container_end", depth, container=kind, members=members, entries=entries, office=office)


def decompose(data: bytes) -> list[Event]:
    kind = container_of(data[:BLOCK])
    if kind is None:
        raise Opaque("NotAContainer")
    return list(Decomposer().level(data, kind, 0))


def essence(media_type: str) -> str:
    return parse(media_type).essence
