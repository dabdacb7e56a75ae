"""Telling a profile from the first 512 bytes: as built-in Columns for tables, and on bytes for archive members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions.profiles import AUDIO, GENERIC, ISOBMFF, MATROSKA, MPEGTS, OOXML, OOXML_BER, PDF, PROBE_BYTES, TEXT, ZIP
from sediment.operators.media import FIRST_BOXES, PACKET

# What a prefix must show.
DETECTORS = {
    1: (TEXT, ZIP, ISOBMFF, MATROSKA, MPEGTS, AUDIO),
    2: (TEXT, ZIP, ISOBMFF, MATROSKA, MPEGTS, AUDIO, OOXML, PDF),
}
FIRST_PART = b"[Content_Types].xml"
CONTROLS = frozenset(range(32)) - frozenset(b"\t\n\x0c\r")


def _is_text(p: bytes) -> bool:
    if not p or any(b in CONTROLS for b in p):
        return False
    try:
        p.decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and len(p) >= PROBE_BYTES
    return True


def _is_ooxml(p: bytes) -> bool:
    return p[:4] == b"PK\3\4" and p[26:28] == len(FIRST_PART).to_bytes(2, "little") and p[30 : 30 + len(FIRST_PART)] == FIRST_PART


def _is_box(p: bytes) -> bool:
    size = int.from_bytes(p[:4], "big")
    return len(p) >= 8 and (size in (0, 1) or size >= 8) and p[4:8] in FIRST_BOXES


def _is_audio(p: bytes) -> bool:
    if p[:3] == b"ID3" and len(p) >= 10:
        return not any(b & 0x80 for b in p[6:10])
    if p[:4] == b"fLaC" and len(p) >= 5:
        return p[4] & 0x7F == 0
    return len(p) >= 2 and p[0] == 0xFF and p[1] & 0xE0 == 0xE0


def detect(prefix: bytes, version: int = 2) -> list[str]:
    """The profiles that the prefix shows, in registry order."""
    p = prefix[:PROBE_BYTES]
    found = {
        TEXT: _is_text(p),
        ZIP: p[:4] in (b"PK\3\4", b"PK\5\6") and not (version > 1 and _is_ooxml(p)),
        ISOBMFF: _is_box(p),
        MATROSKA: p[:4] == b"\x1a\x45\xdf\xa3",
        MPEGTS: p[:1] == b"G" and (len(p) == PACKET or p[PACKET : PACKET + 1] == b"G"),
        AUDIO: _is_audio(p),
        OOXML: _is_ooxml(p),
        PDF: p[:5] == b"%PDF-",
    }
    return [name for name in DETECTORS[version] if found[name]]


def confirms(detected: list[str], declared: str) -> bool:
    """Whether what was detected lets a declaration stand."""
    return declared == GENERIC or not detected or declared in detected or OOXML in detected and declared in (OOXML_BER, ZIP)


def _byte(prefix: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(prefix, at + 1, 1)), 16, 10).cast("int")


def _starts(prefix: Column, mark: bytes) -> Column:
    return F.substring(prefix, 1, len(mark)) == F.lit(bytearray(mark))


def prefix_of(content: Column) -> Column:
    return F.substring(content, 1, PROBE_BYTES)


def detected(content: Column, version: int = 2) -> Column:
    """The profiles that the first 512 bytes show: array<string> in registry order, by built-in functions only."""
    p = prefix_of(content)
    size = F.octet_length(p)
    # a scalar cut off by the bound leaves one to three bytes of a valid lead behind
    hexed = F.hex(p)
    tail = F.regexp_extract(hexed, "^(?:..)*?((?:C[2-9A-F]|D.)|(?:E.)(?:[89AB].)?|(?:F[0-4])(?:[89AB].){0,2})$", 1)
    whole = F.when((size >= PROBE_BYTES) & ~F.is_valid_utf8(p.cast("string")), F.unhex(F.substr(hexed, F.lit(1), F.length(hexed) - F.length(tail)))).otherwise(p)
    clean = ~hexed.rlike("^(?:..)*(?:0[0-8BEF]|1.)")
    text = (size > 0) & clean & F.is_valid_utf8(whole.cast("string"))
    first = F.substring(p, 5, 4)
    box = F.conv(F.hex(F.substring(p, 1, 4)), 16, 10).cast("long")
    ooxml = _starts(p, b"PK\3\4") & (F.hex(F.substring(p, 27, 2)) == "1300") & (F.substring(p, 31, len(FIRST_PART)) == F.lit(bytearray(FIRST_PART)))
    zipped = _starts(p, b"PK\3\4") | _starts(p, b"PK\5\6")
    sync = _starts(p, b"G") & ((size == PACKET) | (F.hex(F.substring(p, PACKET + 1, 1)) == "47"))
    safe = (size >= 10) & ~F.hex(F.substring(p, 7, 4)).rlike("^(?:..)*[89A-F]")
    flac = _starts(p, b"fLaC") & (size >= 5) & (F.hex(F.substring(p, 5, 1)).isin("00", "80"))
    frame = _starts(p, b"\xff") & (_byte(p, 1) >= 0xE0)
    audio = F.when(_starts(p, b"ID3") & (size >= 10), safe).when(_starts(p, b"fLaC") & (size >= 5), flac).otherwise(frame)
    shown = {
        TEXT: text,
        ZIP: zipped & ~ooxml if version > 1 else zipped,
        ISOBMFF: (size >= 8) & (box.isin(0, 1) | (box >= 8)) & F.hex(first).isin(*[k.hex().upper() for k in sorted(FIRST_BOXES)]),
        MATROSKA: _starts(p, b"\x1a\x45\xdf\xa3"),
        MPEGTS: sync,
        AUDIO: audio,
        OOXML: ooxml,
        PDF: _starts(p, b"%PDF-"),
    }
    return F.array_compact(F.array(*[F.when(shown[name], F.lit(name)) for name in DETECTORS[version]]))


def state_of(found: Column) -> Column:
    return F.when(F.size(found) == 0, "unrecognized").when(F.size(found) == 1, "recognized").otherwise("ambiguous")


def resolved(found: Column) -> Column:
    """The profile of a detection; null where it is ambiguous."""
    return F.when(F.size(found) == 0, F.lit(GENERIC)).when(F.size(found) == 1, F.element_at(found, 1))


def reconciled(found: Column, declared: Column) -> Column:
    """The declared profile where the detection lets it stand, else null."""
    ok = (declared == GENERIC) | (F.size(found) == 0) | F.array_contains(found, declared) | (F.array_contains(found, OOXML) & declared.isin(OOXML_BER, ZIP))
    return F.when(ok, declared)
