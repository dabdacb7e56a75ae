"""Structure of media containers: where boxes, elements, packets and frames begin. Payloads are stepped over."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import partial

import numpy as np

from sediment.functions.gear import hashes_at, low_cuts
from sediment.functions.profiles import AUDIO, AUDIO_MASKS, GENERIC_MASKS, MAX_CHUNK, MIN_CHUNK, MPEGTS, MPEGTS_MASKS, TARGET_CHUNK, Rejected
from sediment.operators.tape import Reader, Tape

# Fixed values of the formats and the frozen rejection texts.
FIRST_BOXES = frozenset((b"ftyp", b"styp", b"sidx", b"moov", b"moof", b"free", b"skip", b"wide", b"mdat"))
BOX_CONTAINERS = frozenset((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta", b"sinf", b"schi"))
BOX_DEPTH = 16
BOX_TEXTS = {
    "first": "stream does not begin with an ISO BMFF box",
    "small": "box size is smaller than its header",
    "open": "open-ended box size below top level",
    "overrun": "child box runs past its parent",
    "depth": "box nesting exceeds the frozen depth bound",
    "truncated": "stream ends inside a box",
}
EBML, SEGMENT, VOID, CLUSTER = 0x1A45DFA3, 0x18538067, 0xEC, 0x1F43B675
SEGMENT_LEVEL = frozenset((CLUSTER, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1043A770, 0x1254C367, 0x1941A469))
CLUSTER_CHILDREN = frozenset((0xE7, 0xA7, 0xAB, 0xA3, 0xA0, 0xAF, 0x5854, VOID, 0xBF))
EBML_TEXTS = {
    "first": "stream does not begin with the EBML header",
    "id": "invalid EBML element ID",
    "size": "invalid EBML element size",
    "unknown": "unknown size outside Segment and Cluster",
    "overrun": "element runs past its parent",
    "top": "unexpected top-level element",
    "child": "unexpected element inside an open cluster",
    "truncated": "stream ends inside an element",
}
PACKET, SYNC = 188, 0x47
TS_TEXTS = {
    "sync": "packet does not begin with the 0x47 sync byte",
    "control": "reserved adaptation-field control",
    "field": "adaptation field overruns its packet",
    "partial": "stream ends inside a packet",
    "empty": "stream holds no packets",
}
AUDIO_TEXTS = {
    "first": "stream is not a known framed-audio format",
    "sync": "frame boundary holds no frame sync, tag, or trailer",
    "header": "frame header carries a reserved field",
    "free": "free-format MPEG bitrate",
    "length": "ADTS frame length is smaller than its header",
    "tag": "malformed ID3 tag",
    "block": "malformed FLAC metadata block",
    "trailing": "bytes after the `ID3v1` trailer",
    "truncated": "stream ends inside a frame, tag, or block",
}
KBPS_V1 = (
    (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
)
KBPS_V2 = (
    (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
)
HERTZ = ((44_100, 48_000, 32_000), (22_050, 24_000, 16_000), (11_025, 12_000, 8_000))
AUDIO_FORCED = MAX_CHUNK - 8 * 1024


def _bad(texts: dict[str, str], kind: str, at: int) -> Rejected:
    return Rejected(texts[kind], at)


box_fault = partial(_bad, BOX_TEXTS)
ebml_fault = partial(_bad, EBML_TEXTS)
ts_fault = partial(_bad, TS_TEXTS)
audio_fault = partial(_bad, AUDIO_TEXTS)


class Nested(Reader):
    """Open containers by their ends; None ends with the stream."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple] = []

    def bound(self) -> int | None:
        return next((end for _, end in reversed(self.open) if end is not None), None)

    def reach(self, tape: Tape, end: int) -> int:
        """Bytes up to `end` may leave neither the innermost bounded container nor the stream."""
        limit = self.bound()
        if limit is not None and end > limit and limit < tape.end:
            raise self.fault("overrun", limit + 1)
        return super().reach(tape, end)

    def close(self, at: int) -> None:
        """Leave the containers that end here; an open-ended one goes with a bounded one around it."""
        while self.open and (self.open[-1][1] == at if self.open[-1][1] is not None else self.bound() == at):
            self.open.pop()

    def finish(self, n: int) -> None:
        if self.pos > n or any(end is not None for _, end in self.open):
            raise self.fault("truncated", n)


class Boxes(Nested):
    """ISO base media: a unit a box, a large event behind the header of a large payload."""

    fault = staticmethod(box_fault)
    #: An open-ended box takes the rest of the stream.
    rest = False

    def more(self, tape: Tape) -> bool:
        return not self.rest and super().more(tape)

    def step(self, tape: Tape) -> list:
        start, out = self.pos, [("unit", self.pos)]
        self.reach(tape, start + 8)
        size, kind = struct.unpack(">I4s", tape.cut(start, start + 8))
        header = 8 + 8 * (size == 1) + 16 * (kind == b"uuid")
        pos = self.reach(tape, start + header)
        if start == 0 and kind not in FIRST_BOXES:
            raise box_fault("first", pos)
        if size == 1:
            size = struct.unpack(">Q", tape.cut(start + 8, start + 16))[0]
        elif size == 0:
            size = None
            if self.open:
                raise box_fault("open", pos)
        end = None
        if size is not None:
            if size < header:
                raise box_fault("small", pos)
            end = start + size
            if self.open and self.open[-1][1] is not None and end > self.open[-1][1]:
                raise box_fault("overrun", pos)
        self.pos = pos
        if kind in BOX_CONTAINERS:
            if len(self.open) == BOX_DEPTH:
                raise box_fault("depth", pos)
            self.open.append((kind, end))
        elif end is None:
            self.rest = True
            return [*out, ("large", pos, header)]
        else:
            if end - pos >= MIN_CHUNK:
                out.append(("large", pos, header))
            self.pos = end
        self.close(self.pos)
        return out

    def finish(self, n: int) -> None:
        if not self.rest:
            super().finish(n)
            if not n:
                raise box_fault("truncated", n)


class Elements(Nested):
    """EBML: a unit an element outside clusters, a large event behind the header of a large one or an open cluster."""

    fault = staticmethod(ebml_fault)
    seen_header = seen_segment = False

    def step(self, tape: Tape) -> list:
        start = pos = self.pos
        level = self.open[-1][0] if self.open else None
        out = [("unit", pos)] if level != "cluster" else []
        zeros = 8 - tape.byte(pos).bit_length()
        if zeros > 3:
            raise ebml_fault("id", pos + 1)
        pos = self.reach(tape, pos + zeros + 1)
        kind = int.from_bytes(tape.cut(start, pos), "big")
        if pos == tape.end:
            Reader.reach(self, tape, pos + 1)
        zeros, at = 8 - tape.byte(pos).bit_length(), pos
        if zeros > 7:
            raise ebml_fault("size", pos + 1)
        pos = self.reach(tape, pos + zeros + 1)
        bits = 7 * (zeros + 1)
        size = int.from_bytes(tape.cut(at, pos), "big") & ((1 << bits) - 1)
        size = None if size == (1 << bits) - 1 else size
        header, limit = pos - start, self.bound()
        if size is not None and limit is not None and pos + size > limit:
            raise ebml_fault("overrun", pos)
        if level == "cluster":
            if kind in SEGMENT_LEVEL and kind not in CLUSTER_CHILDREN:
                self.open.pop()
                level = "segment"
            elif kind not in CLUSTER_CHILDREN:
                raise ebml_fault("child", pos)
        opens = None
        if level is None:
            if not self.seen_header and kind != EBML:
                raise ebml_fault("first", pos)
            if self.seen_header and kind == SEGMENT:
                opens, self.seen_segment = "segment", True
            elif self.seen_header and kind != VOID:
                raise ebml_fault("top", pos)
            self.seen_header = True
        elif level == "segment" and size is None and kind == CLUSTER:
            opens = "cluster"
            out.append(("large", pos, header))
        self.pos = pos
        if opens:
            self.open.append((opens, None if size is None else pos + size))
        elif size is None:
            raise ebml_fault("unknown", pos)
        else:
            if level == "segment" and size >= MIN_CHUNK:
                out.append(("large", pos, header))
            self.pos = pos + size
        self.close(self.pos)
        return out

    def finish(self, n: int) -> None:
        super().finish(n)
        if not self.seen_segment:
            raise ebml_fault("truncated", n)


def isobmff_units(data: bytes) -> list[tuple]:
    return Boxes().read(data)


def matroska_units(data: bytes) -> list[tuple]:
    return Elements().read(data)


def checked_packets(body: np.ndarray, before: int) -> np.ndarray:
    """Whole packets of a transport stream that stand behind `before` bytes: which of them begin a unit or a discontinuity."""
    packets = body.reshape(-1, PACKET)
    control = (packets[:, 3] >> 4) & 3
    length = packets[:, 4].astype(np.int64)
    field = control >= 2
    faults = (("sync", packets[:, 0] != SYNC), ("control", control == 0), ("field", field & (length > np.where(control == 3, PACKET - 6, PACKET - 5))))
    first = min(((int(bad.argmax()), i, kind) for i, (kind, bad) in enumerate(faults) if bad.any()), default=None)
    if first:
        raise ts_fault(first[2], before + (first[0] + 1) * PACKET)
    return ((packets[:, 1] & 0x40) != 0) | (field & (length > 0) & ((packets[:, 5] & 0x80) != 0))


def packet_end(strict: np.ndarray, relaxed: np.ndarray, start: int) -> int:
    """The end of the chunk that begins at `start`, whole packets: the limit at the latest."""
    at = np.searchsorted(strict, start + MIN_CHUNK)
    if at < len(strict) and strict[at] < start + TARGET_CHUNK:
        return int(strict[at])
    at = np.searchsorted(relaxed, start + TARGET_CHUNK)
    limit = start + MAX_CHUNK // PACKET * PACKET
    return min(int(relaxed[at]), limit) if at < len(relaxed) else limit


def mpegts(data: bytes) -> list[int]:
    """Whole packets; cuts before packets that start a unit or a discontinuity."""
    n, whole = len(data), len(data) // PACKET
    body = np.frombuffer(data, np.uint8)
    seam = checked_packets(body[: whole * PACKET], 0)
    if n % PACKET:
        raise ts_fault("partial", n)
    if not n:
        raise ts_fault("empty", 0)
    ends = np.flatnonzero(seam) * PACKET
    ends = ends[ends > 0]
    h = hashes_at(body, MPEGTS, ends - 1)
    strict, relaxed = (ends[(h & np.uint64(m)) == 0] for m in MPEGTS_MASKS)
    out, start = [], 0
    while n - start > 0:
        start = min(packet_end(strict, relaxed, start), n)
        out.append(start)
    return out


def mp3_length(head: bytes, at: int) -> int:
    version = {3: 0, 2: 1, 0: 2}.get(head[1] >> 3 & 3)
    layer = 3 - (head[1] >> 1 & 3)
    rate, hertz = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 3 or rate == 15:
        raise audio_fault("header", at)
    if rate == 0:
        raise audio_fault("free", at)
    if hertz == 3:
        raise audio_fault("header", at)
    bits = 1000 * (KBPS_V1[layer] if version == 0 else KBPS_V2[min(layer, 1)])[rate - 1]
    pad, hertz = head[2] >> 1 & 1, HERTZ[version][hertz]
    if layer == 0:
        return (12 * bits // hertz + pad) * 4
    return (72 if layer == 2 and version else 144) * bits // hertz + pad


def adts_length(head: bytes, at: int) -> int:
    if head[2] >> 2 & 15 == 15:
        raise audio_fault("header", at)
    length = (head[3] & 3) << 11 | head[4] << 3 | head[5] >> 5
    if length < (7 if head[1] & 1 else 9):
        raise audio_fault("length", at)
    return length


#: The end of an opaque range that takes the rest of the stream.
FOREVER = 1 << 62


class Frames(Reader):
    """Where frames, tags and blocks of audio begin, ("seam", at), and ranges cut like any bytes, ("opaque", a, b).

    An opaque range runs from the byte that ends its header to the byte before its last.
    """

    fault = staticmethod(audio_fault)
    family, seen, state = None, False, "sniff"

    def more(self, tape: Tape) -> bool:
        return self.state != "audio" and super().more(tape)

    def step(self, tape: Tape) -> list:
        pos = self.pos
        if self.state == "complete":
            raise audio_fault("trailing", pos + 1)
        out: list[tuple] = [("seam", pos)]
        if self.state == "meta":
            if tape.byte(pos) & 0x7F == 127 or not self.seen and tape.byte(pos) & 0x7F:
                raise audio_fault("block", self.reach(tape, pos + 4))
            after = self.reach(tape, pos + 4)
            head = tape.cut(pos, after)
            self.seen, self.pos = True, after + int.from_bytes(head[1:4], "big")
            out.append(("opaque", after - 1, self.pos - 1))
            if head[0] & 0x80:
                self.state = "audio"
                out.append(("opaque", self.pos - 1, FOREVER))
            return out
        mark = tape.byte(pos)
        if mark == 0xFF:
            after = self.reach(tape, pos + 2)
            if tape.byte(pos + 1) & 0xE0 != 0xE0:
                raise audio_fault("sync", after)
            self.family = self.family or ("adts" if tape.byte(pos + 1) >> 1 & 3 == 0 else "mp3")
            after = self.reach(tape, pos + (7 if self.family == "adts" else 4))
            length = (adts_length if self.family == "adts" else mp3_length)(tape.cut(pos, after), after)
            self.seen, self.pos = True, max(pos + length, after)
        elif mark == 0x49:
            after = self.reach(tape, pos + 10)
            head = tape.cut(pos, after)
            if head[:3] != b"ID3" or any(b & 0x80 for b in head[6:]):
                raise audio_fault("tag", after)
            size = 0
            for b in head[6:]:
                size = size << 7 | b
            self.pos = after + size + (10 if head[5] & 0x10 else 0)
            if self.pos > after:
                out.append(("opaque", after - 1, self.pos - 1))
        elif mark == 0x54 and self.family in ("mp3", "adts"):
            for i, b in enumerate(b"TAG"):
                if pos + i < tape.end and tape.byte(pos + i) != b:
                    raise audio_fault("tag", pos + i + 1)
            self.pos = self.reach(tape, pos + 128)
            self.state = "complete"
        elif mark == 0x66 and self.family is None:
            after = self.reach(tape, pos + 4)
            if tape.cut(pos, after) != b"fLaC":
                raise audio_fault("first", after)
            self.family, self.state, self.pos = "flac", "meta", after
        else:
            raise audio_fault("first" if self.family is None else "sync", pos + 1)
        return out

    def finish(self, n: int) -> None:
        if self.pos > n or not (self.state in ("complete", "audio") or self.state == "sniff" and self.seen):
            raise audio_fault("truncated", n)


def audio_end(strict: np.ndarray, relaxed: np.ndarray, seams: np.ndarray, place: Callable[[int], int], start: int) -> int:
    """The end of the chunk that begins at `start`: by hash, else the first that is allowed; FOREVER if none is known.

    place: the first end inside an opaque range from a position on.
    """

    def least(cuts: np.ndarray, lo: int, hi: int = FOREVER) -> int:
        i = int(np.searchsorted(cuts, lo))
        return int(cuts[i]) if i < len(cuts) and cuts[i] <= hi else FOREVER

    end = least(strict, start + MIN_CHUNK, start + TARGET_CHUNK - 1)
    if end < FOREVER:
        return end
    return min(least(relaxed, start + TARGET_CHUNK), least(seams, start + AUDIO_FORCED), place(start + MAX_CHUNK))


def framed_audio(data: bytes) -> list[int]:
    """Cuts at seams by the high bits, from a size on at any; inside opaque ranges like any bytes."""
    events = Frames().read(data)
    n, body = len(data), np.frombuffer(data, np.uint8)
    ends = np.array([e[1] for e in events if e[0] == "seam" and e[1]], np.int64)
    h = hashes_at(body, AUDIO, ends - 1)
    seam_cuts = [ends[(h & np.uint64(m)) == 0] for m in AUDIO_MASKS]
    inside = np.zeros(n + 1, bool)
    for kind, a, *b in events:
        if kind == "opaque":
            inside[a + 1 : min(b[0], n) + 1] = True  # an end stands behind its byte
    byte_cuts = [c[inside[c]] for c in low_cuts(body, AUDIO, GENERIC_MASKS)]
    places = np.append(np.flatnonzero(inside), FOREVER)
    place = lambda lo: int(places[np.searchsorted(places, lo)])
    strict, relaxed = (np.union1d(s, b) for s, b in zip(seam_cuts, byte_cuts, strict=True))
    out, start = [], 0
    while n - start > 0:
        start = min(audio_end(strict, relaxed, ends, place, start), n)
        out.append(start)
    return out
