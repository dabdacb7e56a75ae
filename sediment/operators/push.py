"""Cutting a stream window by window: every profile, in bounded state.

A stream holds the bytes since the last cut it could be sure of, two chunks at most, with its reader's open
record and a few bytes more for the rolling hash. A canonical package holds one member's bytes besides, as a
member's form depends on all of them. Cuts are those of the whole value, however it is split.
"""

from __future__ import annotations

import numpy as np

from sediment.functions.gear import hashes_at, low_cuts
from sediment.functions.profiles import AUDIO, AUDIO_MASKS, DOCUMENT_UNIT_MIN, GENERIC, GENERIC_MASKS, ISOBMFF, MATROSKA, MAX_CHUNK, MIN_CHUNK, MPEGTS, MPEGTS_MASKS, OOXML, OOXML_BER, PDF, TEXT, ZIP, Rejected, known
from sediment.operators import archive, content, media, office, pdf
from sediment.operators.cuts import Assembly, next_cut
from sediment.operators.tape import Reader, Tape

#: Bytes kept before what is still needed: the reach of the rolling hash and more.
MARGIN = 128
NO_CUTS = np.empty(0, np.int64)


def part(tape: Tape, at: int, lead: int) -> tuple[np.ndarray, int]:
    """The bytes from `lead` before `at` on, and where they begin."""
    first = max(tape.base, at - lead)
    return np.frombuffer(tape.data, np.uint8)[first - tape.base :], first


def new_cuts(tape: Tape, old: int, profile: str) -> list[np.ndarray]:
    """Strict and relaxed ends behind `old` by the low bits."""
    body, first = part(tape, old, 31)
    return [c[c + first > old] + first for c in low_cuts(body, profile, GENERIC_MASKS)]


def joined(held: np.ndarray, new: np.ndarray, above: int) -> np.ndarray:
    return np.concatenate([held[held > above], new])


class Stream:
    """What all profiles share: the tape, where the open chunk starts, and the chunks that are sure."""

    def __init__(self, profile: str) -> None:
        self.profile, self.tape, self.start = profile, Tape(b"", False), 0
        self.strict = self.relaxed = NO_CUTS

    def learn(self, old: int) -> None:
        """Take note of the bytes behind `old`."""

    def next_end(self) -> int | None:
        """The end of the open chunk, if it is sure."""
        raise NotImplementedError

    def ended(self) -> None:
        """The stream is complete: refuse it if it may not end here."""

    def needed(self) -> int:
        """The first byte that may be asked for again, besides the open chunk."""
        return self.tape.end

    def note(self, strict: np.ndarray, relaxed: np.ndarray) -> None:
        self.strict, self.relaxed = joined(self.strict, strict, self.start), joined(self.relaxed, relaxed, self.start)

    def push(self, window: bytes, final: bool = False) -> list[tuple[int, bytes]]:
        """(start, bytes) of each chunk that is sure now. Rejected once the profile can't read on."""
        old = self.tape.end
        self.tape.append(window)
        self.tape.final = final
        self.learn(old)
        if final:
            self.ended()
        out = []
        while (end := self.next_end()) is not None:
            out.append(self.chunk(end))
        self.tape.drop(min(self.start, self.needed()) - MARGIN)
        return out

    def chunk(self, end: int) -> tuple[int, bytes]:
        start, self.start = self.start, end
        return start, self.tape.cut(start, end)

    def bounded(self, end: int) -> int | None:
        """`end` if it has arrived; at the end of the stream what is left."""
        if self.tape.final:
            end = min(end, self.tape.end)
        return end if self.start < end <= self.tape.end else None


class Bytes(Stream):
    def learn(self, old: int) -> None:
        self.note(*new_cuts(self.tape, old, self.profile))

    def next_end(self) -> int | None:
        return self.bounded(next_cut(self.strict, self.relaxed, self.start, self.start))


class Text(Stream):
    def __init__(self, profile: str) -> None:
        super().__init__(profile)
        self.checked = 0

    def learn(self, old: int) -> None:
        self.checked = content.check_utf8(self.tape.cut(self.checked, self.tape.end), self.checked, self.tape.final)
        body, first = part(self.tape, old, 63)
        self.note(*(c[c > old] for c in content.text_cuts(body, first)))

    def needed(self) -> int:
        return self.checked

    def next_end(self) -> int | None:
        end = content.text_end(self.strict, self.relaxed, self.start)
        if end is not None:
            return self.bounded(end)
        end = self.start + MAX_CHUNK
        if end >= self.tape.end:
            return self.bounded(end) if self.tape.final else None
        while self.tape.byte(end) & 0xC0 == 0x80:
            end -= 1
        return end


class Packets(Stream):
    def __init__(self, profile: str) -> None:
        super().__init__(profile)
        self.whole = 0

    def learn(self, old: int) -> None:
        before, self.whole = self.whole, self.tape.end // media.PACKET * media.PACKET
        body, first = part(self.tape, before, 64)
        seam = media.checked_packets(body[before - first : self.whole - first], before)
        ends = np.flatnonzero(seam) * media.PACKET + before
        ends = ends[ends > 0]
        h = hashes_at(body, MPEGTS, ends - 1 - first)
        self.note(*(ends[(h & np.uint64(m)) == 0] for m in MPEGTS_MASKS))

    def needed(self) -> int:
        return self.whole

    def ended(self) -> None:
        if self.tape.end % media.PACKET:
            raise media.ts_fault("partial", self.tape.end)
        if not self.tape.end:
            raise media.ts_fault("empty", 0)

    def next_end(self) -> int | None:
        end = media.packet_end(self.strict, self.relaxed, self.start)
        return self.bounded(end) if self.tape.final or end <= self.whole else None


class Sound(Stream):
    def __init__(self, profile: str) -> None:
        super().__init__(profile)
        self.reader, self.seams, self.opaque = media.Frames(), NO_CUTS, []

    def learn(self, old: int) -> None:
        events = list(self.reader.feed(self.tape))
        if self.tape.final:
            self.reader.finish(self.tape.end)
        self.opaque = [r for r in self.opaque if r[1] > self.start] + [e[1:] for e in events if e[0] == "opaque"]
        ends = np.array([e[1] for e in events if e[0] == "seam" and e[1]], np.int64)
        body, first = part(self.tape, min([old, *ends[:1].tolist()]), 64)
        h = hashes_at(body, AUDIO, ends - 1 - first)
        inside = [c[self.inside(c)] for c in new_cuts(self.tape, old, AUDIO)]
        self.seams = joined(self.seams, ends, self.start)
        self.note(*(np.union1d(ends[(h & np.uint64(m)) == 0], c) for m, c in zip(AUDIO_MASKS, inside, strict=True)))

    def inside(self, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends), bool)
        for a, b in self.opaque:
            out |= (ends > a) & (ends <= b)
        return out

    def place(self, lo: int) -> int:
        return min((max(a + 1, lo) for a, b in self.opaque if b >= lo), default=media.FOREVER)

    def needed(self) -> int:
        return self.tape.end if self.reader.state == "audio" else min(self.reader.pos, self.tape.end)

    def next_end(self) -> int | None:
        end = media.audio_end(self.strict, self.relaxed, self.seams, self.place, self.start)
        # a seam is known once what begins there has been read
        sure = self.tape.final or self.reader.state == "audio" or end < self.reader.pos
        return self.bounded(end) if sure else None


class Structured(Stream):
    """Profiles whose reader gives units to an assembly."""

    def __init__(self, profile: str, reader: Reader, unit_min: int = MIN_CHUNK) -> None:
        super().__init__(profile)
        self.reader, self.assembly, self.ready = reader, Assembly(NO_CUTS, NO_CUTS, unit_min), []

    def take(self, event) -> None:
        if event[0] == "unit":
            self.assembly.unit(event[1])
        else:
            self.assembly.large(event[1], event[2])

    def learn(self, old: int) -> None:
        strict, relaxed = new_cuts(self.tape, old, self.profile)
        self.hold(strict, relaxed)
        for event in self.reader.feed(self.tape):
            self.take(event)
        if not self.tape.final:
            self.settle(min(self.reader.pos, self.tape.end))

    def hold(self, strict: np.ndarray, relaxed: np.ndarray) -> None:
        made = self.assembly
        made.strict, made.relaxed = joined(made.strict, strict, made.start), joined(made.relaxed, relaxed, made.start)

    def settle(self, at: int) -> None:
        self.assembly.advance(at)
        self.ready, self.assembly.ends = self.ready + self.assembly.ends, []

    def ended(self) -> None:
        self.reader.finish(self.tape.end)
        self.ready += self.assembly.finish(self.tape.end)
        self.assembly.ends = []

    def needed(self) -> int:
        return min(self.reader.pos, self.tape.end)

    def next_end(self) -> int | None:
        return self.ready.pop(0) if self.ready else None


class Archive(Structured):
    """A plain archive, or a package in its own bytes."""

    def __init__(self, profile: str, package: office.Package | None = None) -> None:
        super().__init__(profile, archive.Records(), DOCUMENT_UNIT_MIN if package else MIN_CHUNK)
        self.package = package

    def take(self, event) -> None:
        if isinstance(event, archive.Unit):
            self.assembly.unit(event.at)
        elif isinstance(event, archive.Member):
            if self.package:
                self.package.member(event.name, event.data)
            if event.large:
                self.assembly.large(event.data, event.data - event.at)

    def ended(self) -> None:
        self.reader.finish(self.tape.end)
        if self.package:
            self.package.close(self.tape.end)
        super().ended()


class Canonical(Archive):
    """A package in its canonical form: the archive's records rewritten into a second tape, which is cut."""

    def __init__(self, profile: str, package: office.Package) -> None:
        super().__init__(profile, package)
        self.packer, self.form = office.Packer(package), Tape(b"", False)

    def learn(self, old: int) -> None:
        for event in self.reader.feed(self.tape):
            for made in self.packer.take(event, self.tape.cut):
                if made[0] == "bytes":
                    self.written(*made[1:])
                else:
                    Structured.take(self, made)
        if not self.tape.final:
            self.settle(self.form.end)

    def written(self, data: bytes, is_text: bool) -> None:
        old = self.form.end
        self.form.append(data)
        if is_text:
            body, first = part(self.form, old, 63)
            self.hold(*(c[c > old] for c in office.text_seams(body, first, old)))
        else:
            self.hold(*new_cuts(self.form, old, OOXML))

    def ended(self) -> None:
        self.reader.finish(self.tape.end)
        self.package.close(self.tape.end)
        self.ready += self.assembly.finish(self.form.end)
        self.assembly.ends = []

    def chunk(self, end: int) -> tuple[int, bytes]:
        start, self.start = self.start, end
        out = start, self.form.cut(start, end)
        self.form.drop(end - MARGIN)
        return out

    def needed(self) -> int:
        return self.reader.member.data if self.reader.member else min(self.reader.pos, self.tape.end)

    def push(self, window: bytes, final: bool = False) -> list[tuple[int, bytes]]:
        out = super().push(window, final)
        # `start` counts in the canonical form; the archive's own bytes go once they are read
        self.tape.drop(self.needed() - MARGIN)
        return out


def opened(profile: str, expected: str | None = None) -> Stream:
    """A fresh stream of the profile; an Office kind can be expected of packages only."""
    if expected is not None and profile not in (OOXML, OOXML_BER):
        raise ValueError("an Office kind can be expected of packages only")
    make = {
        GENERIC: Bytes,
        TEXT: Text,
        ZIP: Archive,
        ISOBMFF: lambda p: Structured(p, media.Boxes()),
        MATROSKA: lambda p: Structured(p, media.Elements()),
        MPEGTS: Packets,
        AUDIO: Sound,
        OOXML: lambda p: Canonical(p, office.Package(expected)),
        OOXML_BER: lambda p: Archive(p, office.Package(expected)),
        PDF: lambda p: Structured(p, pdf.Items(), DOCUMENT_UNIT_MIN),
    }
    return make[known(profile)](profile)


__all__ = ["Rejected", "Stream", "opened"]
