"""Cuts against a byte-at-a-time reading of the rules, envelopes, reuse after edits, and rejections."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sediment.functions.gear import table
from sediment.functions.profiles import MAX_CHUNK, MIN_CHUNK, PROFILES, TARGET_CHUNK, Rejected
from sediment.operators.chunkers import boundaries, canonical_form, chunks
from sediment.operators.cuts import Assembly
from sediment.plans import synthetic as s
from sediment.plans.formats import MALFORMED

MASK64 = 2**64 - 1


def slow_generic(data: bytes) -> list[int]:
    t = [int(x) for x in table("generic-cdc-v1")]
    ends, h, size = [], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + t[b]) & MASK64
        size += 1
        if size >= MIN_CHUNK and (size >= MAX_CHUNK or h & (0x3FFFF if size < TARGET_CHUNK else 0x3FFF) == 0):
            ends.append(i + 1)
            h = size = 0
    return ends + [len(data)] * (size > 0)


def slow_text(data: bytes) -> list[int]:
    t = [int(x) for x in table("structured-text-v1")]
    ends, start, h, last = [], 0, 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + t[b]) & MASK64
        whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        size = i + 1 - start
        cut = None
        if whole:
            last = i + 1
            line, soft = b == 10, b in b"\t\r ,;.}]>)"
            if size >= MAX_CHUNK:
                cut = i + 1
            elif size >= TARGET_CHUNK and (line or soft) and h >> 53 == 0 or MIN_CHUNK <= size < TARGET_CHUNK and line and h >> 54 == 0:
                cut = i + 1
        elif size >= MAX_CHUNK:
            cut = last
        if cut:
            ends.append(cut)
            start, h = cut, 0
            for c in data[cut : i + 1]:
                h = (h * 2 + t[c]) & MASK64
    return ends + [len(data)] * (start < len(data))


@pytest.mark.parametrize("data", [b"", b"x", s.noise("a", MIN_CHUNK), s.noise("b", MIN_CHUNK + 1), s.noise("c", 700_000), bytes(600_000), s.xml("d", 300_000)])
def test_generic_equals_byte_by_byte(data):
    assert boundaries("generic-cdc-v1", data) == slow_generic(data)


@pytest.mark.parametrize("data", [b"", s.markdown("a", 400_000), s.minified_json("b", 400_000), "日".encode() * 120_000, b"y" * 300_000])
def test_text_equals_byte_by_byte(data):
    assert boundaries("structured-text-v1", data) == slow_text(data)


class SlowAssembly:
    """One byte at a time: the open and the held chunk as byte counts."""

    def __init__(self, strict, relaxed, unit_min):
        self.strict, self.relaxed, self.unit_min = set(strict), set(relaxed), unit_min
        self.ends, self.held, self.open, self.at = [], 0, 0, 0

    def close(self):
        if self.held:
            self.ends.append(self.at - self.open)
        self.held, self.open = self.open, 0

    def push(self):
        self.at += 1
        self.open += 1
        n = self.open
        if n >= MIN_CHUNK and (n >= MAX_CHUNK or self.at in (self.strict if n < TARGET_CHUNK else self.relaxed)):
            self.close()

    def unit(self):
        if self.open >= self.unit_min:
            self.close()
        elif self.held and self.open and self.held + self.open <= MAX_CHUNK:
            self.held, self.open = self.held + self.open, 0

    def large(self, header):
        if self.open > header:
            rest = self.open - header
            if self.held and self.held + rest <= MAX_CHUNK:
                self.held += rest
            else:
                if self.held:
                    self.ends.append(self.at - self.open)
                self.held = rest
            self.open = header

    def finish(self):
        if self.held:
            self.ends.append(self.at - self.open)
        if self.open:
            self.ends.append(self.at)
        return self.ends


@pytest.mark.parametrize("seed", range(6))
def test_assembly_equals_byte_by_byte(seed):
    rng = random.Random(seed)
    n = 900_000
    relaxed = np.array(sorted(rng.sample(range(1, n), 60)))
    strict = np.array([x for x in relaxed if rng.random() < 0.3], np.int64)
    events, at = [], 0
    while at < n - 40_000:
        events.append(("unit", at))
        header = rng.randint(8, 60)
        payload = rng.choice([0, 40, 3000, 9000, 20_000, 90_000, 400_000])
        if payload >= MIN_CHUNK:
            events.append(("large", at + header, header))
        at += header + payload
    events = [e for e in events if e[1] < n]
    fast, slow = Assembly(strict, relaxed, 4096 if seed % 2 else MIN_CHUNK), SlowAssembly(strict, relaxed, 4096 if seed % 2 else MIN_CHUNK)
    for e in events:
        (fast.unit if e[0] == "unit" else fast.large)(*e[1:])
    queue = {}
    for e in events:
        queue.setdefault(e[1], []).append(e)
    for i in range(n + 1):
        for e in queue.get(i, []):
            slow.unit() if e[0] == "unit" else slow.large(e[2])
        if i < n:
            slow.push()
    assert fast.finish(n) == slow.finish()


STREAMS = {
    "generic-cdc-v1": s.noise("e", 600_000),
    "structured-text-v1": s.markdown("e", 600_000),
    "zip-v1": s.docx(s.xml("e", 120_000), s.noise("i", 300_000)),
    "isobmff-v1": s.mp4("e", s.noise("m", 500_000)),
    "matroska-v1": s.streamed_webm("e", 2),
    "mpegts-v1": s.ts_stream("e", 4000, 40),
    "framed-audio-v1": s.tagged_mp3("t", "e", 900),
    "ooxml-v1": s.docx(s.xml("e", 120_000), s.noise("i", 300_000)),
    "ooxml-ber-v1": s.docx(s.xml("e", 120_000), s.noise("i", 300_000)),
    "pdf-v1": s.pdf(s.prose("p", 20_000), s.noise("i", 200_000)),
}


@pytest.mark.parametrize("profile", PROFILES)
def test_chunks_cover_the_stream_within_the_envelope(profile):
    data = STREAMS[profile]
    parts = chunks(profile, data)
    assert b"".join(parts) == canonical_form(profile, data)
    assert max(map(len, parts)) <= MAX_CHUNK


@pytest.mark.parametrize("profile", ["generic-cdc-v1", "structured-text-v1"])
@pytest.mark.parametrize("shift", [1, 64, 4096, 65536])
def test_a_shift_keeps_nine_tenths_of_the_chunks(profile, shift):
    data = s.noise("shift", 4 << 20) if profile == "generic-cdc-v1" else s.markdown("shift", 4 << 20)
    before = set(chunks(profile, data))
    after = chunks(profile, b"x" * shift + data)
    assert sum(c in before for c in after) / len(after) > 0.9


def test_remuxing_a_movie_changes_one_chunk():
    payload = s.noise("remux", 4 << 20)
    before = set(chunks("isobmff-v1", s.mp4("one", payload)))
    assert sum(c not in before for c in chunks("isobmff-v1", s.mp4("two", payload))) == 1


def test_a_package_forgets_its_compression():
    body, image = s.xml("doc", 120_000), s.noise("img", 300_000)
    assert chunks("ooxml-v1", s.docx(body, image)) == chunks("ooxml-v1", s.docx(body, image, False))
    other = set(chunks("ooxml-v1", s.docx(s.xml("other", 120_000), image)))
    assert sum(len(c) for c in chunks("ooxml-v1", s.docx(body, image)) if c in other) >= 290_000


def test_incremental_pdf_keeps_its_chunks():
    text, image = s.prose("t", 20_000), s.noise("i", 200_000)
    base = s.pdf(text, image)
    update = base + b"3 0 obj\n<< /Type /Page /Rotate 90 >>\nendobj\nxref\n3 1\n0000000000 00000 n \ntrailer\n<< /Size 7 >>\nstartxref\n9\n%%EOF\n"
    kept = set(chunks("pdf-v1", update))
    assert sum(c not in kept for c in chunks("pdf-v1", base)) <= 1
    assert chunks("pdf-v1", s.pdf(text, image, indirect=True))


@pytest.mark.parametrize("case", MALFORMED, ids=[m[0] for m in MALFORMED])
def test_rejections(case):
    with pytest.raises(Rejected) as e:
        boundaries(case[1], case[2])
    assert e.value.detail == case[3]


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_any_bytes_are_cut_or_rejected(data):
    for profile in PROFILES:
        for head in (b"", b"PK\3\4", b"%PDF-1.4\n", b"\x1a\x45\xdf\xa3", b"\0\0\0\x10ftyp", b"ID3"):
            try:
                ends = boundaries(profile, head + data)
            except Rejected:
                continue
            assert not ends or ends == sorted(set(ends))
