"""Every profile window by window: the same cuts and refusals as the whole value, in bounded state."""

import pickle
import random

import pytest

from sediment.functions.profiles import MAX_CHUNK, OOXML, PROFILES, Rejected
from sediment.operators import chunkers, push
from sediment.plans import formats
from sediment.plans import synthetic as s

STREAMS = [(name, profile, make) for name, profile, make, _, _ in formats.GOLDENS]
STREAMS += [
    ("zip", "zip-v1", lambda: s.zip_archive([("a.txt", s.prose("a", 90_000), True, "signed"), ("b", s.noise("b", 200_000), False, "plain"), ("c", s.noise("c", 70_000), True, "unsigned"), ("d", b"x", True, "wide")], b"note", True)),
    ("docx", OOXML, lambda: s.docx(s.xml("doc", 300_000), s.noise("img", 200_000))),
    ("docx_signed", OOXML, lambda: s.zip_archive([("[Content_Types].xml", b"<T/>" * 40, True, "signed"), ("word/document.xml", s.xml("d", 100_000), True, "signed")])),
    ("docx_bytes", "ooxml-ber-v1", lambda: s.docx(s.xml("doc", 300_000), s.noise("img", 200_000))),
    ("pdf", "pdf-v1", lambda: s.pdf(s.prose("t", 60_000), s.noise("i", 150_000))),
    ("pdf_indirect", "pdf-v1", lambda: s.pdf(s.prose("t", 60_000), s.noise("i", 150_000), True)),
    ("audio_id3", "framed-audio-v1", lambda: s.tagged_mp3("tag", "frames", 300) + b""),
    ("empty_text", "structured-text-v1", lambda: b""),
    ("empty", "generic-cdc-v1", lambda: b""),
    ("emoji", "structured-text-v1", lambda: ("日本😀é" * 60_000).encode()),
]


def fed(profile, data, sizes):
    """((start, bytes) of each chunk, the most bytes held) of a stream that is pickled between its windows."""
    stream, out, at, most = push.opened(profile), [], 0, 0
    while at < len(data):
        n = sizes()
        out += stream.push(data[at : at + n])
        at += n
        most = max(most, len(stream.tape.data))
        if random.random() < 0.05:
            stream = pickle.loads(pickle.dumps(stream))
    return out + stream.push(b"", True), most


@pytest.mark.parametrize("name, profile, make", STREAMS, ids=[x[0] for x in STREAMS])
def test_windows_cut_as_the_whole(name, profile, make):
    data = make()
    form, ends = chunkers.canonical_form(profile, data), chunkers.boundaries(profile, data)
    rng = random.Random(name)
    for sizes in (lambda: 65_536, lambda: rng.choice([1, 7, 100, 4096, 30_000, 300_000]), lambda: rng.randint(1, 9000)):
        chunks, most = fed(profile, data, sizes)
        assert [a + len(b) for a, b in chunks] == ends and b"".join(b for _, b in chunks) == form
        if profile != OOXML:
            assert most <= 2 * MAX_CHUNK + 300_000 + 65_536


def test_state_is_two_chunks_at_most():
    data = s.mp4("big", s.noise("mdat", 3 << 20))
    _, most = fed("isobmff-v1", data, lambda: 4096)
    assert most <= 2 * MAX_CHUNK + 4096 + push.MARGIN


def verdict(read):
    try:
        return read()
    except Rejected as e:
        return e.detail, e.offset


@pytest.mark.parametrize("size", [1, 3, 64])
def test_refusals_are_the_same(size):
    for name, profile, data, detail in formats.MALFORMED:
        whole = verdict(lambda: chunkers.boundaries(profile, data))
        assert whole[0] == detail
        assert verdict(lambda: fed(profile, data, lambda: size)) == whole, name


def test_damaged_streams_agree():
    rng = random.Random(9)
    small = {
        "zip-v1": s.zip_archive([("a.txt", s.prose("a", 300), True, "signed"), ("b", s.noise("b", 200), False, "unsigned")]),
        "isobmff-v1": s.mp4("x", s.noise("m", 500)),
        "matroska-v1": s.mkv("x", [s.cluster("c", 300)]),
        "mpegts-v1": s.ts_stream("x", 9, 3),
        "framed-audio-v1": s.tagged_mp3("t", "x", 3),
        "pdf-v1": s.pdf(s.prose("t", 100), s.noise("i", 80), True),
        "ooxml-v1": s.docx(s.xml("d", 200), s.noise("i", 100)),
        "ooxml-ber-v1": s.docx(s.xml("d", 200), s.noise("i", 100)),
        "structured-text-v1": s.markdown("x", 400),
    }
    assert {*small, "generic-cdc-v1"} == set(PROFILES)
    for profile, data in small.items():
        for _ in range(150):
            broken = bytearray(data[: rng.randint(1, len(data))] if rng.random() < 0.4 else data)
            for _ in range(rng.randint(0, 2)):
                broken[rng.randrange(len(broken))] = rng.choice([0, 10, 32, 60, 62, 255, rng.randrange(256)])
            broken = bytes(broken)
            whole = verdict(lambda: chunkers.boundaries(profile, broken))
            got = verdict(lambda: [a + len(b) for a, b in fed(profile, broken, lambda: rng.randint(1, 90))[0]])
            assert got == whole, (profile, broken)


def test_an_office_kind_can_be_expected():
    data = s.docx(b"<d/>" * 50, b"x")
    assert push.opened(OOXML, "word").push(data, True)
    with pytest.raises(Rejected):
        push.opened(OOXML, "excel").push(data, True)
    with pytest.raises(ValueError):
        push.opened("zip-v1", "word")
