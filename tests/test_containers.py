"""Taking containers apart and rebuilding them."""

import gzip
import io
import tarfile
import zipfile

import pytest

from sediment.operators import writers
from sediment.operators.decompose import Opaque, decompose
from sediment.plans import synthetic as s
from sediment.plans.formats import CONTAINERS, MEMBER_ROWS, OPAQUE, TEXT

ENTRIES = [("directory", b"d", b""), ("member", b"d/a.txt", b"words"), ("member", b"n" * 150, b""), ("symlink", b"l", b"t" * 120)]


@pytest.mark.parametrize("name, data", CONTAINERS, ids=[c[0] for c in CONTAINERS])
def test_members(name, data):
    ends = [e for e in decompose(data) if e.kind == "member_end"]
    want = [r for r in MEMBER_ROWS if r[0] == name]
    assert sorted((e.depth, e.ordinal, e.path.decode(), e.size, e.media_type, e.nested) for e in ends) == sorted(r[1:7] for r in want)


@pytest.mark.parametrize("name, data, why", OPAQUE, ids=[c[0] for c in OPAQUE])
def test_opaque(name, data, why):
    with pytest.raises(Opaque) as e:
        decompose(data)
    assert str(e.value) == why


@pytest.mark.parametrize(
    "data, detail",
    [
        (s.gzip(TEXT)[:-1], "gzip stream is truncated"),
        (s.gzip(TEXT)[:-8] + bytes(4) + s.gzip(TEXT)[-4:], "gzip CRC mismatch"),
        (s.gzip(TEXT)[:-4] + bytes(4), "gzip ISIZE mismatch"),
        (b"\x1f\x8b\x08\xe0" + bytes(10), "reserved gzip flag bits set"),
        (s.tar([(b"a", b"x", b"0", b"")])[:700], "tar archive is truncated"),
        (s.tar([(b"a", b"x", b"0", b"")])[:513] + b"y" * 511, "nonzero tar padding"),
        (s.tar([(b"a", b"x", b"0", b"")]) + b"z" * 512, "bytes after the tar end marker"),
        (s.tar([(b"a", b"x", b"9", b"")]), "unknown tar entry type"),
        (s.zip_archive([("a/", b"x", False, "plain")]), "zip directory entry declares a payload"),
    ],
)
def test_malformed(data, detail):
    with pytest.raises(Opaque) as e:
        decompose(data)
    assert e.value.kind == "Malformed" and e.value.detail == detail


def test_members_are_bounded(monkeypatch):
    from sediment.operators import decompose as d

    assert d.MAX_MEMBERS == 1_000_000
    monkeypatch.setattr(d, "MAX_MEMBERS", 3)
    many = s.tar([(b"m%d" % i, b"x", b"0", b"") for i in range(4)])
    assert len([e for e in decompose(s.tar([(b"m%d" % i, b"x", b"0", b"") for i in range(3)])) if e.kind == "member_end"]) == 3
    with pytest.raises(Opaque) as e:
        decompose(many)
    assert e.value.kind == "MetadataOverBound"


def test_a_member_larger_than_declared_is_refused_before_it_is_held():
    from sediment.operators.office import inflate

    raw = s.raw_deflate(bytes(50_000_000))
    assert inflate(raw, 10) == (None, "size") and inflate(raw[:-1], 10) == (None, "geometry") and inflate(raw + b"x", 10) == (None, "geometry")
    assert inflate(s.raw_deflate(b"words"), 5) == (b"words", None) and inflate(b"\xff\xff", 5)[1] == "malformed"


def test_padding_follows_an_overriding_size():
    """A pax size that differs from the header's field frames the data by the size that holds."""
    body = b"q" * 700
    plain = s.tar([(b"f", body, b"0", b"")])
    header = bytearray(plain[:512])
    header[124:136] = b"%011o\0" % 1
    header[148:156] = b" " * 8
    header[148:156] = b"%06o\0 " % sum(header)
    pax = s.tar([(b"x", b"12 size=700\n", b"x", b"")])[:1024]
    data = pax + bytes(header) + plain[512:]
    assert [e.content for e in decompose(data) if e.kind == "member_end"] == [body]


def test_rebuilt_containers_read_with_the_standard_library():
    made = writers.tar(ENTRIES)
    with tarfile.open(fileobj=io.BytesIO(made)) as t:
        assert [m.name for m in t.getmembers()] == ["d", "d/a.txt", "n" * 150, "l"]
        assert t.getmembers()[3].linkname == "t" * 120 and all(m.mtime == 0 for m in t.getmembers())
    packed = writers.zip_(ENTRIES[:3])
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        assert z.namelist() == ["d/", "d/a.txt", "n" * 150] and z.read("d/a.txt") == b"words" and z.testzip() is None
    assert gzip.decompress(writers.gzip(TEXT)) == TEXT and writers.gzip(TEXT)[:10] == bytes.fromhex("1f8b08000000000000ff")


def test_framings_of_archives():
    made = s.zip_archive([("a", TEXT, True, "signed"), ("b", TEXT, True, "unsigned"), ("c", TEXT, False, "wide"), ("d", TEXT, False, "signed")], b"note", True)
    assert [e.content for e in decompose(made) if e.kind == "member_end"] == [TEXT] * 4
