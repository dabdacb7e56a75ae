"""Queries over synthetic streams of each format: frozen boundaries, whole and window by window, cuts that follow
from the layout, rejections, decomposition, reports, rebuilding."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.functions import paths, sql
from sediment.operators import analysis, api, chunkers, push, writers
from sediment.plans import synthetic as s
from sediment.plans.routing import values

FOUR = 4 << 20
# Chunk counts and digests of the ends.
GOLDENS: list[tuple[str, str, Callable[[], bytes], int, str]] = [
    ("noise", "generic-cdc-v1", lambda: s.noise("els05/golden", FOUR), 59, "805772eed894132f"),
    ("markdown", "structured-text-v1", lambda: s.markdown("els06/golden", FOUR), 64, "8bb01e8519dba671"),
    ("json", "structured-text-v1", lambda: s.minified_json("els06/golden", FOUR), 50, "58fb93728ae7c51b"),
    ("xml", "structured-text-v1", lambda: s.xml("els06/golden", FOUR), 81, "72521c0a749656ee"),
    ("mp4", "isobmff-v1", lambda: s.mp4("els08/golden", s.noise("els08/golden/mdat", FOUR)), 57, "091f2af912cc26de"),
    ("fmp4", "isobmff-v1", lambda: s.fragmented_mp4("els08/golden", [s.noise(f"els08/golden/frag{i}", 300 << 10) for i in range(6)]), 28, "e5f9471e459dd763"),
    ("heif", "isobmff-v1", lambda: s.heif("els08/golden", s.noise("els08/golden/pic", 1 << 20)), 16, "aeec3468ab8ecb7f"),
    ("mkv", "matroska-v1", lambda: s.mkv("els09/golden", [s.cluster(f"els09/golden/cluster{i}", 400 << 10) for i in range(6)], s.element(0x1254C367, s.noise("els09/golden/tags", 500))), 36, "eb8d0bd1ad053967"),
    ("webm", "matroska-v1", lambda: s.streamed_webm("els09/golden", 5), 25, "7668bea86707a34e"),
    ("ts", "mpegts-v1", lambda: s.ts_stream("els10/golden", 20000, 40), 51, "aa45efe720954891"),
    ("mp3", "framed-audio-v1", lambda: s.tagged_mp3("els11/golden/tag", "els11/golden", 4000), 28, "23f3a3ab1c28450f"),
    ("adts", "framed-audio-v1", lambda: s.adts_frames("els11/golden", 3000), 27, "2f48b1924f436110"),
    ("flac", "framed-audio-v1", lambda: s.flac("els11/golden", 60 << 10, 2 << 20), 30, "fa9ea9387cb542f5"),
]


def _zip(*members: tuple, **how) -> bytes:
    return s.zip_archive(list(members), **how)


PLAIN = _zip(("a.txt", b"hello", False, "plain"))
# What each broken stream is refused for.
MALFORMED = [
    ("text_lead", "structured-text-v1", b"abc\xf5", "invalid UTF-8 lead byte"),
    ("text_overlong", "structured-text-v1", b"abc\xe0\x80\x80", "invalid UTF-8 continuation byte"),
    ("text_surrogate", "structured-text-v1", b"\xed\xa0\x80", "invalid UTF-8 continuation byte"),
    ("text_cut", "structured-text-v1", b"abc\xe6\x97", "stream ends inside a UTF-8 scalar"),
    ("zip_empty", "zip-v1", b"", "archive ends inside a record or before its end record"),
    ("zip_cut", "zip-v1", PLAIN[:-1], "archive ends inside a record or before its end record"),
    ("zip_signature", "zip-v1", b"PK\3\5" + PLAIN[4:], "unknown ZIP record signature"),
    ("zip_trailing", "zip-v1", PLAIN + b"x", "bytes after the archive comment"),
    ("zip_sizes", "zip-v1", PLAIN[:22] + b"\6" + PLAIN[23:], "stored member declares unequal sizes"),
    ("zip_count", "zip-v1", PLAIN[:-12] + b"\2" + PLAIN[-11:], "end-of-central-directory entry count mismatch"),
    ("zip_geometry", "zip-v1", PLAIN[:-6] + b"\1" + PLAIN[-5:], "central directory offset or size mismatch"),
    ("zip_late_member", "zip-v1", PLAIN[:-22] + PLAIN, "local file header after the central directory"),
    ("box_first", "isobmff-v1", s.box(b"abcd", b"x"), "stream does not begin with an ISO BMFF box"),
    ("box_small", "isobmff-v1", s.ftyp(b"isom") + s.be32(7) + b"free", "box size is smaller than its header"),
    ("box_open", "isobmff-v1", s.ftyp(b"isom") + s.box(b"moov", s.be32(0) + b"mvhd"), "open-ended box size below top level"),
    ("box_overrun", "isobmff-v1", s.ftyp(b"isom") + s.box(b"moov", s.be32(99) + b"mvhd"), "child box runs past its parent"),
    ("box_cut", "isobmff-v1", s.ftyp(b"isom")[:-1], "stream ends inside a box"),
    ("ebml_first", "matroska-v1", s.element(0x18538067, b""), "stream does not begin with the EBML header"),
    ("ebml_id", "matroska-v1", s.ebml(b"webm") + b"\x01", "invalid EBML element ID"),
    ("ebml_size", "matroska-v1", s.ebml(b"webm") + b"\xec\0", "invalid EBML element size"),
    ("ebml_top", "matroska-v1", s.ebml(b"webm") + s.element(0xE7, b"x"), "unexpected top-level element"),
    ("ebml_unknown", "matroska-v1", s.ebml(b"webm") + s.element(0x18538067, s.element(0x1549A966, b"", True), True), "unknown size outside Segment and Cluster"),
    ("ebml_cut", "matroska-v1", s.ebml(b"webm"), "stream ends inside an element"),
    ("ts_sync", "mpegts-v1", b"\0" * 188, "packet does not begin with the 0x47 sync byte"),
    ("ts_control", "mpegts-v1", b"\x47" + b"\0" * 187, "reserved adaptation-field control"),
    ("ts_field", "mpegts-v1", b"\x47\0\0\x30\xb7" + bytes(183), "adaptation field overruns its packet"),
    ("ts_partial", "mpegts-v1", b"\x47\0\0\x10" + bytes(100), "stream ends inside a packet"),
    ("ts_empty", "mpegts-v1", b"", "stream holds no packets"),
    ("audio_first", "framed-audio-v1", b"RIFF", "stream is not a known framed-audio format"),
    ("audio_sync", "framed-audio-v1", s.mp3_frames("x", 1) + b"\0", "frame boundary holds no frame sync, tag, or trailer"),
    ("audio_free", "framed-audio-v1", b"\xff\xfb\x00\x00", "free-format MPEG bitrate"),
    ("audio_header", "framed-audio-v1", b"\xff\xfb\xf0\x00", "frame header carries a reserved field"),
    ("audio_tag", "framed-audio-v1", b"ID3\4\0\0\x80\0\0\0", "malformed ID3 tag"),
    ("audio_block", "framed-audio-v1", b"fLaC\x04\0\0\0", "malformed FLAC metadata block"),
    ("audio_trailing", "framed-audio-v1", s.mp3_frames("x", 1) + b"TAG" + bytes(126), "bytes after the `ID3v1` trailer"),
    ("pdf_magic", "pdf-v1", b"%PDX", "stream does not begin with %PDF-"),
    ("pdf_keyword", "pdf-v1", b"%PDF-1.4\n?", "unknown body keyword"),
    ("pdf_object", "pdf-v1", b"%PDF-1.4\n1 obj", "indirect object header is not 'number generation obj'"),
    ("pdf_stream", "pdf-v1", b"%PDF-1.4\n1 0 obj << /Length 1 >> stream x", "stream keyword is not followed by a line end"),
    ("pdf_eof", "pdf-v1", s.pdf(b"x", b"y")[:-1], "document ends without %%EOF"),
    ("pdf_string", "pdf-v1", b"%PDF-1.4\n1 0 obj (open", "document ends inside an object, stream, xref table, or trailer"),
    ("package_first", "ooxml-v1", PLAIN, "first member is not [Content_Types].xml"),
    ("package_kind", "ooxml-v1", _zip(("[Content_Types].xml", b"<T/>", True, "plain")), "no Word, Excel, or PowerPoint main part"),
    ("package_signed", "ooxml-v1", _zip(("[Content_Types].xml", b"<T/>", True, "plain"), ("_xmlsignatures/o", b"x", False, "plain")), "package is digitally signed; canonicalization would invalidate the signature — store it byte-exact under ooxml-ber-v1"),
]


def _streams(spark: SparkSession, cases: list[tuple[str, str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(n, p, bytearray(b)) for n, p, b in cases], "name string, profile string, content binary")


def _frozen(spark: SparkSession, ends_of: Callable[[str, bytes], list[int]]) -> DataFrame:
    """Each format's frozen stream: its chunk count and the digest of its ends. Workers make the streams, one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases = {name: (profile, make) for name, profile, make, _, _ in GOLDENS}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                profile, make = cases[name]
                ends = ends_of(profile, make())
                yield pa.RecordBatch.from_pylist([{"name": name, "profile": profile, "chunks": len(ends), "digest": s.digest(ends)}])

    names = spark.createDataFrame([(n,) for n, *_ in GOLDENS], "name string").repartition(len(GOLDENS), "name")
    return names.mapInArrow(run, "name string, profile string, chunks long, digest string")


def format_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frozen(spark, chunkers.boundaries)


def pushed_ends(profile: str, data: bytes, size: int = 10_007) -> list[int]:
    """Ends of a value that is pushed in windows of `size` bytes."""
    stream = push.opened(profile)
    found = [x for a in range(0, len(data), size) for x in stream.push(data[a : a + size])]
    return [start + len(body) for start, body in found + stream.push(b"", True)]


def pushed_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen streams again, window by window."""
    return _frozen(spark, pushed_ends)


#: Members of one byte each, over and over, in which no hash cuts: the layout alone decides.
SIZES = (20_000, 5_000, 17_000, 300, 40_000)
LAYOUT = [(f"part{i}.bin", b"\0" * n) for i, n in enumerate(SIZES)]
STORED = s.zip_archive([(n, b, False, "plain") for n, b in LAYOUT])
BOOK = [("[Content_Types].xml", b"\0" * 5_000), ("xl/workbook.xml", b"\0" * 9_000), ("xl/media/a.png", b"\0" * 3_000), ("xl/media/b.png", b"\0" * 30_000)]
STORED_BOOK = s.zip_archive([(n, b, False, "plain") for n, b in BOOK])
PACKED_BOOK = s.zip_archive([(n, b, True, "plain") for n, b in BOOK])
PAPER_OBJECTS = (6_000, 2_000, 30_000)


def paper() -> tuple[bytes, list[int]]:
    """A PDF whose objects hold strings of the given sizes, and where each object begins."""
    out, at = b"%PDF-1.7\n", []
    for i, n in enumerate(PAPER_OBJECTS):
        at.append(len(out))
        out += b"%d 0 obj\n(" % (i + 1) + b"\0" * n + b")\nendobj\n"
    return out + b"trailer\n<< /Size 4 >>\n%%EOF\n", at


def layout_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of an archive, a package in both forms and a PDF, whose contents give no cut of their own."""
    rows = _streams(spark, [("archive", "zip-v1", STORED), ("package", "ooxml-v1", PACKED_BOOK), ("package_bytes", "ooxml-ber-v1", STORED_BOOK), ("paper", "pdf-v1", paper()[0])])
    found = rows.withColumn("b", api.boundaries_udf()("content", "profile"))
    return found.select("name", F.posexplode("b.ends").alias("ordinal", "end")).withColumn("ordinal", F.col("ordinal").cast("long"))


def _layout_ends(starts: list[int], size: int, least: int) -> list[int]:
    """Where units begin -> ends, by the rules on units: a unit closes a chunk of `least` bytes or more, a smaller rest
    joins the chunk before it while both fit into 256 KiB, and the last chunk takes what is left."""
    ends, start = [], 0
    for at in [x for x in starts if x]:
        if at - start >= least:
            ends.append(at)
            start = at
        elif ends and at - (ends[-2] if len(ends) > 1 else 0) <= 256 * 1024:
            ends[-1] = start = at
    return [*ends, size] if start < size else ends


def _record_starts(members: list[tuple[str, bytes]]) -> list[int]:
    out = [0]
    for name, body in members:
        out.append(out[-1] + 30 + len(name) + len(body))
    return out


def _layout_rows() -> list[tuple]:
    body, objects = paper()
    trailer, mark = len(body) - len(b"trailer\n<< /Size 4 >>\n%%EOF\n"), len(body) - len(b"%%EOF\n")
    cases = {
        "archive": (_record_starts(LAYOUT), len(STORED), 16 * 1024),
        "package": (_record_starts(BOOK), len(STORED_BOOK), 4 * 1024),
        "package_bytes": (_record_starts(BOOK), len(STORED_BOOK), 4 * 1024),
        "paper": ([*objects, trailer, mark], len(body), 4 * 1024),
    }
    return [(name, i, end) for name, (starts, size, least) in cases.items() for i, end in enumerate(_layout_ends(starts, size, least))]


def malformed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streams(spark, [(n, p, b) for n, p, b, _ in MALFORMED])
    return rows.withColumn("b", api.boundaries_udf()("content", "profile")).select("name", "profile", F.col("b.error").alias("detail"))


TEXT = s.prose("text", 9000)
NOTES = s.gzip(TEXT, b"")
INNER = s.zip_archive([("pkg/Main.toml", TEXT, True, "plain"), ("pkg/notes.txt.gz", NOTES, False, "plain")])
RAW = s.noise("raw", 2500)
CONTAINERS = [
    ("zip", s.zip_archive([("letters/one.csv", TEXT, True, "plain"), ("pictures/", b"", False, "plain"), ("pictures/raw.dat", RAW, False, "plain")])),
    ("office", s.zip_archive([("[Content_Types].xml", b"<Types/>", True, "signed"), ("xl/workbook.xml", b"<w/>" * 700, True, "signed")])),
    ("tar", s.tar([(b"logs/", b"", b"5", b""), (b"logs/today.yaml", TEXT, b"0", b""), (b"logs/latest", b"", b"2", b"today.yaml"), (b"logs/same", b"", b"1", b"logs/today.yaml"), (b"years/" * 25 + b"all.json", TEXT, b"0x", b""), (b"years/" * 25 + b"all.json", TEXT, b"0L", b"")])),
    ("targz", s.gzip(s.tar([(b"src/style.css", TEXT, b"0", b"")]), b"src.tar")),
    ("gz", s.gzip(TEXT, b"table.tsv")),
    ("gz_joined", s.gzip(TEXT[:2500]) + s.gzip(TEXT[2500:])),
    ("nested", s.tar([(b"outer.jar", INNER, b"0", b""), (b"read.md", TEXT, b"0", b"")])),
    ("misnamed", s.tar([(b"movie.mp4", INNER, b"0", b"")])),
]


def _deep(levels: int) -> bytes:
    body = TEXT
    for i in range(levels):
        body = s.tar([(b"d%d.tar" % i if i else b"leaf", body, b"0", b"")])
    return body


def _broken_member() -> bytes:
    """A deflated member whose bytes are no deflate stream."""
    made = s.zip_archive([("bad.txt", b"words " * 30, True, "plain")])
    at = 30 + len("bad.txt")
    return made[:at] + b"\xff" * 8 + made[at + 8 :]


PLAIN_GZ, PLAIN_TAR = s.gzip(b"words", b"w.txt"), s.tar([(b"a", b"x", b"0", b"")])
# Why each container is opaque.
OPAQUE = [
    ("not_a_container", b"just some words", "input is not a recognized container"),
    ("encrypted", PLAIN[:6] + b"\1" + PLAIN[7:], "encrypted without a supplied key"),
    ("escaping", s.zip_archive([("up/../../y", b"x", False, "plain")]), "member path is absolute or escapes the root"),
    ("absolute", s.tar([(b"/srv/y", b"x", b"0", b"")]), "member path is absolute or escapes the root"),
    ("nine_deep", _deep(9), "container nesting exceeds the depth cap"),
    ("sparse", s.tar([(b"holes", b"", b"S", b"")]), "unsupported feature: sparse tar member"),
]
# Details of broken containers.
BROKEN = [
    ("gzip_cut", PLAIN_GZ[:-2], "gzip stream is truncated"),
    ("gzip_flags", b"\x1f\x8b\x08\x20" + bytes(12), "reserved gzip flag bits set"),
    ("gzip_crc", PLAIN_GZ[:-8] + bytes(4) + PLAIN_GZ[-4:], "gzip CRC mismatch"),
    ("gzip_size", PLAIN_GZ[:-4] + b"\xff\0\0\0", "gzip ISIZE mismatch"),
    ("gzip_body", PLAIN_GZ[:16] + b"\xff" * 20, "gzip deflate body is malformed"),
    ("gzip_second", PLAIN_GZ + b"not one more", "not a gzip header"),
    ("tar_cut", PLAIN_TAR[:800], "tar archive is truncated"),
    ("tar_padding", PLAIN_TAR[:520] + b"y" + PLAIN_TAR[521:], "nonzero tar padding"),
    ("tar_checksum", PLAIN_TAR[:10] + b"z" + PLAIN_TAR[11:], "tar header checksum mismatch"),
    ("tar_behind", PLAIN_TAR + b"more".ljust(512, b"\0"), "bytes after the tar end marker"),
    ("tar_lone", PLAIN_TAR[:1024] + bytes(512) + PLAIN_TAR[:1024] + bytes(1024), "lone zero block inside the archive"),
    ("tar_type", s.tar([(b"a", b"", b"Z", b"")]), "unknown tar entry type"),
    ("tar_payload", s.tar([(b"a", b"x", b"5", b"")]), "tar metadata entry declares a payload"),
    ("pax_newline", s.tar([(b"p", b"9 path=ab", b"x", b"")]), "pax record does not end in newline"),
    ("pax_length", s.tar([(b"p", b"x path=a\n", b"x", b"")]), "pax record length is not decimal"),
    ("pax_range", s.tar([(b"p", b"99 path=a\n", b"x", b"")]), "pax record length out of range"),
    ("pax_equals", s.tar([(b"p", b"9 pathab\n", b"x", b"")]), "pax record has no '='"),
    ("pax_size", s.tar([(b"p", b"10 size=x\n", b"x", b"")]), "pax size is not decimal"),
    ("zip_directory", s.zip_archive([("dir/", b"x", False, "plain")]), "zip directory entry declares a payload"),
    ("zip_deflate", _broken_member(), "zip member deflate stream is malformed"),
]


def _events(spark: SparkSession, cases: list[tuple[str, bytes]]) -> DataFrame:
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in cases], "name string, content binary")
    return api.events(rows, keep=("name",))


def decompose_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.members(_events(spark, CONTAINERS))
    return found.select("name", "depth", "ordinal", F.col("path").cast("string").alias("path"), "size", "media_type", "nested", (F.sha2("content", 256) == F.sha2(F.lit(bytearray(TEXT)), 256)).alias("is_text"))


def decompose_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.containers(_events(spark, CONTAINERS)).select("name", "depth", "container", "members", "entries", "office")


def decompose_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, CONTAINERS).where("kind = 'entry'")
    return found.select("name", F.col("path").cast("string").alias("path"), "entry", F.col("target").cast("string").alias("target"), F.coalesce("mode", F.lit(-1)).alias("mode"), F.coalesce("mtime", F.lit(-1)).alias("mtime"))


def decompose_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, [(n, b) for n, b, _ in OPAQUE]).where("kind = 'opaque'").select("name", "detail")


def broken_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What broken gzip, tar and zip containers are refused for; the text before the detail is the same for all."""
    found = _events(spark, [(n, b) for n, b, _ in BROKEN]).where("kind = 'opaque'")
    return found.select("name", "reason", F.regexp_extract("detail", "(?s)^(?:.*?: )?([^:]*?)(?: at byte [0-9]+)?$", 1).alias("detail"))


def inspect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = analysis.inspect(_events(spark, [c for c in CONTAINERS if c[0] in ("zip", "nested")]))
    return lines.select("name", (F.row_number().over(W.partitionBy("name").orderBy("seq")) - 1).alias("line_no"), "line")


#: Files of a corpus: containers with paths that repeat and levels within, files of one name and of none, and broken ones.
FILES = [
    ("in/all.zip", CONTAINERS[0][1]),
    ("in/twice.tar", s.tar([(b"same.md", b"one\n", b"0", b""), (b"same.md", b"two two\n", b"0", b""), (b"b.jar", s.zip_archive([("x.md", b"x\n", False, "plain"), ("y.md", b"yy\n", False, "plain")]), b"0", b"")])),
    ("dup.md", b"a" * 30),
    ("dup.md", b"b" * 40),
    ("late/dup.md", b"\xff" * 50),
    (None, b"\0\1" * 60),
    ("bad.zip", b"PK\3\4" + bytes(20)),
    ("void.tar", bytes(0)),
]


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p, bytearray(b)) for p, b in FILES], "path string, content binary")
    return analysis.corpus_report(rows).select("path", "input_bytes", "route", "reason", "members", "chunks", "stored_bytes", "stored")


def rebuilt_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers rebuilt in their canonical form, as the standard library reads them."""

    def read(kind: str, data: bytes) -> list[tuple]:
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
        return [("", gzip.decompress(data))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = {"tar": writers.tar, "zip": writers.zip_, "gzip": lambda entries: writers.gzip(entries[1][2])}
        for batch in batches:
            for kind in batch.column(0).to_pylist():
                found = read(kind, write[kind](REBUILT))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array([p for p, _ in found]), pa.array([b for _, b in found], pa.binary())], names=["container", "path", "content"])

    out = spark.createDataFrame([("tar",), ("zip",), ("gzip",)], "container string").mapInArrow(run, "container string, path string, content binary")
    return out.select("container", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


REBUILT = [("directory", b"d", b""), ("member", b"d/letters.txt", b"abc" * 300), ("member", b"long/" * 40 + b"name.bin", b"x" * 700), ("member", b"empty", b"")]


def package_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package stored and deflated has one canonical form, in which each member stands where its header says."""
    rows = spark.createDataFrame([("stored", bytearray(STORED_BOOK)), ("packed", bytearray(PACKED_BOOK))], "form string, content binary")
    chunks = api.chunk(rows, api.by_profile("ooxml-v1"), keep=("form",), with_data=True)
    whole = chunks.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.hex("data").alias("data")))).alias("c"))
    whole = whole.select("form", F.unhex(F.array_join(F.transform("c", lambda x: x["data"]), "")).alias("data"))
    found = api.package_members(rows, keep=("form",)).join(whole, "form")
    start = (F.col("offset") + 30 + F.octet_length("name") + 1).cast("int")
    return found.select("form", "ordinal", F.col("name").cast("string").alias("name"), "offset", "size", F.sha2(F.substr("data", start, F.col("size").cast("int")), 256).alias("digest"))


def _tagged(frames: bytes, tag: int) -> bytes:
    return s.id3v2(f"tag{tag}", tag) + frames


def _frames(seed: str, n: int) -> bytes:
    """MP3 frames of 417 bytes, all without padding."""
    body = s.noise(seed, 413 * n)
    return b"".join(b"\xff\xfb\x90\0" + body[413 * i : 413 * (i + 1)] for i in range(n))


def _flac(comment: int) -> bytes:
    return s.flac(f"flac{comment}", comment, 0) + s.noise("flac/audio", 4 << 20)


def _rows_xml(n: int, extra: int | None = None) -> bytes:
    out = [f'<row r="{i}"><c>{i * 2654435761 % (1 << 32):08x}</c></row>\n' for i in range(n)]
    if extra is not None:
        out.insert(extra, "<row><c>one more</c></row>\n")
    return ("<sheet>\n" + "".join(out) + "</sheet>\n").encode()


def _movie(info: str) -> bytes:
    return s.ebml(b"matroska") + s.element(0x18538067, s.element(0x1549A966, s.noise(info, 180)) + b"".join(s.cluster(f"clusters/{i}", 400 << 10) for i in range(4)))


def _spliced() -> bytes:
    packets, at = s.ts_stream("splice", 8000, 40), 4000 * 188
    fresh = bytearray(s.ts_stream("other", 40, 40))
    # the packet behind the splice says that the stream is discontinuous: an adaptation field with that flag
    back = bytearray(packets[at:])
    fresh[3], fresh[4], fresh[5] = 0x30 | fresh[3] & 15, 1, 0x80
    back[3], back[4], back[5] = 0x30 | back[3] & 15, 1, 0x80
    return packets[:at] + bytes(fresh) + bytes(back)


_PAGE = b"3 0 obj\n<< /Type /Page /Rotate 90 >>\nendobj\nxref\n3 1\n0000000000 00000 n \ntrailer\n<< /Size 7 >>\nstartxref\n9\n%%EOF\n"
#: Edits that must leave most chunks as they are: (name, profile, the stream and its edited form, the bound).
REUSE: list[tuple[str, str, Callable[[], tuple[bytes, bytes]], str]] = [
    *[(f"shift_{n}", "generic-cdc-v1", lambda n=n: (s.noise("shift", 2 << 20), b"x" * n + s.noise("shift", 2 << 20)), "chunk_percent > 90") for n in (1, 64, 4096, 65536)],
    *[(f"text_shift_{n}", "structured-text-v1", lambda n=n: (s.markdown("shift", 2 << 20), b"x" * n + s.markdown("shift", 2 << 20)), "chunk_percent > 90") for n in (1, 64, 4096, 65536)],
    ("text_insert", "structured-text-v1", lambda: (t := s.markdown("insert", 2 << 20), t[: len(t) // 2].rsplit(b"\n", 1)[0] + b"\n" + b"new words\n" * 205 + t[len(t[: len(t) // 2].rsplit(b"\n", 1)[0]) + 1 :]), "chunk_percent > 90"),
    ("movie_remux", "isobmff-v1", lambda: (s.mp4("one", s.noise("mdat", 2 << 20)), s.mp4("two", s.noise("mdat", 2 << 20))), "new_chunks = 1"),
    ("movie_metadata", "matroska-v1", lambda: (_movie("info/a"), _movie("info/b")), "new_chunks <= 2"),
    *[(f"packets_{n}", "mpegts-v1", lambda n=n: (s.ts_stream("lead", 20_000, 40), s.ts_stream("before", n, 40) + s.ts_stream("lead", 20_000, 40)), "chunk_percent > 85") for n in (1, 39, 173)],
    ("packets_splice", "mpegts-v1", lambda: (s.ts_stream("splice", 8000, 40), _spliced()), "new_chunks <= 3"),
    ("audio_retag", "framed-audio-v1", lambda: (_tagged(f := _frames("retag", 4000), 2 << 10), _tagged(f, 9 << 10)), "new_chunks <= 4"),
    ("audio_joined", "framed-audio-v1", lambda: ((a := _frames("first", 3000)) + (b := _frames("second", 3000)) + a, a + b), "new_chunks <= 3"),
    ("flac_retag", "framed-audio-v1", lambda: (_flac(8 << 10), _flac(20 << 10)), "chunk_percent > 85"),
    ("package_media", "ooxml-v1", lambda: (s.docx(s.xml("one", 90_000), s.noise("media", 340_000)), s.docx(s.xml("two", 90_000), s.noise("media", 340_000))), "shared_bytes >= 307200"),
    ("package_row", "ooxml-v1", lambda: (s.docx(_rows_xml(12_000), b"x"), s.docx(_rows_xml(12_000, 6000), b"x")), "byte_percent > 50 and longest < 262144"),
    ("paper_update", "pdf-v1", lambda: (s.pdf(s.prose("t", 20_000), s.noise("i", 200_000)) + _PAGE, s.pdf(s.prose("t", 20_000), s.noise("i", 200_000))), "new_chunks <= 1"),
    ("paper_edit", "pdf-v1", lambda: (s.pdf(s.prose("t", 20_000), s.noise("i", 200 << 10)), s.pdf(s.prose("u", 21_000), s.noise("i", 200 << 10))), "byte_percent > 50"),
    ("json_cuts", "structured-text-v1", lambda: (b"", s.minified_json("forced", 2 << 20)), "forced_percent < 25 and total_bytes / chunks < 131072"),
]


def reuse_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each edit leaves as many chunks or bytes as it must."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases = {name: (profile, make) for name, profile, make, _ in REUSE}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                profile, make = cases[name]
                yield pa.RecordBatch.from_pydict({"name": [name] * 2, "profile": [profile] * 2, "base": [True, False], "content": list(make())})

    names = spark.createDataFrame([(n,) for n, *_ in REUSE], "name string").repartition(len(REUSE), "name")
    streams = names.mapInArrow(made, "name string, profile string, base boolean, content binary").select("name", F.col("profile").alias("p"), "base", "content")
    chunks = api.chunk(streams, F.col("p"), keep=("name", "base"))
    length = F.when(~F.col("base"), F.col("length"))
    forced = chunks.groupBy("name").agg(F.max(length).alias("longest"), analysis.ratio(F.count_if(length >= 1 << 18), F.count(length)).alias("forced_percent"))
    found = analysis.reuse(chunks, "name", F.col("base")).join(forced, "name")
    holds = F.lit(None).cast("boolean")
    for name, _, _, bound in REUSE:
        holds = F.when(F.col("name") == name, F.expr(bound)).otherwise(holds)
    return found.select("name", holds.alias("holds"))


def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of container each value is by its first bytes; null for none."""
    plain = [("words", b"words"), ("null", bytes(600)), ("short_tar", PLAIN_TAR[:500])]
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in [*CONTAINERS, *plain]], "name string, content binary")
    return rows.select("name", paths.container_kind(F.col("content")).alias("kind"))


def expected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook under both package profiles, with each Office kind expected of it."""
    rows = _streams(spark, [("canonical", "ooxml-v1", PACKED_BOOK), ("bytes", "ooxml-ber-v1", PACKED_BOOK)])
    out = None
    for kind in ("word", "excel", "powerpoint"):
        cut = api.chunk(rows, F.col("profile"), keep=("name",), expected=kind, digest=None)
        one = cut.groupBy("name").agg((F.count("ordinal") > 0).alias("cut"), F.max("error").alias("error")).withColumn("expected", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def sql_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers taken apart, packages rewritten and media types parsed, all in SQL."""
    sql.register(spark)
    cases = [*[(n, b, None) for n, b in CONTAINERS], ("book", PACKED_BOOK, "Application/ZIP; v=1"), ("words", b"words", "no type")]
    rows = spark.createDataFrame([(n, bytearray(b), t) for n, b, t in cases], "name string, content binary, declared string")
    return spark.sql(
        """
        SELECT r.name, count_if(e.kind = 'member_end') AS members, count_if(e.kind = 'entry') AS entries, max(e.detail) AS detail,
               any_value(octet_length(cdc_canonical_ooxml(r.content))) AS canonical, any_value(cdc_media_type(r.declared)).essence AS essence, any_value(cdc_media_type(r.declared)).error AS error
        FROM {rows} r, LATERAL cdc_decompose(r.content) e GROUP BY r.name""",
        rows=rows,
    )


LONG = "years/" * 25 + "all.json"
MEMBER_ROWS = [
    ("zip", 0, 0, "letters/one.csv", 9000, "text/csv", False, True),
    ("zip", 0, 2, "pictures/raw.dat", 2500, None, False, False),
    ("office", 0, 0, "[Content_Types].xml", 8, "application/xml", False, False),
    ("office", 0, 1, "xl/workbook.xml", 2800, "application/xml", False, False),
    ("tar", 0, 1, "logs/today.yaml", 9000, "application/yaml", False, True),
    ("tar", 0, 4, LONG, 9000, "application/json", False, True),
    ("tar", 0, 5, LONG, 9000, "application/json", False, True),
    ("targz", 0, 0, "src/style.css", 9000, "text/css", False, True),
    ("gz", 0, 0, "table.tsv", 9000, "text/tab-separated-values", False, True),
    ("gz_joined", 0, 0, "", 9000, None, False, True),
    ("nested", 0, 0, "outer.jar", len(INNER), "application/java-archive", True, None),
    ("nested", 1, 0, "pkg/Main.toml", 9000, "application/toml", False, True),
    ("nested", 1, 1, "pkg/notes.txt.gz", len(NOTES), "application/gzip", True, None),
    ("nested", 2, 0, "", 9000, None, False, True),
    ("nested", 0, 1, "read.md", 9000, "text/markdown", False, True),
    ("misnamed", 0, 0, "movie.mp4", len(INNER), None, False, False),
]
CONTAINER_ROWS = [
    ("zip", 0, "zip", 2, 1, None), ("office", 0, "zip", 2, 0, "excel"), ("tar", 0, "tar", 3, 3, None), ("targz", 0, "tar+gzip", 1, 0, None), ("gz", 0, "gzip", 1, 0, None), ("gz_joined", 0, "gzip", 1, 0, None),
    ("nested", 0, "tar", 2, 0, None), ("nested", 1, "zip", 2, 0, None), ("nested", 2, "gzip", 1, 0, None), ("misnamed", 0, "tar", 1, 0, None),
]
ENTRY_ROWS = [("zip", "pictures/", "directory", None, -1, -1), ("tar", "logs/", "directory", None, 0o640, 1234), ("tar", "logs/latest", "symlink", "today.yaml", 0o640, 1234), ("tar", "logs/same", "hardlink", "logs/today.yaml", 0o640, 1234)]
LINES = [
    ("zip", ["[zip]", "letters/one.csv  8.8 KiB  text/csv", "pictures/  (directory)", "pictures/raw.dat  2.4 KiB  -", "= 2 members, 1 entries"]),
    ("nested", ["[tar]", "  [zip]", "  pkg/Main.toml  8.8 KiB  application/toml", "    [gzip]", "      8.8 KiB  -", "    = 1 members, 0 entries", f"  pkg/notes.txt.gz  {len(NOTES) / 1024:.1f} KiB  application/gzip", "  = 2 members, 0 entries", f"outer.jar  {len(INNER) / 1024:.1f} KiB  application/java-archive", "read.md  8.8 KiB  text/markdown", "= 2 members, 0 entries"]),
]
FILE_ROWS = [
    ("in/all.zip", len(FILES[0][1]), "decomposed", None, 2, 2, 11_500, "11.2 KiB"),
    ("in/twice.tar", len(FILES[1][1]), "decomposed", None, 5, 4, 4 + 8 + 2 + 3, "17 B"),
    ("dup.md", 30, "structured-text-v1", None, 0, 1, 30, "30 B"),
    ("dup.md", 40, "structured-text-v1", None, 0, 1, 40, "40 B"),
    ("late/dup.md", 50, "generic-cdc-v1", None, 0, 1, 50, "50 B"),
    (None, 120, "generic-cdc-v1", None, 0, 1, 120, "120 B"),
    ("bad.zip", 24, "opaque", "malformed at byte 24: archive ends inside a record or before its end record", 0, 1, 24, "24 B"),
    ("void.tar", 0, "generic-cdc-v1", None, 0, 0, 0, "0 B"),
]


def _book_sql() -> str:
    """Offsets are sums of 30 bytes of header, the name and the bytes of what comes before."""
    rows = values([(i, n, len(b)) for i, (n, b) in enumerate(BOOK)], "ordinal, name, size")
    return f"""SELECT form, ordinal::BIGINT AS ordinal, name, coalesce(sum(30 + length(name) + size) OVER (PARTITION BY form ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       size::BIGINT AS size, sha256(unhex(repeat('00', size))) AS digest
FROM ({rows}) m, (VALUES ('stored'), ('packed')) f(form)"""


def _rebuilt_sql() -> str:
    made = " UNION ALL ".join(f"SELECT '{p.decode()}' AS path, repeat('{b.decode()[:3] if p.startswith(b'd/') else b.decode()[:1]}', {300 if p.startswith(b'd/') else len(b)}) AS t" for k, p, b in REBUILT if k == "member")
    return f"""WITH m AS ({made})
SELECT container, path, length(t)::BIGINT AS size, sha256(t) AS digest FROM m, (VALUES ('tar'), ('zip')) c(container)
UNION ALL SELECT 'gzip', '', length(t)::BIGINT, sha256(t) FROM m WHERE path = 'd/letters.txt'"""


def _sql_containers_sql() -> str:
    rows = []
    for name in [*dict(CONTAINERS), "book"]:
        members = sum(r[0] == name for r in MEMBER_ROWS) if name != "book" else len(BOOK)
        rows.append((name, members, sum(r[0] == name for r in ENTRY_ROWS), None, {"book": len(STORED_BOOK), "office": _office_size()}.get(name), "application/zip" if name == "book" else None, None))
    rows.append(("words", 0, 0, "input is not a recognized container", None, None, "MissingSlash"))
    return values(rows, "name, members, entries, detail, canonical, essence, error")


def _office_size() -> int:
    """Headers of 30 bytes with names and bodies, descriptors of 16, directory entries of 46 with names, and an end of 22."""
    members = [(r[3], r[4]) for r in MEMBER_ROWS if r[0] == "office"]
    return sum(30 + 2 * len(n) + size + 16 + 46 for n, size in members) + 22


QUERIES = {
    f.__name__: f
    for f in (
        format_goldens, pushed_goldens, layout_cuts, malformed_details, decompose_members, decompose_containers, decompose_entries,
        decompose_opaque, broken_details, inspect_lines, corpus_files, rebuilt_containers, package_geometry, reuse_targets,
        container_kinds, expected_kinds, sql_containers,
    )
}
ORACLES = {
    "format_goldens": values([(n, p, c, d) for n, p, _, c, d in GOLDENS], "name, profile, chunks, digest"),
    "pushed_goldens": values([(n, p, c, d) for n, p, _, c, d in GOLDENS], "name, profile, chunks, digest"),
    "layout_cuts": values(_layout_rows(), 'name, ordinal, "end"'),
    "malformed_details": values([(n, p, d) for n, p, _, d in MALFORMED], "name, profile, detail"),
    "decompose_members": values(MEMBER_ROWS, "name, depth, ordinal, path, size, media_type, nested, is_text"),
    "decompose_containers": values(CONTAINER_ROWS, "name, depth, container, members, entries, office"),
    "decompose_entries": values(ENTRY_ROWS, "name, path, entry, target, mode, mtime"),
    "decompose_opaque": values([(n, d) for n, _, d in OPAQUE], "name, detail"),
    "broken_details": values([(n, "Malformed", d) for n, _, d in BROKEN], "name, reason, detail"),
    "inspect_lines": values([(n, i, x) for n, lines in LINES for i, x in enumerate(lines)], "name, line_no, line"),
    "corpus_files": values(FILE_ROWS, "path, input_bytes, route, reason, members, chunks, stored_bytes, stored"),
    "rebuilt_containers": _rebuilt_sql(),
    "package_geometry": _book_sql(),
    "container_kinds": values([(n, {"zip": "zip", "office": "zip", "tar": "tar", "targz": "gzip", "gz": "gzip", "gz_joined": "gzip", "nested": "tar", "misnamed": "tar"}.get(n)) for n in [*dict(CONTAINERS), "words", "null", "short_tar"]], "name, kind"),
    "expected_kinds": values([(n, k == "excel", None if k == "excel" else "declared Office kind's main part is missing", k) for n in ("canonical", "bytes") for k in ("word", "excel", "powerpoint")], "name, cut, error, expected"),
    "sql_containers": _sql_containers_sql(),
    "reuse_targets": values([(n, True) for n, *_ in REUSE], "name, holds"),
}
