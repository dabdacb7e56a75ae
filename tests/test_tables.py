"""Chunk, member and report tables; streams in windows; files in ranges; SQL."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import sql
from sediment.functions.profiles import GENERIC, TEXT, Rejected
from sediment.operators import analysis, api, writers
from sediment.operators.chunkers import boundaries
from sediment.operators.content import check_utf8
from sediment.plans import catalogue
from sediment.plans import synthetic as s
from sediment.sources import files
from sediment.streaming.feed import Feed, chunk_windows, windows_of
from sediment.streaming.joined import Joined, chunk_joined, sketched

PACKAGE = s.docx(s.xml("t", 30_000), s.noise("t", 50_000))
VALUES = [(1, "a.bin", s.noise("t", 200_000), "application/x-unknown"), (2, "b.md", s.markdown("t", 200_000), "text/markdown"), (3, "c.docx", PACKAGE, None), (4, "d.txt", b"words \xff broken", "text/plain"), (5, "e", b"", "video/mp4"), (6, "f", None, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, p, None if c is None else bytearray(c), d) for i, p, c, d in VALUES], "id long, path string, content binary, declared string").cache()


def test_chunks_by_declaration(table):
    rows = api.chunk(table, api.by_declaration(F.col("declared")), keep=("id",)).collect()
    assert [r["end"] for r in rows if r["id"] == 1] == boundaries(GENERIC, VALUES[0][2])
    assert [r["end"] for r in rows if r["id"] == 2] == boundaries(TEXT, VALUES[1][2])
    assert {r["error"] for r in rows if r["id"] == 4} == {"invalid UTF-8 lead byte"}
    assert {r["route"] for r in rows if r["id"] in (4, 5, 6)} == {"rejected"}


def test_refused_values_go_generic_when_asked(table):
    rows = api.chunk(table.where("id = 4"), api.by_profile(TEXT), on_reject="generic", with_data=True).collect()
    assert [(r["route"], r["profile"], bytes(r["data"])) for r in rows] == [("opaque", GENERIC, VALUES[3][2])]


def test_checked_declaration_and_detection(table):
    rows = {r["id"]: r for r in table.select("id", api.by_checked_declaration(F.lit("video/x-matroska"), F.col("content")).alias("d"), api.by_detection(F.col("content")).alias("p")).collect()}
    assert (rows[2]["d"], rows[1]["d"]) == (None, "matroska-v1")
    assert (rows[2]["p"], rows[3]["p"], rows[1]["p"], rows[5]["p"]) == (TEXT, "ooxml-v1", GENERIC, GENERIC)


def test_package_members_stand_where_they_say(table):
    from sediment.operators.office import canonical

    rows = api.package_members(table, keep=("id",)).collect()
    form = canonical(PACKAGE).data
    assert len(rows) == 5 and {r["id"] for r in rows} == {3}
    for r in rows:
        assert form[r["offset"] + 30 : r["offset"] + 30 + len(r["name"])] == bytes(r["name"])


def test_members_are_told_by_one_profile_only(table):
    with pytest.raises(ValueError):
        api.package_members(table, profile="zip-v1")


def test_report(table):
    rows = {r["path"]: r for r in analysis.corpus_report(table.where("content is not null")).collect()}
    assert (rows["c.docx"]["route"], rows["c.docx"]["members"]) == ("decomposed", 5)
    assert (rows["b.md"]["route"], rows["d.txt"]["route"], rows["e"]["chunks"]) == (TEXT, "opaque", 0)
    assert rows["a.bin"]["stored"] == "195.3 KiB"


def test_inspect_lines(table):
    found = api.events(table.where("id = 3"), keep=("id",))
    lines = [r["line"] for r in analysis.inspect(found).orderBy("seq").collect()]
    assert lines[0] == "[zip]" and lines[-1] == "= 5 members, 0 entries"


def test_reuse(spark):
    a, b = s.noise("r", 400_000), s.noise("q", 5000) + s.noise("r", 400_000)
    chunks = api.chunk(spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b))], "name string, content binary"), api.by_profile(GENERIC), keep=("name",)).cache()
    base, other = chunks.where("name = 'a'"), chunks.where("name = 'b'")
    hit, new = analysis.shared(base, other).first(), analysis.new_chunks(base, other)
    total = other.agg(F.sum("length")).first()[0]
    assert hit["shared_bytes"] + new.agg(F.sum("length")).first()[0] == total and hit["shared_bytes"] > 250_000
    pair = analysis.shared_pairs(chunks, "name").where("base = 'a'").first()
    assert pair["percent"] == pytest.approx(100 * hit["shared_bytes"] / total)


def test_rows_of_many_values_come_in_one_batch(spark):
    from sediment.operators.api import tabled

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"ab", b"", b"c"])], names=["k", "v"])
    out = list(tabled(iter([batch]), 1, [("x", pa.int64())], lambda v: [(b,) for b in v]))
    assert [b.to_pydict() for b in out] == [{"k": [1, 1, 3], "x": [97, 98, 99]}]


def test_sizes_for_people(spark):
    sizes = [0, 1023, 1024, 1280, 1382, 1 << 20, (1 << 20) + (1 << 18)]
    rows = spark.createDataFrame([(x,) for x in sizes], "n long").select(analysis.human(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.3 KiB", "1.0 MiB", "1.2 MiB"]


@pytest.mark.parametrize("profile", [GENERIC, TEXT, "ooxml-v1"])
@pytest.mark.parametrize("size", [997, 40_000])
def test_windows_give_the_same_chunks(table, profile, size):
    data = {GENERIC: 1, TEXT: 2, "ooxml-v1": 3}[profile]
    some = table.where(F.col("id") == data)
    rows = chunk_windows(windows_of(some, "id", "content", size), profile).orderBy("ordinal").collect()
    assert [r["end"] for r in rows] == boundaries(profile, VALUES[data - 1][2])


@pytest.mark.parametrize("profile", [GENERIC, "zip-v1", "pdf-v1"])
def test_structured_streaming(spark, tmp_path, profile):
    data = {GENERIC: lambda: s.noise("stream", 600_000), "zip-v1": lambda: s.zip_archive([("a", s.noise("z", 250_000), False, "plain"), ("b.txt", s.prose("z", 300_000), True, "signed")]), "pdf-v1": lambda: s.pdf(s.prose("t", 60_000), s.noise("i", 450_000))}[profile]()
    feed = windows_of(spark.createDataFrame([(7, bytearray(data))], "id long, content binary"), "id", "content", 100_000)
    for k in range(6):
        feed.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunk_windows(source, profile).writeStream.format("memory").queryName("fed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["end"] for r in spark.table("fed").orderBy("ordinal").collect()] == boundaries(profile, data)


def test_windows_out_of_turn_wait_and_repeats_are_passed_over(spark):
    data = s.noise("turn", 300_000)
    cut = [(5, k, bytearray(data[k * 50_000 : (k + 1) * 50_000]), k == 5) for k in range(6)]
    schema = "stream_id long, seq long, window binary, is_last boolean"
    feed = Feed(GENERIC, 5)
    rows = [r for k in (1, 0, 0, 3, 2, 5, 1, 4) for r in feed.take(k, cut[k][2], cut[k][3])]
    assert [r[4] for r in rows] == boundaries(GENERIC, data) and feed.over and not feed.ended()
    got = chunk_windows(spark.createDataFrame([cut[k] for k in (4, 1, 1, 0, 5, 2, 3)], schema), GENERIC).orderBy("ordinal").collect()
    assert [r["end"] for r in got] == boundaries(GENERIC, data) and got[-1]["pushed"] == 6
    lacking = chunk_windows(spark.createDataFrame([cut[k] for k in (0, 1, 3)], schema), GENERIC).where("error is not null").collect()
    assert [r["error"] for r in lacking] == ["window 2 is missing"]


def test_the_first_bytes_choose_and_are_not_lost(spark):
    data = {1: s.zip_archive([("a", s.noise("d", 90_000), False, "plain")]), 2: s.markdown("d", 90_000), 3: b"ID3 is a tag " * 100, 4: b"\x80" * 300, 5: b""}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "id long, content binary")
    rows = chunk_windows(windows_of(table, "id", "content", 100), None).collect()
    told = {k: {r["profile"] for r in rows if r["stream_id"] == k} for k in data}
    assert told == {1: {"zip-v1"}, 2: {TEXT}, 3: {None}, 4: {GENERIC}, 5: set()}
    for k in (1, 2, 4):
        assert sorted(r["end"] for r in rows if r["stream_id"] == k) == boundaries(*told[k], data[k])
    first = min((r["pushed"], r["error"]) for r in rows if r["stream_id"] == 3)
    assert first == (6, f"byte prefix matches several chunking profiles ({TEXT}, framed-audio-v1); declare a media type")
    said = chunk_windows(windows_of(table.where("id < 3"), "id", "content", 4000), "zip-v1", checked=True).orderBy("pushed").collect()
    assert [r["end"] for r in said if r["stream_id"] == 1] == boundaries("zip-v1", data[1])
    assert next(r["error"] for r in said if r["stream_id"] == 2) == f"declared chunking profile zip-v1 but the byte prefix is recognized as {TEXT}"


def test_a_refused_stream_says_so_at_every_window(spark):
    rows = [(1, k, bytearray(b"abc \xff" if k == 1 else b"words "), k == 3) for k in range(4)]
    out = chunk_windows(spark.createDataFrame(rows, "stream_id long, seq long, window binary, is_last boolean"), TEXT).orderBy("pushed").collect()
    assert [r["error"] for r in out] == ["invalid UTF-8 lead byte"] + [f"chunking profile {TEXT} already rejected this stream"] * 2


def test_files_in_ranges(spark, tmp_path):
    data = {"x": s.noise("x", 900_000), "y": s.noise("y", 20_000), "z": b""}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    rows = files.generic_ranges(spark, str(tmp_path), 100_000).collect()
    for name, body in data.items():
        assert sorted(r["end"] for r in rows if os.path.basename(r["path"]) == name) == boundaries(GENERIC, body)
    whole = files.read_files(spark, str(tmp_path), in_order=True)
    assert files.prefixes(whole).select(F.max(F.octet_length("content"))).first()[0] == 512
    assert [os.path.basename(r["path"]) for r in whole.select("path").collect()] == ["x", "y"]  # Spark leaves empty files out


def test_text_files_in_ranges(spark, tmp_path):
    data = {"a.md": s.markdown("ranges", 700_000), "wide": ("日本😀é" * 70_000).encode(), "bad": s.markdown("bad", 90_000) + b"\xe6\x97" + s.markdown("bad", 90_000), "cut": b"words " * 9000 + b"\xe6", "low": b"x" * 40_000 + b"\x80"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    for size in (10_007, 64_000):
        rows = files.file_ranges(spark, str(tmp_path), size, TEXT).collect()
        for name, body in data.items():
            own = [r for r in rows if os.path.basename(r["path"]) == name]
            try:
                assert sorted(r["end"] for r in own) == boundaries(TEXT, body)
            except Rejected as e:
                assert [r["error"] for r in own] == [e.detail]
    with pytest.raises(ValueError):
        files.file_ranges(spark, str(tmp_path), profile="zip-v1")


def test_faults_of_ranges_are_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytearray(("aé日😀" * 4)[: rng.randint(1, 14)].encode())
        for _ in range(rng.randint(0, 2)):
            data[rng.randrange(len(data))] = rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE6, 0xF0, 0xFF])
        data, step = bytes(data), rng.randint(4, 9)
        found = []
        for a in range(0, len(data), step):
            b, lead = min(a + step, len(data)), min(files.LEAD, a)
            fault = files.range_fault(data[a - lead : b + 3], lead, a, b, len(data))
            found += [fault] if fault else []
        try:
            check_utf8(data)
            assert not found, data
        except Rejected as e:
            assert found and (found[0].detail, found[0].offset) == (e.detail, e.offset), (data, step)


def test_files_in_windows(spark, tmp_path):
    data = {"a.zip": s.zip_archive([("a", s.noise("w", 500_000), False, "plain"), ("b", s.prose("w", 90_000), True, "signed")]), "empty.zip": b"", "b.zip": s.zip_archive([("c", b"x", False, "plain")])}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    rows = chunk_windows(files.read_windows(spark, str(tmp_path), 50_000), "zip-v1").collect()
    for name in ("a.zip", "b.zip"):
        assert sorted(r["end"] for r in rows if r["stream_id"].endswith("/" + name)) == boundaries("zip-v1", data[name])
    assert [r["error"] for r in rows if r["stream_id"].endswith("empty.zip")] == ["archive ends inside a record or before its end record"]


def test_containers_are_rebuilt_in_pieces(spark):
    entries = [("directory", b"d", b""), ("member", b"d/a", b"words"), ("symlink", b"l", b"d/a"), ("member", b"n" * 150, b"y" * 5000)]
    rows = [(c, i, k, bytearray(p), bytearray(b)) for c in ("one", "two") for i, (k, p, b) in enumerate(entries)]
    table = spark.createDataFrame(rows, "container string, ordinal long, kind string, path binary, content binary")
    for kind, want in (("tar", writers.tar(entries)), ("zip", writers.zip_(entries)), ("gzip", writers.gzip(b"".join(b for _, _, b in entries)))):
        made = writers.containers(table, kind).orderBy("container", "seq").collect()
        assert {c: b"".join(bytes(r["data"]) for r in made if r["container"] == c) for c in ("one", "two")} == {"one": want, "two": want}


def test_sql_functions(spark, table):
    sql.register(spark)
    table.createOrReplaceTempView("blobs")
    assert spark.sql("SELECT size(cdc_boundaries(content, 'generic-cdc-v1').ends) AS n FROM blobs WHERE id = 1").first()["n"] == len(boundaries(GENERIC, VALUES[0][2]))
    assert spark.sql("SELECT cdc_media_type(declared).essence AS e FROM blobs WHERE id = 2").first()["e"] == "text/markdown"
    assert spark.sql("SELECT cdc_detect(content) AS d FROM blobs WHERE id = 3").first()["d"] == ["ooxml-v1"]
    assert spark.sql("SELECT count(*) AS n FROM blobs, LATERAL cdc_decompose(content) e WHERE blobs.id = 3 AND e.kind = 'member_end'").first()["n"] == 5
    ends = spark.sql("SELECT e.end FROM blobs, LATERAL cdc_chunks(content, 'structured-text-v1') e WHERE blobs.id = 2 ORDER BY 1").collect()
    assert [r[0] for r in ends] == boundaries(TEXT, VALUES[1][2])
    assert spark.sql("SELECT count(cdc_canonical_ooxml(content)) AS n FROM blobs").first()["n"] == 1


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def odd_texts(seed):
    """Short, empty and long texts; runs without a seam, of one byte and of several to a character."""
    rng = random.Random(seed)
    prose = s.prose(f"j{seed}", 400_000).decode()
    some = [prose[a : a + n] for a, n in ((rng.randrange(300_000), rng.choice([0, 1, 5, 62, 63, 64, 125, 126, 127, 128, 900, 30_000])) for _ in range(120))]
    runs = ["\u65e5" * 200_001, "x" * 300_000, "\U0001f600e" * 70_001, "x\u00e9" * 30_000, "\u00e9"] * (seed % 2 + 1)
    out = some + runs + [""] * 5 + ["\u00e9"] * 70
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("profile", [GENERIC, TEXT])
@pytest.mark.parametrize("seed", range(3))
def test_joined_streams_in_any_split(profile, seed):
    import pyarrow as pa

    texts = [t.encode() for t in odd_texts(seed)]
    data, rng = b"\n".join(texts), random.Random(seed)
    stream, found, pieces = Joined("a", profile), [], Joined("a", profile)
    bodies, at = {}, 0
    while at < len(texts):
        n = rng.choice([1, 2, 3, 50])
        part = texts[at : at + n]
        ids = pa.array(range(at, at + len(part)), pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, ids, *sketched(part, profile)], names=["file", "row", "n", "edge", "strict", "relaxed", "inner"])
        at += n
        for one in (stream, pieces):
            one.take(batch)
        found += stream.chosen(False, False)
        for _, a, b, _, _, led, skip, take, _, row in pieces.chosen(False, True) + (pieces.chosen(True, True) if at >= len(texts) else []):
            bodies[a, b] = bodies.get((a, b), b"") + ((b"\n" if led else b"") + texts[row])[skip : skip + take]
    found += stream.chosen(True, False)
    ends = boundaries(profile, data)
    assert [r[2] for r in found] == ends and [r[0] for r in found] == list(range(len(ends)))
    assert [*bodies.items()] == [((a, b), data[a:b]) for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("profile", [GENERIC, TEXT])
@pytest.mark.parametrize("keep_first", [True, False])
def test_joined_streams_of_a_table(spark, profile, keep_first):
    rows = [(i, n, t) for n, seed in (("a", 4), ("b", 5), (None, 6)) for i, t in enumerate(odd_texts(seed))]
    rows += [(None, "a", "no id"), (7, "c", ""), (8, "c", None), (1, "d", ""), (None, "e", "lone")]
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id long, name string, text string, row long").withColumn("file", F.lit(0).cast("long")).repartition(5)
    want = {}
    for n in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == n), key=lambda r: (r[0] is None, r[0] or 0))
        mine = mine if keep_first else [r for r in mine if r[0] is not None and r[0] != mine[0][0]]
        data = b"\n".join((r[2] or "").encode() for r in mine)
        ends = boundaries(profile, data)
        want |= {(n, k): (a, b, b - a, hashlib.sha256(data[a:b]).hexdigest()) for k, (a, b) in enumerate(zip([0, *ends], ends))}
    cut = lambda digest: chunk_joined(table, "name", "id", F.encode("text", "UTF-8"), profile, digest, keep_first).collect()
    assert {(r["stream_id"], r["ordinal"]): (r["start"], r["end"], r["length"], r["digest"]) for r in cut(True)} == want
    assert {(r["stream_id"], r["ordinal"]): (r["start"], r["end"], r["length"]) for r in cut(False)} == {k: v[:3] for k, v in want.items()}


@pytest.mark.parametrize("name", ["text_boundaries_lang", "chunk_stats", "chunk_histogram", "chunk_digests", "generic_boundaries_source", "dedup_pairs"])
def test_no_task_holds_a_stream(spark, tmp_path, name):
    """No window takes the texts, and what is dealt by stream is one short row a text."""
    spark.createDataFrame([(i, "en", "a", "words and words " * 20) for i in range(9)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "RepartitionByExpression [stream_id" in line and "ordinal" not in line]
    assert dealt and all("MapInArrow sketches" in lines[i + 1] for i in dealt) and not any("Window " in line for line in lines)
