"""Queries over media types, registries, detection and member inference, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import media_type, paths, probe
from sediment.functions.profiles import GENERIC, PROFILES
from sediment.operators import api

# Own inputs: what RFC 6838 and RFC 9110 say of names, parameters and quoted strings, and the formats' own magics.
MEDIA_TYPES = [
    ("\tAPPLICATION/Problem+JSON  ", "application/problem+json", "json", "application/problem+json"),
    ("application/atom+xml", "application/atom+xml", "xml", "application/atom+xml"),
    ("Multipart/Mixed ;b=2; A=1", "multipart/mixed", None, "multipart/mixed;a=1;b=2"),
    ("multipart/mixed;a=1;b=2", "multipart/mixed", None, "multipart/mixed;a=1;b=2"),
    ('audio/Ogg; codecs="vorbis, opus"', "audio/ogg", None, 'audio/ogg;codecs="vorbis, opus"'),
    ('model/stl;unit="mm"', "model/stl", None, "model/stl;unit=mm"),
    ('text/vcard;note="say \\"hi\\" \\\\o"', "text/vcard", None, 'text/vcard;note="say \\"hi\\" \\\\o"'),
    ('image/webp;q=""', "image/webp", None, 'image/webp;q=""'),
    ("application/java-archive", "application/java-archive", None, "application/java-archive"),
    ("video/quicktime; x=Y", "video/quicktime", None, "video/quicktime;x=Y"),
]
BAD_MEDIA_TYPES = [
    ("", "Empty", None),
    ("\t \t", "Empty", None),
    ("webp", "MissingSlash", None),
    ("webp;q=a/b", "MissingSlash", None),
    ("/webp", "InvalidTopLevel", 0),
    ("im(age/webp", "InvalidTopLevel", 2),
    ("+image/webp", "InvalidTopLevel", 0),
    ("image/", "InvalidSubtype", 6),
    ("  image/w@bp", "InvalidSubtype", 9),
    ("image/.webp", "InvalidSubtype", 6),
    ("image/we/bp", "InvalidSubtype", 8),
    ("image/" + "w" * 128, "NameTooLong", None),
    ("image/webp; ; q=1", "MalformedParameter", 12),
    ("image/webp; q", "MalformedParameter", 13),
    ("image/webp;q=", "MalformedParameter", 13),
    ("image/webp;\t=1", "MalformedParameter", 12),
    ('image/webp;q="1', "MalformedParameter", 15),
    ("image/webp;q=1 ,x", "MalformedParameter", 15),
    ("image/webp;q=1;Q=2", "DuplicateParameter", None),
    ("image/webp" + "".join(f"; k{i}=0" for i in range(17)), "TooManyParameters", None),
]
#: Two packets of a transport stream: the null packet identifier, payload only.
TS = (b"\x47\x1f\xff\x10" + bytes(184)) * 2
OOXML_HEAD = b"PK\3\4\x2d\0\0\0\0\0" + bytes(16) + b"\x13\0\0\0[Content_Types].xml"
SIGNATURES = [
    (b"PK\3\4\x2d\0\6\0", "zip-v1", "zip-v1"),
    (b"PK\5\6" + bytes(18), "zip-v1", "zip-v1"),
    (b"PK\7\10", "", ""),
    (b"\0\0\0\x18ftypheic", "isobmff-v1", "isobmff-v1"),
    (b"\0\0\0\1moov" + bytes(8), "isobmff-v1", "isobmff-v1"),
    (b"\0\0\0\7free", "", ""),
    (b"\0\0\0\x10abcd", "", ""),
    (b"\x1a\x45\xdf\xa3\1\0", "matroska-v1", "matroska-v1"),
    (TS, "mpegts-v1", "mpegts-v1"),
    (TS[:188], "mpegts-v1", "mpegts-v1"),
    (TS[:188] + b"\x46", "", ""),
    (TS[:187], "", ""),
    (b"G" + b"a" * 187, "structured-text-v1, mpegts-v1", "structured-text-v1, mpegts-v1"),
    (b"ID3\3\0\0\0\0\0\x0a", "framed-audio-v1", "framed-audio-v1"),
    (b"ID3\3\0\0\0\x80\0\x0a", "", ""),
    (b"ID3 is a tag", "structured-text-v1, framed-audio-v1", "structured-text-v1, framed-audio-v1"),
    (b"fLaC\0\0\0\x22\x10", "framed-audio-v1", "framed-audio-v1"),
    (b"fLaC\4\0\0\0", "", ""),
    (b"\xff\xe3\x18\xc4", "framed-audio-v1", "framed-audio-v1"),
    (b"\xff\xd8\xff\xe0\0\x10JFIF", "", ""),
    (b"# heading\n\nbody", "structured-text-v1", "structured-text-v1"),
    (b"col\tb\r\n1\t2\x0c", "structured-text-v1", "structured-text-v1"),
    ("Größe in €".encode(), "structured-text-v1", "structured-text-v1"),
    (("€" * 200).encode()[:512], "structured-text-v1", "structured-text-v1"),
    (("€" * 9).encode()[:26], "", ""),
    (("𝄞" * 128).encode()[:511], "", ""),
    (b"x" * 512 + b"\0", "structured-text-v1", "structured-text-v1"),
    (b"x" * 511 + b"\0", "", ""),
    (b"", "", ""),
    (b"GIF89a\1\0", "", ""),
    (b"\x1b]0;title", "", ""),
    (b"\xf5\x80\x80\x80", "", ""),
    (b"%PDF-2.0\n%\xbf\xf7\xa2\xfe\n", "", "pdf-v1"),
    (b"%PDF-1.3 words", "structured-text-v1", "structured-text-v1, pdf-v1"),
    (OOXML_HEAD, "zip-v1", "ooxml-v1"),
    (OOXML_HEAD.replace(b".xml", b".xmm"), "zip-v1", "zip-v1"),
]
MEMBERS = [
    ("letters/June.MD", b"Dear all\n", "text/markdown", None),
    ("scan.webp", b"RIFF\x10\0\0\0WEBP", "image/webp", None),
    ("LICENSE", b"\xfe\xff", None, None),
    ("lib/tool.jar", b"PK\3\4\x2d\0", "application/java-archive", "zip"),
    ("dump.sql.tar.gz", b"\x1f\x8b\x08\0", "application/gzip", "gzip"),
    ("old.TGZ", b"\x1f\x8b\x08\0", "application/gzip", "gzip"),
    ("clip.mp4", b"PK\3\4\x2d\0", None, None),
    ("photo.jpeg", b"PK\3\4\x2d\0", "image/jpeg", None),
    ("unnamed", b"PK\5\6" + bytes(18), None, "zip"),
    ("v1.2/table.CSV", b"a,b\n", "text/csv", None),
    ("song.mp3", b"just words", None, None),
    ("sheet.xlsx", OOXML_HEAD, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "zip"),
    ("notes.verylongext", b"\x80", None, None),
    ("disk.tar", b"\x80" * 20, "application/x-tar", None),
    ("paper.pdf", b"%PDF-2.0\n%\xbf\xf7", "application/pdf", None),
]


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_blob(value: bytes) -> str:
    return f"unhex('{value.hex()}')"


def values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else sql_text(v) if isinstance(v, str) else sql_blob(v) if isinstance(v, bytes) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


TEXTS = "text/plain text/markdown text/html text/css text/csv text/tab-separated-values text/xml text/calendar text/vcard text/javascript text/turtle text/n3 application/json application/ld+json application/xml application/xhtml+xml application/rdf+xml application/n-triples application/n-quads application/trig application/sparql-query application/sparql-update application/sparql-results+json application/sparql-results+xml application/yaml application/toml application/javascript image/svg+xml"
PLAIN_ZIPS = "application/zip application/java-archive application/epub+zip application/vnd.oasis.opendocument.text application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.presentation"
PACKAGES = "application/vnd.openxmlformats-officedocument.wordprocessingml.document application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.presentationml.presentation"
COMMON = [("structured-text-v1", 2, TEXTS), ("zip-v1", 3, PLAIN_ZIPS), ("isobmff-v1", 4, "video/mp4 audio/mp4 application/mp4 video/quicktime image/heif image/heic image/avif"), ("matroska-v1", 5, "video/x-matroska audio/x-matroska video/webm audio/webm"), ("mpegts-v1", 6, "video/mp2t"), ("framed-audio-v1", 7, "audio/mpeg audio/aac audio/flac")]


def registry_sql(version: int, lists: list[tuple[str, int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {version} AS registry_version, unnest(string_split('{essences}', ' ')) AS essence, '{profile}' AS profile, {i} AS profile_id" for profile, i, essences in lists)


REGISTRY_1 = registry_sql(1, [*COMMON, ("zip-v1", 3, PACKAGES)])
REGISTRY_2 = registry_sql(2, [*COMMON, ("ooxml-v1", 8, PACKAGES), ("pdf-v1", 10, "application/pdf")])


def registry_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_type.registry_table(spark, 1)


def registry_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_type.registry_table(spark, 2)


def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essences whose profile differs between the registries."""
    a = media_type.registry_table(spark, 1).select("essence", F.col("profile").alias("v1"))
    b = media_type.registry_table(spark, 2).select("essence", F.col("profile").alias("v2"))
    both = a.join(b, "essence", "full").select("essence", *[F.coalesce(c, F.lit(GENERIC)).alias(c) for c in ("v1", "v2")])
    return both.where("v1 <> v2")


def profile_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_type.profile_table(spark)


def _parsed(spark: SparkSession, inputs: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in inputs], "input string").withColumn("m", media_type.parse_media_type("input"))


def media_type_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, [r[0] for r in MEDIA_TYPES]).select("input", "m.essence", "m.suffix", "m.canonical")


def media_type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, [r[0] for r in BAD_MEDIA_TYPES]).select("input", "m.error", F.coalesce("m.offset", F.lit(-1)).cast("int").alias("offset"))


def select_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's choice by Columns for well-formed declarations."""
    inputs = spark.createDataFrame([(r[0],) for r in MEDIA_TYPES], "input string")
    essence = media_type.essence_of(F.col("input"))
    return inputs.select("input", media_type.profile_of_essence(essence, 1).alias("v1"), media_type.profile_of_essence(essence, 2).alias("v2"), media_type.specialist_of_essence(essence).alias("specialist"))


_LISTED = {"application/java-archive": "zip-v1", "text/vcard": "structured-text-v1", "video/quicktime": "isobmff-v1"}
SELECTED = [(r[0], *((_LISTED.get(r[1], "generic-cdc-v1"),) * 2), _LISTED.get(r[1])) for r in MEDIA_TYPES]


def detect_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, bytearray(r[0])) for i, r in enumerate(SIGNATURES)], "i int, prefix binary")
    return rows.select("i", F.array_join(probe.detected(F.col("prefix"), 1), ", ").alias("v1"), F.array_join(probe.detected(F.col("prefix"), 2), ", ").alias("v2"))


def _detect(df: DataFrame, key: str, text: str) -> DataFrame:
    found = probe.detected(F.encode(F.col(text), "UTF-8"))
    return df.select(key, F.array_join(found, ", ").alias("detected"), probe.state_of(found).alias("state"), probe.resolved(found).alias("profile"))


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def checked_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of documents under three declarations, where their first bytes let it stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.col("text"), "UTF-8").alias("content"))
    return docs.select("doc_id", *[api.by_checked_declaration(F.lit(t), F.col("content")).alias(n) for n, t in DECLARED.items()])


DECLARED = {"as_text": "Text/Markdown; charset=utf-8", "as_pdf": "application/pdf", "as_other": "application/x-own"}


def _detect_sql(table: str, key: str, text: str) -> str:
    return rf"""
WITH p AS (SELECT {key}, hex(encode({text})[1:512]) AS h FROM {table}),
m AS (
  SELECT {key}, list_filter([
    CASE WHEN h <> '' AND NOT regexp_matches(h, '^(?:..)*(?:0[0-8BEF]|1.)') THEN 'structured-text-v1' END,
    CASE WHEN h[1:2] = '47' AND (length(h) = 376 OR h[377:378] = '47') THEN 'mpegts-v1' END,
    CASE WHEN h[1:6] = '494433' AND length(h) >= 20 AND NOT regexp_matches(h[13:20], '^(?:..)*[89A-F]') THEN 'framed-audio-v1' END,
    CASE WHEN h[1:10] = '255044462D' THEN 'pdf-v1' END], lambda x: x IS NOT NULL) AS f
  FROM p)
SELECT {key}, array_to_string(f, ', ') AS detected,
       CASE len(f) WHEN 0 THEN 'unrecognized' WHEN 1 THEN 'recognized' ELSE 'ambiguous' END AS state,
       CASE len(f) WHEN 0 THEN 'generic-cdc-v1' WHEN 1 THEN f[1] END AS profile
FROM m"""


DETECTIONS = ["", "zip-v1", "ooxml-v1", "structured-text-v1,framed-audio-v1", "pdf-v1"]


def reconcile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile declared against five detections."""
    found = spark.createDataFrame([(d, [x for x in d.split(",") if x]) for d in DETECTIONS], "detected string, f array<string>")
    declared = F.explode(F.array(*map(F.lit, PROFILES)))
    crossed = found.withColumn("declared", declared)
    return crossed.select("detected", "declared", probe.reconciled(F.col("f"), F.col("declared")).isNotNull().alias("ok"))


RECONCILE_SQL = f"""
SELECT detected, declared,
       declared = 'generic-cdc-v1' OR detected = '' OR list_contains(string_split(detected, ','), declared)
       OR (detected = 'ooxml-v1' AND declared IN ('ooxml-ber-v1', 'zip-v1')) AS ok
FROM (VALUES {", ".join(f"('{d}')" for d in DETECTIONS)}) a(detected),
     (VALUES ('generic-cdc-v1'), ('structured-text-v1'), ('zip-v1'), ('isobmff-v1'), ('matroska-v1'), ('mpegts-v1'),
             ('framed-audio-v1'), ('ooxml-v1'), ('ooxml-ber-v1'), ('pdf-v1')) b(declared)"""


def member_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r[0], bytearray(r[1])) for r in MEMBERS], "path string, prefix binary")
    return rows.withColumn("m", paths.member_type(F.col("path"), F.col("prefix"))).select("path", "m.media_type", "m.container")


# What each path is: extension, media type by name, wrapped tar, safe, XML part, Office kind.
PATHS = [
    ("letters/June.Md", "md", "text/markdown", False, True, False, None),
    ("dump.sql.TAR.gz", "gz", "application/gzip", True, True, False, None),
    ("old.tgz", "tgz", "application/gzip", True, True, False, None),
    ("v1.2/table", None, None, False, True, False, None),
    ("ends.", None, None, False, True, False, None),
    ("notes.verylongx", None, None, False, True, False, None),
    ("/srv/all.csv", "csv", "text/csv", False, False, False, None),
    ("\\\\host\\a.gif", "gif", "image/gif", False, False, False, None),
    ("up/../and.toml", "toml", "application/toml", False, False, False, None),
    ("up/..and/on.dat", "dat", None, False, True, False, None),
    ("word/document.xml", "xml", "application/xml", False, True, True, "word"),
    ("xl/workbook.xml", "xml", "application/xml", False, True, True, "excel"),
    ("ppt/presentation.xml", "xml", "application/xml", False, True, True, "powerpoint"),
    ("_rels/.RELS", "rels", None, False, True, True, None),
]


def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r[0],) for r in PATHS], "path string")
    p = F.col("path")
    return rows.select("path", paths.extension(p).alias("extension"), paths.media_type_of_name(p).alias("media_type"), paths.is_wrapped_tar(p).alias("wrapped_tar"), paths.is_safe(p).alias("safe"), paths.is_xml_part(p).alias("xml_part"), paths.office_kind(p).alias("office"))


def detected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, the union of what its documents show."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = probe.detected(F.encode(F.col("text"), "UTF-8"))
    union = docs.groupBy("lang").agg(F.bit_or(paths.set_bits(found)).alias("bits"))
    return union.select("lang", F.array_join(paths.set_names(F.col("bits")), ", ").alias("profiles"))


QUERIES = {f.__name__: f for f in (registry_v1, registry_v2, registry_diff, profile_dim, media_type_parse, media_type_errors, select_profiles, detect_signatures, detect_documents, detect_pages, reconcile_matrix, member_inference, path_predicates, detected_sets, checked_declarations)}
ORACLES = {
    "registry_v1": REGISTRY_1,
    "registry_v2": REGISTRY_2,
    "registry_diff": f"SELECT coalesce(a.essence, b.essence) AS essence, coalesce(a.profile, 'generic-cdc-v1') AS v1, coalesce(b.profile, 'generic-cdc-v1') AS v2 FROM ({REGISTRY_1}) a FULL JOIN ({REGISTRY_2}) b ON a.essence = b.essence WHERE coalesce(a.profile, 'generic-cdc-v1') <> coalesce(b.profile, 'generic-cdc-v1')",
    "profile_dim": values([(1, "generic-cdc-v1", True), (2, "structured-text-v1", True), (3, "zip-v1", True), (4, "isobmff-v1", True), (5, "matroska-v1", True), (6, "mpegts-v1", True), (7, "framed-audio-v1", True), (8, "ooxml-v1", True), (9, "ooxml-ber-v1", True), (10, "pdf-v1", True)], "profile_id, profile, implemented"),
    "media_type_parse": values(MEDIA_TYPES, "input, essence, suffix, canonical"),
    "media_type_errors": values([(a, b, -1 if c is None else c) for a, b, c in BAD_MEDIA_TYPES], "input, error, \"offset\""),
    "select_profiles": values(SELECTED, "input, v1, v2, specialist"),
    "detect_signatures": values([(i, r[1], r[2]) for i, r in enumerate(SIGNATURES)], "i, v1, v2"),
    "detect_documents": _detect_sql("documents", "doc_id", "text"),
    "detect_pages": _detect_sql("pages", "page_id", "html"),
    "reconcile_matrix": RECONCILE_SQL,
    "checked_declarations": f"""SELECT doc_id, CASE WHEN detected = '' OR detected LIKE '%structured-text-v1%' THEN 'structured-text-v1' END AS as_text,
       CASE WHEN detected = '' OR detected LIKE '%pdf-v1%' THEN 'pdf-v1' END AS as_pdf, 'generic-cdc-v1' AS as_other FROM ({_detect_sql("documents", "doc_id", "text")})""",
    "path_predicates": values(PATHS, "path, extension, media_type, wrapped_tar, safe, xml_part, office"),
    "detected_sets": f"""SELECT lang, concat_ws(', ', CASE WHEN bool_or(detected LIKE '%text%') THEN 'structured-text-v1' END, CASE WHEN bool_or(detected LIKE '%mpegts%') THEN 'mpegts-v1' END,
       CASE WHEN bool_or(detected LIKE '%audio%') THEN 'framed-audio-v1' END, CASE WHEN bool_or(detected LIKE '%pdf%') THEN 'pdf-v1' END) AS profiles
FROM ({_detect_sql("documents", "doc_id", "text")}) JOIN documents USING (doc_id) GROUP BY lang""",
    "member_inference": values([(r[0], r[2], r[3]) for r in MEMBERS], "path, media_type, container"),
}
