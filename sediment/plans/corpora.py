"""Queries that cut the test tables: documents one by one, and each language's or source's texts as one stream.

A stream's documents are hashed where they lie; its cuts are chosen in order of doc_id from a short row a document,
and chunks are hashed apart (streaming.joined). No task holds a stream, whatever its size.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.functions import sql
from sediment.functions.gear import table
from sediment.functions.profiles import GENERIC, TEXT
from sediment.operators import analysis, api
from sediment.plans.routing import _detect_sql
from sediment.streaming.feed import chunk_windows, windows_of
from sediment.streaming.joined import chunk_joined


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _stream_chunks(spark: SparkSession, sf_dir: str, by: str, profile: str, digest: bool = False, keep_first: bool = True) -> DataFrame:
    """The chunks of each value of `by`: its texts in order of doc_id, joined by line ends; without keep_first the first document is left out."""
    place = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", by, "text", *place)
    return chunk_joined(docs, by, "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8"), profile, digest, keep_first).withColumnRenamed("stream_id", "name")


def _lang_chunks(spark: SparkSession, sf_dir: str, digest: bool = False) -> DataFrame:
    return _stream_chunks(spark, sf_dir, "lang", TEXT, digest)


def generic_boundaries_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.chunk(_documents(spark, sf_dir), api.by_profile(GENERIC), keep=("doc_id",), digest=None)
    return out.select("doc_id", "ordinal", "start", "end")


def generic_boundaries_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_chunks(spark, sf_dir, "source", GENERIC).select("name", "ordinal", "start", "end")


def text_boundaries_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lang_chunks(spark, sf_dir).select("name", "ordinal", "start", "end")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.stats(_lang_chunks(spark, sf_dir), "name")


def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(_lang_chunks(spark, sf_dir))


def chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lang_chunks(spark, sf_dir, digest=True).select("name", "ordinal", "digest")


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return api.chunk(docs, api.by_profile(GENERIC), keep=("source",)).where("digest is not null")


def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what each source's document chunks share with each other source's."""
    return analysis.shared_pairs(_doc_chunks(spark, sf_dir), "source").select("base", "other", "shared_chunks", "shared_bytes", "total_bytes", F.round("percent", 9).alias("percent"))


def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source's stream still shares with itself when its first document is gone: cuts fall into step again behind it."""
    keyed = lambda df: df.where("digest is not null").select(F.col("name").alias("source"), "digest", "length")
    base, other = keyed(_stream_chunks(spark, sf_dir, "source", GENERIC, digest=True)), keyed(_stream_chunks(spark, sf_dir, "source", GENERIC, digest=True, keep_first=False))
    known = base.select(F.col("source").alias("s"), F.col("digest").alias("d")).distinct()
    hit = other.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("d")), "left")
    shared = F.col("d").isNotNull()
    out = hit.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(shared).alias("shared_chunks"), F.sum("length").alias("total_bytes"), F.coalesce(F.sum(F.when(shared, F.col("length"))), F.lit(0)).alias("shared_bytes"))
    return out.withColumn("percent", F.round(analysis.ratio(F.col("shared_bytes"), F.col("total_bytes")), 9))


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, the document chunks that the first source in order doesn't have."""
    chunks = _doc_chunks(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.min("source").alias("first"))
    marked = chunks.join(first, chunks["source"] == first["first"], "left")
    base, rest = marked.where("first is not null"), marked.where("first is null")
    return analysis.new_chunks(base, rest).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal bytes: their digest, count and least id."""
    docs = _documents(spark, sf_dir)
    return docs.groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: size, route, chunks and stored bytes."""
    docs = _documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "content")
    return analysis.corpus_report(docs).select("path", "input_bytes", "route", "members", "chunks", "stored_bytes", "stored")


def streaming_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fed in windows of 256 bytes: each chunk, and how many windows were pushed when the last of a document was certain."""
    out = chunk_windows(windows_of(_documents(spark, sf_dir), "doc_id", "content", 256), GENERIC)
    return out.select(F.col("stream_id").alias("doc_id"), "ordinal", "start", "end", F.max("pushed").over(W.partitionBy("stream_id")).alias("pushed"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, cuts and chunk rows of the documents, asked for in SQL."""
    sql.register(spark)
    return spark.sql(
        """
        SELECT d.doc_id, array_join(cdc_detect(d.content), ', ') AS detected, size(cdc_boundaries(d.content, 'generic-cdc-v1').ends) AS ends,
               count(c.ordinal) AS chunks, coalesce(sum(c.length), 0) AS bytes, count_if(sha2(c.data, 256) = sha2(substring(d.content, c.start + 1, c.length), 256)) AS equal
        FROM {docs} d, LATERAL cdc_chunks(d.content, 'generic-cdc-v1') c
        GROUP BY d.doc_id, d.content""",
        docs=_documents(spark, sf_dir).where(F.octet_length("content") > 0),
    )


# ---------------------------------------------------------------- SQL


@lru_cache(maxsize=None)
def _gear_sql(profile: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{b:02X}', {int(v)}::UBIGINT)" for b, v in enumerate(table(profile))) + ") g(byte, v)"


def _greedy_sql(key: str) -> str:
    """Chunks from candidates cand(key, e, strict) over streams s(key, n): starts follow from ends, one after the other."""
    return f"""
picked({key}, ordinal, "start", "end") AS (
  SELECT {key}, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM s WHERE n > 0
  UNION ALL
  SELECT p.{key}, p.ordinal + 1, p."end",
    least(s.n, coalesce(
      (SELECT min(e) FROM cand c WHERE c.{key} = p.{key} AND c.strict AND c.e BETWEEN p."end" + 16384 AND p."end" + 65535),
      (SELECT min(e) FROM cand c WHERE c.{key} = p.{key} AND c.relaxed AND c.e BETWEEN p."end" + 65536 AND p."end" + 262143),
      p."end" + 262144))
  FROM picked p JOIN s ON s.{key} = p.{key} WHERE p."end" < s.n),
chunks AS (SELECT {key}, ordinal, "start", "end" FROM picked WHERE ordinal >= 0)"""


# documents of 16 KiB or less are one chunk; of the others the low 18 bits of the hash need 18 bytes
GENERIC_DOCS = f"""
WITH RECURSIVE g AS ({_gear_sql(GENERIC)}),
s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, unnest(range(1, n + 1)) AS p, unnest(regexp_extract_all(h, '..')) AS byte FROM s WHERE n > 16384),
low AS (SELECT doc_id, p, v & 262143 AS v FROM bytes JOIN g USING (byte)),
hashed AS (
  SELECT doc_id, p, sum(t) AS t FROM (SELECT doc_id, p + k AS p, (v << k) & 262143 AS t FROM low, (SELECT unnest(range(0, 18)) AS k)) GROUP BY doc_id, p),
cand AS (SELECT doc_id, p AS e, t % 262144 = 0 AS strict, t % 16384 = 0 AS relaxed FROM hashed WHERE t % 16384 = 0),
{_greedy_sql("doc_id")}"""

def _doubling_sql(steps: int) -> str:
    """H_2m(p) = H_m(p) + 2^m H_m(p - m), one window pass a step."""
    out = []
    for k in range(steps):
        m = 1 << k
        prior = f"lag(v, {m}) OVER (PARTITION BY name ORDER BY p)"
        out.append(f"h{k + 1} AS (SELECT name, p, byte, ((v::HUGEINT + coalesce((({prior}) & {(1 << (64 - m)) - 1}::UBIGINT)::HUGEINT * {1 << m}::HUGEINT, 0)) % 18446744073709551616)::UBIGINT AS v FROM h{k})")
    return ",\n".join(out)


# only positions at seams are judged, by the top 10 or 11 of 64 bits
def _text_sql(streams: str) -> str:
    return f"""
WITH RECURSIVE g AS ({_gear_sql(TEXT)}),
s AS (SELECT name, t, octet_length(encode(t)) AS n, hex(encode(t)) AS h FROM ({streams})),
bytes AS (SELECT name, unnest(range(1, n + 1)) AS p, unnest(regexp_extract_all(h, '..')) AS byte FROM s),
h0 AS (SELECT name, p, byte, v FROM bytes JOIN g USING (byte)),
{_doubling_sql(6)},
cand AS (
  SELECT name, p AS e, byte = '0A' AND v < 18014398509481984 AS strict, v < 9007199254740992 AS relaxed
  FROM h6 WHERE v < 18014398509481984 AND byte IN ('0A', '09', '0D', '20', '2C', '3B', '2E', '7D', '5D', '3E', '29')),
{_greedy_sql("name")}"""


TEXT_LANG = _text_sql("SELECT lang AS name, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY lang")
TEXT_DOCS = _text_sql("SELECT 'doc' || doc_id || '.md' AS name, coalesce(text, '') AS t FROM documents")


# the low 18 bits of 64 decide, so 32 bytes do
def _generic_sql(streams: str) -> str:
    return f"""
WITH RECURSIVE g AS ({_gear_sql(GENERIC)}),
s AS (SELECT name, t, octet_length(encode(t)) AS n, hex(encode(t)) AS h FROM ({streams})),
bytes AS (SELECT name, unnest(range(1, n + 1)) AS p, unnest(regexp_extract_all(h, '..')) AS byte FROM s),
h0 AS (SELECT name, p, byte, v FROM bytes JOIN g USING (byte)),
{_doubling_sql(5)},
cand AS (SELECT name, p AS e, v % 262144 = 0 AS strict, true AS relaxed FROM h5 WHERE v % 16384 = 0),
{_greedy_sql("name")}"""


GENERIC_SOURCE = _generic_sql("SELECT source AS name, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source")
# each source's stream twice: whole, and without its first document
GENERIC_TWICE = _generic_sql("""SELECT source || '/whole' AS name, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source
  UNION ALL SELECT source || '/rest', string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) FROM documents d
  WHERE doc_id > (SELECT min(doc_id) FROM documents x WHERE x.source = d.source) GROUP BY source""")

_PER = f"""{GENERIC_DOCS},
named AS (SELECT d.source, c."end" - c."start" AS length, sha256(encode(coalesce(d.text, ''))[c."start" + 1 : c."end"]) AS digest FROM chunks c JOIN documents d USING (doc_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        generic_boundaries_docs, generic_boundaries_source, text_boundaries_lang, chunk_stats, chunk_histogram, chunk_digests,
        dedup_ratio, dedup_pairs, new_chunks, exact_copies, corpus_report, streaming_parity, sql_functions,
    )
}
ORACLES = {
    "generic_boundaries_docs": f"{GENERIC_DOCS} SELECT * FROM chunks",
    "generic_boundaries_source": f"{GENERIC_SOURCE} SELECT * FROM chunks",
    "streaming_parity": f'{GENERIC_DOCS} SELECT c.doc_id, c.ordinal, c."start", c."end", ((s.n + 255) // 256)::BIGINT AS pushed FROM chunks c JOIN s USING (doc_id)',
    "sql_functions": f"""{GENERIC_DOCS}, {_detect_sql("documents", "doc_id", "text").strip().removeprefix("WITH ").replace("SELECT doc_id, array_to_string", ", found AS (SELECT doc_id, array_to_string") + ")"}
SELECT c.doc_id, any_value(f.detected) AS detected, count(*)::INTEGER AS ends, count(*) AS chunks, sum(c."end" - c."start")::BIGINT AS bytes, count(*) AS equal
FROM chunks c JOIN found f USING (doc_id) GROUP BY c.doc_id""",
    "dedup_pairs": f"""{GENERIC_TWICE},
named AS (SELECT string_split(c.name, '/')[1] AS source, c.name LIKE '%/whole' AS base, c."end" - c."start" AS length, sha256(encode(s.t)[c."start" + 1 : c."end"]) AS digest FROM chunks c JOIN s ON s.name = c.name),
hit AS (SELECT o.*, EXISTS (SELECT 1 FROM named b WHERE b.base AND b.source = o.source AND b.digest = o.digest) AS shared FROM named o WHERE NOT o.base)
SELECT source, count(*) AS chunks, count(*) FILTER (shared) AS shared_chunks, sum(length)::BIGINT AS total_bytes, coalesce(sum(length) FILTER (shared), 0)::BIGINT AS shared_bytes,
       round(100.0::DOUBLE * coalesce(sum(length) FILTER (shared), 0)::DOUBLE / sum(length)::DOUBLE, 9) AS percent
FROM hit GROUP BY source""",
    "text_boundaries_lang": f"{TEXT_LANG} SELECT * FROM chunks",
    "chunk_stats": f'{TEXT_LANG} SELECT name, count(*) AS chunks, sum("end" - "start")::BIGINT AS bytes, min("end" - "start") AS min_length, max("end" - "start") AS max_length FROM chunks GROUP BY name',
    "chunk_histogram": f'{TEXT_LANG} SELECT (("end" - "start") // 16384 * 16384)::BIGINT AS from_length, count(*) AS chunks, sum("end" - "start")::BIGINT AS bytes FROM chunks GROUP BY 1',
    "chunk_digests": f'{TEXT_LANG} SELECT c.name, c.ordinal, sha256(encode(s.t)[c."start" + 1 : c."end"]) AS digest FROM chunks c JOIN s ON s.name = c.name',
    "dedup_ratio": f"""{_PER},
per AS (SELECT source, digest, count(*) AS n, sum(length) AS b FROM named GROUP BY source, digest),
totals AS (SELECT source, sum(b)::BIGINT AS total_bytes FROM per GROUP BY source)
SELECT x.source AS base, y.source AS other, sum(y.n)::BIGINT AS shared_chunks, sum(y.b)::BIGINT AS shared_bytes, any_value(t.total_bytes) AS total_bytes,
       round(100.0::DOUBLE * sum(y.b)::DOUBLE / any_value(t.total_bytes)::DOUBLE, 9) AS percent
FROM per x JOIN per y ON x.digest = y.digest AND x.source <> y.source JOIN totals t ON t.source = y.source GROUP BY x.source, y.source""",
    "new_chunks": f"{_PER} SELECT source, count(*) AS chunks, sum(length)::BIGINT AS bytes FROM named WHERE source <> (SELECT min(source) FROM documents) AND digest NOT IN (SELECT digest FROM named WHERE source = (SELECT min(source) FROM documents)) GROUP BY source",
    "corpus_report": f"""{TEXT_DOCS},
per AS (
  SELECT s.name AS path, any_value(s.n) AS input_bytes, count(c.ordinal) AS chunks, coalesce(sum(c."end" - c."start"), 0)::BIGINT AS stored_bytes
  FROM s LEFT JOIN chunks c ON c.name = s.name GROUP BY s.name)
SELECT path, input_bytes, 'structured-text-v1' AS route, 0::BIGINT AS members, chunks, stored_bytes,
       CASE WHEN stored_bytes < 1024 THEN stored_bytes || ' B' ELSE printf('%.1f KiB', stored_bytes / 1024.0::DOUBLE) END AS stored
FROM per""",
    "exact_copies": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
}
