"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host, the share of its pages that contain a line is that line's frequency; lines above a boilerplate
ratio go from every page of the host. Lines that exceed a ratio r number at most 1/r times the mean count
of distinct lines a page, so the list a host carries stays small however many pages it has.

Every page counts, copies too; with different=True the pages of a host with equal text count as one, so that
a copied page doesn't make boilerplate of itself. A line on fewer than MIN_PAGES pages is no boilerplate,
whatever its share: on one page alone nothing repeats.

A null text has no lines and stays null; an empty text has no lines; a null host is a host of its own;
blank lines are neither counted nor dropped; a page that loses all lines stays, with an empty text. A page of
any length is read whole; an empty table gives an empty result. Extra columns pass through, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import materialize, release

RATIO = 0.1
MIN_PAGES = 2

#: What separates lines when a page is shown, and what isn't shown at all.
HIDDEN = r"(?is)<script[ \t\r\n>].*?</script>|<style[ \t\r\n>].*?</style>|<!--.*?-->|<title[ \t\r\n>].*?</title>"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|nav|br|hr|tr|td|th|table|article|section|header|footer|main|aside|form|h[1-6]|head|body|html)(?:[ \t\r\n/][^>]*)?>"
TAG = r"<[^>]*>"
BLANK = r"[ \t\r\n]*\n[ \t\r\n]*"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def visible_lines(html: Column) -> Column:
    """The text of a page as one line a block, tags and hidden parts taken out."""
    for pattern, by in ((HIDDEN, ""), (BLOCK, "\n"), (TAG, ""), (BLANK, "\n")):
        html = F.regexp_replace(html, pattern, by)
    return F.btrim(html, F.lit(" \t\r\n"))


def _key(line: Column) -> Column:
    """128 bits of a line: what travels in place of its text."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, different: bool = False, made: list[DataFrame] | None = None) -> DataFrame:
    """(host_null, host_name, lines): the lines each host repeats on more than `ratio` of its pages, and on min_pages at least.

    What travels is one row of hashes a host and line, counted before the shuffle; with different=True one a
    host, page text and line comes before it.
    """
    pages = df.select(F.isnull(host).alias("host_null"), F.coalesce(host, F.lit("")).alias("host_name"), text.alias("t")).where(F.col("t").isNotNull())
    page = F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b")).alias("page")
    lines = F.array_distinct(F.transform(F.split("t", "\n"), lambda x: F.when(F.btrim(x, F.lit(" \t\r")) != "", _key(x))))
    # a null stands for blank lines; one row a page without a line counts the page
    marked = F.array_union(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), lines)
    if different:
        once = pages.select("host_null", "host_name", page, F.explode(marked).alias("line")).distinct()
    else:
        once = pages.select("host_null", "host_name", F.explode(marked).alias("line"))
    counts = once.groupBy("host_null", "host_name", "line").agg(F.count("*").alias("n"))
    counts = materialize(counts.where((F.col("n") >= min_pages) | F.col("line").isNull()), made)
    # a row a host, written out: its size is known, so the lines join it without being dealt by host while it is small
    totals = materialize(counts.where(F.col("line").isNull()).select("host_null", "host_name", F.col("n").alias("pages")), made)
    often = counts.where(F.col("line").isNotNull()).join(totals, ["host_null", "host_name"])
    often = often.where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host_null", "host_name").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, different: bool = False) -> DataFrame:
    """(row, n_lines, n_dropped): each row of df as a struct, its text cut to the kept lines, and counts (long).

    The lists join as a written table whose size is known: Spark broadcasts them only while they are
    under its threshold, and else joins by shuffle and splits a hot host's pages.
    """
    body = F.col(f"`{text}`")
    made: list[DataFrame] = []
    lists = materialize(boilerplate(df, host, body, ratio, min_pages, different, made)).withColumnRenamed("lines", "often")
    release(made)
    whole = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    keyed = df.select(whole, F.isnull(host).alias("hn"), F.coalesce(host, F.lit("")).alias("h"), F.split(body, "\n").alias("lines"))
    joined = keyed.join(lists, (F.col("hn") == F.col("host_null")) & (F.col("h") == F.col("host_name")), "left")
    often = F.coalesce(F.col("often"), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    solid = lambda x: F.btrim(x, F.lit(" \t\r")) != ""
    kept = F.when(F.size(often) == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~(solid(x) & F.array_contains(often, _key(x)))))
    out = joined.select("row", "lines", kept.alias("kept"))
    count = lambda name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.size(F.filter(name, solid))).cast("long")
    out = out.select(F.col("row").withField(f"`{text}`", F.array_join("kept", "\n")).alias("row"), count("lines").alias("n_lines"), count("kept").alias("n_left"))
    return out.select("row", "n_lines", (F.col("n_lines") - F.col("n_left")).alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # read twice below: the patterns run over the raw pages once
    shown = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text")))
    out = drop_boilerplate(shown, F.col("host"))
    return out.select("row.page_id", "row.host", "n_lines", "n_dropped", "row.text")


OP1_SQL = rf"""
WITH shown AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'),
           '{BLANK}', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS t
  FROM pages),
once AS (SELECT row_number() OVER () AS page, host, t FROM shown WHERE t IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM once GROUP BY host),
line_pages AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT DISTINCT host, page, unnest(string_split(t, chr(10))) AS line FROM once)
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY host, line),
often AS (
  SELECT host, line FROM line_pages JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages),
parts AS (
  SELECT page_id, host, i, ls[i] AS line
  FROM (SELECT page_id, host, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM shown)),
marked AS (
  SELECT p.*, o.line IS NOT NULL AS gone, trim(p.line, ' ' || chr(9) || chr(13)) <> '' AS solid
  FROM parts p LEFT JOIN often o ON p.host = o.host AND p.line = o.line)
SELECT page_id, host, count(*) FILTER (solid) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY page_id, host
"""
