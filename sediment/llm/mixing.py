"""Mixing sources to target weights, in DataFrame functions only.

Sources share a budget of words by weight; a source's target stops at max_epochs times its size and the
excess is shared again by weight among the rest, until none is above. A document's place within its source
is a hash of its id and text. Word counts sum up by (source, hash prefix), a prefix sum over these few rows
finds the prefix in which a source's budget ends, and only the rows of that prefix are sorted one by one:
the cut is a hash value a source, so the rows themselves need no shuffle to learn whether they are in.

Whole documents are taken: the one on the cut is in if more than half of it is inside the budget. Rows
alike in id and text share a place and are in or out together. A null text has size 0; a null source is a
source of its own, ranked last; an empty table gives an empty mix. A document larger than what is left of its
source's budget is in if more than half of it fits, so a source misses its target by half a document at most.
Reruns agree: nothing depends on the order or the partition of rows. Extra columns pass through, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm.common import documents, materialize, release, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rows of a range, or fewer, on which a source's rows are sorted one by one, were all rows of one source.
RANGE_ROWS = 20_000


def digits_for(rows: int) -> int:
    """Hex digits of the hash that make a range: they grow with the logarithm of the rows."""
    return next(d for d in range(3, 32) if RANGE_ROWS * 16**d >= rows)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(key: Column, text: Column) -> Column:
    """A document's hash-random key."""
    return F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("\\N")), F.md5(text)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds target: weighted shares under caps, in closed form.

    In ascending order of cap / weight the capped sources come first; one is capped if, with those before
    it at their caps, its share of what is left reaches its cap. The windows run over one row a source.
    """
    everything = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumns({"cap": F.col("source_size") * max_epochs, "budget": F.sum("source_size").over(everything).cast("double") * share, "all_w": F.sum("w").over(everything)})
    before = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    ranked = ranked.withColumn("capped", F.col("w") * (F.col("budget") - F.col("cap_before")) >= F.col("cap") * (F.col("all_w") - F.col("w_before")))
    fixed = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    share_left = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("budget") - fixed) / free)
    return ranked.select("source", "source_size", share_left.alias("target"))


def cuts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(source, source_size, target, epochs, cut): each source's whole epochs, and the last place its part epoch takes."""
    digits, made = digits_for(df.count()), []
    body = text_or_empty(f"`{text}`")
    rows = df.select(F.col(f"`{source}`").alias("source"), body.alias("t"), place(F.col(f"`{key}`"), body).alias("place"))
    ranges = materialize(rows.groupBy("source", F.substring("place", 1, digits).alias("range")).agg(F.sum(words(F.col("t"))).alias("size")), made)
    per_source = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per_source = materialize(per_source.withColumn("epochs", whole).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), made)
    r, s = ranges.alias("r"), per_source.alias("s")
    ended = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("s.source", "range", "size", "left")
    ended = ended.withColumn("end", F.sum("size").over(W.partitionBy("source").orderBy("range")))
    # the range in which the budget ends: what lies before it is in, what lies behind it is out
    edge = materialize(ended.where((F.col("end") - F.col("size") < F.col("left")) & (F.col("end") >= F.col("left"))).groupBy("source").agg(F.min("range").alias("range"), F.min_by(F.col("left") - (F.col("end") - F.col("size")), "range").alias("room")), made)
    e = edge.select(F.col("source").alias("e_source"), F.col("range").alias("e_range"), "room")
    near = rows.join(e, rows["source"].eqNullSafe(F.col("e_source")) & (F.substring("place", 1, digits) == F.col("e_range")))
    near = near.groupBy("source", "e_range", "room", "place").agg(F.sum(words(F.col("t"))).alias("size"))
    near = near.withColumn("end", F.sum("size").over(W.partitionBy("source").orderBy("place")))
    last = near.groupBy("source", "e_range").agg(F.max(F.when(F.col("end") - F.col("size") / 2 < F.col("room"), F.col("place"))).alias("place"))
    last = last.select(F.col("source").alias("l_source"), F.coalesce("place", "e_range").alias("cut"))
    out = per_source.join(last, per_source["source"].eqNullSafe(F.col("l_source")), "left")
    out = materialize(out.select("source", "source_size", "target", "epochs", F.coalesce("cut", F.when(F.col("left") > 0, F.lit("g")).otherwise(F.lit(""))).alias("cut")))
    release(made)
    return out


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(row, size, source_size, target, copies): each row of df as a struct, and how often the mix takes it.

    The cuts join as a written table of known size, one row a source: broadcast under Spark's threshold,
    else joined by shuffle with a hot source's rows split.
    """
    limits = cuts(df, key, text, source, **how).withColumnRenamed("source", "of")
    body = text_or_empty(f"`{text}`")
    whole = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    rows = df.select(whole, F.col(f"`{source}`").alias("from"), words(body).alias("size"), place(F.col(f"`{key}`"), body).alias("place"))
    out = rows.join(limits, F.col("from").eqNullSafe(F.col("of")), "left")
    return out.select("row", "size", "source_size", "target", (F.col("epochs") + (F.col("place") <= F.col("cut")).cast("long")).alias("copies"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '\N') || '|' || md5(coalesce(text, ''))) AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         2 * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget
  FROM sizes),
running AS (
  SELECT *, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM ranked
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, w * (budget - cap_before::DOUBLE) >= (cap * (all_w - w_before))::DOUBLE AS capped FROM running),
aims AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE w * (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM marked),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM aims),
placed AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS room,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place) AS ends
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN room > 0 AND ends - size / 2.0 < room THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
