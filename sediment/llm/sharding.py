"""Sharding by vector bin packing.

Each group of equal texts is a vector (bytes, tokens, rows). Vectors go, largest first, to the shard where
their dot product with the shard's residual capacity is highest. What the driver packs is bounded by the
number of shards, not by the data: groups above a small share of a total are packed one by one; all others
meet in LIGHT hash buckets a shard, which are packed as vectors; a group too large for one shard to take
without harm to the balance is packed as PIECES buckets of its rows.

The law is `bytes`: sizes are near equal, and tokens and rows as near as the same packing brings them. Slots
number a shard's rows without a gap, by ranges of hashes whose counts are summed up before the rows are
numbered, so no task sees a whole shard. A null text has size 1; rows alike in id and text share a shard;
null ids, ties and extra columns do no harm, whatever these are called; a text larger than a shard makes its
shard the largest; an empty table gives empty shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm.common import documents, materialize, text_or_empty

SHARDS = 8
#: Hash buckets of small groups, a shard.
LIGHT = 512
#: A group above 1 / (shards * ALONE) of a total is packed by itself, above 1 / (shards * SPLIT) in pieces.
ALONE, SPLIT, PIECES = 64, 4, 256
#: Rows that one task numbers.
NUMBERED = 1000
DIMENSIONS = ("size", "tokens", "n")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector: largest first, each to the highest dot product with residual capacity.

    A shard that lacks room for the vector in some dimension is passed over while another has room.
    """
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share.max(1))):
        score = residual @ share[i]
        room = (residual >= share[i] - 1e-12).all(1)
        if room.any():
            score = np.where(room, score, -np.inf)
        out[i] = int(score.argmax())
        residual[out[i]] -= share[i]
    return out


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, tokens, text_crc32, shard, slot): a row a document."""
    spark = df.sparkSession
    body = text_or_empty(f"`{text}`")
    rows = df.select(F.col(f"`{key}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.crc32(F.encode(body, "UTF-8")).alias("crc"), F.xxhash64(body).alias("g"), F.xxhash64(F.lit(1), body).alias("g2"))
    rows = materialize(rows.withColumn("piece", F.pmod(F.xxhash64("id", "g2"), F.lit(PIECES)).cast("int")))
    totals = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    totals = [max(1, x or 0) for x in totals]
    groups = rows.groupBy("g", "g2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = F.greatest(*[F.col(d) / t for d, t in zip(DIMENSIONS, totals, strict=True)])
    groups = materialize(groups.withColumn("share", share).withColumn("light", F.col("share") <= 1.0 / (shards * ALONE)))
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    # at most 3 * shards * ALONE groups are above the share, in whichever dimension: the broadcast is bounded
    heavy = groups.where("not light").select("g", "g2", (F.col("share") > 1.0 / (shards * SPLIT)).alias("split"))
    bucket = F.pmod(F.xxhash64("g", "g2"), F.lit(shards * LIGHT)).cast("int")
    zero = F.lit(0).cast("long")
    light = groups.where("light").groupBy(bucket.alias("piece")).agg(*sums).select(zero.alias("g"), zero.alias("g2"), "piece", F.lit(0).alias("kind"), *DIMENSIONS)
    pieces = rows.join(F.broadcast(heavy), ["g", "g2"]).withColumn("piece", F.when(F.col("split"), F.col("piece")).otherwise(-1))
    pieces = pieces.groupBy("g", "g2", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).select("g", "g2", "piece", F.lit(1).alias("kind"), *DIMENSIONS)
    # shards * LIGHT buckets, 3 * shards * ALONE groups and 3 * shards * SPLIT * PIECES pieces at most
    items = light.unionByName(pieces).orderBy("kind", "g", "g2", "piece").collect()
    placed = pack(np.array([[r[d] for d in DIMENSIONS] for r in items], np.float64).reshape(-1, 3), shards)
    table = spark.createDataFrame([(r["kind"], r["g"], r["g2"], r["piece"], int(s)) for r, s in zip(items, placed, strict=True)], "kind int, g long, g2 long, piece int, shard int")
    table = table.select("kind", F.col("g").alias("ig"), F.col("g2").alias("ig2"), F.col("piece").alias("ipiece"), "shard")
    marked = rows.join(F.broadcast(heavy), ["g", "g2"], "left")
    is_heavy = F.col("split").isNotNull()
    marked = marked.withColumns({
        "ig": F.when(is_heavy, F.col("g")).otherwise(zero),
        "ig2": F.when(is_heavy, F.col("g2")).otherwise(zero),
        "ipiece": F.when(F.col("split"), F.col("piece")).when(is_heavy, -1).otherwise(bucket),
        "kind": is_heavy.cast("int"),
    })
    sharded = marked.join(F.broadcast(table), ["kind", "ig", "ig2", "ipiece"]).select("id", "size", "tokens", "crc", "g", "g2", "shard")
    parts = max(1, -(-totals[2] // (shards * NUMBERED)))
    sharded = sharded.withColumn("part", F.pmod(F.xxhash64("g2", "id"), F.lit(parts)))
    counts = sharded.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("c").over(before), zero).alias("start"))
    within = W.partitionBy("shard", "part").orderBy("id", "g", "g2")
    numbered = sharded.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "part"])
    return numbered.select(F.col("id").alias(key), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("at")).alias("slot"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """The rows of df as Parquet under path/shard=N; rows alike in id and text are in one shard by assign's rule."""
    body = text_or_empty(f"`{text}`")
    where = assign(df, key, text, shards).select(F.col(f"`{key}`").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), "shard").distinct()
    out = df.join(where, F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.crc32(F.encode(body, "UTF-8")) == F.col("__crc")) & (F.octet_length(body) + 1 == F.col("__size")))
    out.drop("__id", "__crc", "__size").write.mode("overwrite").partitionBy("shard").parquet(path)


def op4_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
