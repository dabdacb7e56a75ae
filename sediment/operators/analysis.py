"""Reuse over chunk tables: sizes, shared bytes, what is new, and corpus reports. Digests and lengths only are shuffled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.media_type import parse
from sediment.functions.profiles import GENERIC, PROBE_BYTES, Rejected, registry
from sediment.operators import api, chunkers
from sediment.operators.decompose import Opaque, decompose, infer_member


def stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, bytes, least and greatest chunk; the least is 0 where there is none."""
    length = F.col("length")
    return chunks.groupBy(*by).agg(F.count("length").alias("chunks"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"), F.coalesce(F.min(length), F.lit(0)).alias("min_length"), F.coalesce(F.max(length), F.lit(0)).alias("max_length"))


def histogram(chunks: DataFrame, width: int = 16 * 1024) -> DataFrame:
    """Chunks by length, in steps of `width` bytes."""
    return chunks.where("length is not null").groupBy((F.floor(F.col("length") / width) * width).alias("from_length")).agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


def shared(base: DataFrame, other: DataFrame) -> DataFrame:
    """Chunks and bytes of `other` whose digest is among base's; a repeat in `other` counts each time."""
    hits = other.join(base.select("digest").distinct(), "digest", "left_semi")
    return hits.agg(F.count("*").alias("shared_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("shared_bytes"))


def new_chunks(base: DataFrame, other: DataFrame) -> DataFrame:
    """The chunks of `other` that base doesn't have."""
    return other.join(base.select("digest").distinct(), "digest", "left_anti")


def shared_pairs(chunks: DataFrame, name: str) -> DataFrame:
    """For each ordered pair of streams that share a chunk: what the second shares with the first, and its share in percent.

    Each side is first reduced to one row a digest and stream, so a digest repeated within a stream meets
    the other streams once; a pair with nothing in common has no row.
    """
    per = chunks.where("digest is not null").groupBy(name, "digest").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    left = per.select(F.col(name).alias("base"), "digest")
    right = per.select(F.col(name).alias("other"), "digest", "n", "b")
    met = left.join(right, "digest").where("base <> other").groupBy("base", "other").agg(F.sum("n").alias("shared_chunks"), F.sum("b").alias("shared_bytes"))
    totals = per.groupBy(F.col(name).alias("other")).agg(F.sum("b").alias("total_bytes"))
    return met.join(totals, "other").withColumn("percent", ratio(F.col("shared_bytes"), F.col("total_bytes")))


def reuse(chunks: DataFrame, by: str, is_base: Column) -> DataFrame:
    """By `by`, what the other side shares with its base: (by, chunks, new_chunks, total_bytes, shared_bytes, chunk_percent, byte_percent).

    One row a digest is made on each side before any meet, so a repeat costs nothing; `by` groups needn't fit a task.
    """
    side = chunks.where("digest is not null").withColumn("__base", is_base)
    length = F.when(~F.col("__base"), F.col("length"))
    per = side.groupBy(by, "digest").agg(F.max("__base").alias("known"), F.count(length).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("b"))
    known = lambda c: F.coalesce(F.sum(F.when(F.col("known"), F.col(c))), F.lit(0))
    out = per.groupBy(by).agg(F.sum("n").alias("chunks"), (F.sum("n") - known("n")).alias("new_chunks"), F.sum("b").alias("total_bytes"), known("b").alias("shared_bytes"))
    return out.withColumns({"chunk_percent": ratio(F.col("chunks") - F.col("new_chunks"), F.col("chunks")), "byte_percent": ratio(F.col("shared_bytes"), F.col("total_bytes"))})


def ratio(part: Column, total: Column) -> Column:
    """Percent; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / total)


def human(size: Column) -> Column:
    """Bytes below 1 KiB, else KiB or MiB with one decimal, ties to even."""
    shown = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(size / unit, 1))
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1 << 20, shown(1 << 10, "KiB")).otherwise(shown(1 << 20, "MiB"))


def analyse(files: DataFrame, path: str = "path", content: str = "content", declared: str | None = None, digest: str = "sha256") -> DataFrame:
    """The chunks of files: containers by their members, others by profile, and what is refused as generic.

    (file, path, input_bytes, route, reason, container, members, member, profile, ordinal, start, end, length,
    digest). `file` tells rows of one path apart; `members` counts those of all container levels. A file that
    its container reader or its profile refuses is cut whole as generic under the route `opaque`; a member
    that its profile refuses is cut as generic under `opaque` as well. An empty file, or one without content,
    has one row without a chunk. A file without a path goes by its bytes alone.
    """
    source = files.select(F.monotonically_increasing_id().alias("file"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{path}`").cast("string").alias("name"), F.col(f"`{content}`").cast("binary").alias("content"), (F.col(f"`{declared}`") if declared else F.lit(None)).cast("string").alias("declared"))
    api.few(files)
    hashed = api.DIGESTS[digest]
    listed = registry(2)
    fields = [("input_bytes", pa.int64()), ("route", pa.string()), ("reason", pa.string()), ("container", pa.string()), ("members", pa.int64()), ("member", pa.binary()), ("profile", pa.string())]
    fields += [(n, pa.int64()) for n in ("ordinal", "start", "end", "length")] + [("digest", pa.string())]
    no_chunk = (None,) * 5

    def cut(head: tuple, profile: str, data: bytes) -> list[tuple]:
        form, ends = chunkers.canonical_form(profile, data), chunkers.boundaries(profile, data)
        starts = [0, *ends][: len(ends)]
        return [(*head, profile, k, a, b, b - a, hashed(form[a:b])) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]

    def refused(size: int, why: str, container: str | None, members: int | None, member: bytes | None, data: bytes) -> list[tuple]:
        head = (size, "opaque", why, container, members, member)
        return cut(head, GENERIC, data) or [(*head, GENERIC, *no_chunk)]

    def taken_apart(size: int, data: bytes) -> list[tuple]:
        try:
            found = decompose(data)
        except Opaque as e:
            return refused(size, str(e), None, None, None, data)
        outer, out = found[0].container, []
        members = sum(e.members for e in found if e.kind == "container_end")
        for e in found:
            if e.kind != "member_end" or e.nested:
                continue
            profile = listed.get(e.media_type, GENERIC)
            try:
                out += cut((size, "decomposed", None, outer, members, e.path), profile, e.content)
            except Rejected as why:
                out += refused(size, why.detail, outer, members, e.path, e.content)
        return out or [(size, "decomposed", None, outer, members, None, None, *no_chunk)]

    def rows_of(name: str | None, data: bytes | None, told: str | None) -> list[tuple]:
        data = data or b""
        media, kind = infer_member((name or "").rsplit("/", 1)[-1].encode(), data[:PROBE_BYTES])
        if kind:
            return taken_apart(len(data), data)
        profile = listed.get(parse(told).essence if told else media, GENERIC)
        head = (len(data), "chunked", None, None, None, None)
        try:
            return cut(head, profile, data) or [(*head, profile, *no_chunk)]
        except Rejected as why:
            return refused(len(data), why.detail, None, None, None, data)

    return source.mapInArrow(lambda batches: api.tabled(batches, 2, fields, rows_of), "file long, path string, input_bytes long, route string, reason string, container string, members long, member binary, profile string, ordinal long, start long, end long, length long, digest string")


def corpus_report(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row a file, paths that repeat too: its size, route, members of all levels, chunks and stored bytes; order by path. The bytes themselves don't reach the shuffle."""
    cut = analyse(files, path, content)
    whole = F.col("member").isNull() & (F.col("route") == "opaque")
    per = cut.groupBy("file", "path", "input_bytes").agg(
        F.when(F.max("container").isNotNull(), "decomposed").when(F.max(whole), "opaque").otherwise(F.first("profile")).alias("route"),
        F.max(F.when(whole, F.col("reason"))).alias("reason"),
        F.coalesce(F.max("members"), F.lit(0)).alias("members"),
        F.count("digest").alias("chunks"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"),
    )
    return per.drop("file").withColumns({"size": human(F.col("input_bytes")), "stored": human(F.col("stored_bytes"))})


def inspect(found: DataFrame) -> DataFrame:
    """The events of containers as indented lines; order by the value's key and seq."""
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    line = (
        F.when(F.col("kind") == "container_start", F.concat(F.lit("["), F.col("container"), F.lit("]")))
        .when(F.col("kind") == "member_end", F.concat(path, F.lit("  "), human(F.col("size")), F.lit("  "), F.coalesce("media_type", F.lit("-"))))
        .when(F.col("kind") == "entry", F.concat(path, F.lit("  ("), F.col("entry"), F.lit(")")))
        .when(F.col("kind") == "container_end", F.format_string("= %d members, %d entries", "members", "entries"))
        .when(F.col("kind") == "opaque", F.concat(F.lit("OPAQUE: "), F.col("detail")))
    )
    return found.withColumn("line", F.concat(F.expr("repeat('  ', depth)"), line)).where("line is not null")
