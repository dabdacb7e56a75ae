"""Chunk tables, member tables and routes over DataFrames with a binary column.

Routing is Columns only and stays inside generated code; cutting is one Arrow pass that shuffles nothing.
A chunk row carries its digest and length; its bytes travel only when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import media_type, probe
from sediment.functions.blake3 import blake3
from sediment.functions.profiles import GENERIC, IDS, OOXML, Rejected, known
from sediment.operators import chunkers, office
from sediment.operators.decompose import Opaque, decompose

DIGESTS = {"sha256": lambda b: hashlib.sha256(b).hexdigest(), "blake3": lambda b: blake3(b).hex()}
CHUNK_FIELDS = "profile string, ordinal long, start long, end long, length long, digest string"
EVENT_FIELDS = "seq long, kind string, depth int, container string, path binary, ordinal long, size long, mode long, mtime long, media_type string, nested boolean, content binary, entry string, target binary, members long, entries long, office string"


#: Bytes of rows that are made before they leave as a batch.
HELD_BYTES = 32 << 20


def few(df: DataFrame, rows: int = 2048) -> None:
    """Values can be large: a bounded number of rows and bytes to a batch. The setting is the session's."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def tabled(batches: Iterator[pa.RecordBatch], keep: int, fields: list[tuple[str, pa.DataType]], rows_of: Callable[..., list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The first `keep` columns beside the rows that rows_of makes of the others: a batch out for a batch in, more where rows hold many bytes."""
    for batch in batches:
        kept_names, index, rows, held = batch.schema.names[:keep], [], [], 0

        def made() -> pa.RecordBatch:
            kept = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(keep)]  # noqa: B023
            return pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields))], names=[*kept_names, *(n for n, _ in fields)])  # noqa: B023

        for i in range(batch.num_rows):
            new = rows_of(*(batch.column(k)[i].as_py() for k in range(keep, batch.num_columns)))
            index += [i] * len(new)
            rows += new
            held += sum(len(x) for r in new for x in r if isinstance(x, bytes))
            if held >= HELD_BYTES:
                yield made()
                index, rows, held = [], [], 0
        yield made()


# ---------------------------------------------------------------- routes


def by_profile(name: str) -> Column:
    """The caller names the profile; no byte is looked at."""
    return F.lit(known(name))


def by_declaration(declared: Column, registry_version: int = 2) -> Column:
    """The registry's choice for a declared media type; null where it is malformed. No byte is looked at."""
    essence = media_type.essence_of(declared)
    return F.when(essence.isNotNull(), media_type.profile_of_essence(essence, registry_version))


def by_checked_declaration(declared: Column, content: Column, registry_version: int = 2) -> Column:
    """As by_declaration, but null too where the first bytes gainsay it. The detector is the current one, whatever the registry."""
    return probe.reconciled(probe.detected(content), by_declaration(declared, registry_version))


def by_detection(content: Column, detector_version: int = 2) -> Column:
    """What the first bytes show; null where they show several profiles."""
    return probe.resolved(probe.detected(content, detector_version))


# ---------------------------------------------------------------- chunks


def boundaries_udf():
    """(content, profile) -> struct<ends array<long>, error string, offset long>, for select and SQL."""

    @F.arrow_udf("struct<ends: array<long>, error: string, offset: long>")
    def find(content: pa.Array, profile: pa.Array) -> pa.Array:
        out = []
        for data, name in zip(content.to_pylist(), profile.to_pylist(), strict=True):
            if data is None or name is None:
                out.append(None)
                continue
            try:
                out.append({"ends": chunkers.boundaries(name, data), "error": None, "offset": None})
            except Rejected as e:
                out.append({"ends": None, "error": e.detail, "offset": e.offset})
        return pa.array(out, pa.struct([("ends", pa.list_(pa.int64())), ("error", pa.string()), ("offset", pa.int64())]))

    return find


def chunk(
    df: DataFrame,
    route: Column,
    content: str = "content",
    keep: tuple[str, ...] = (),
    digest: str | None = "sha256",
    with_data: bool = False,
    on_reject: str = "error",
    expected: str | None = None,
) -> DataFrame:
    """A row a chunk: `keep`, route, profile, ordinal, start, end, length, digest, [data], error, offset.

    A value its profile can't read gives one row with the error and no chunk, or with on_reject="generic"
    the chunks of the generic profile under the route `opaque`. Null values and null routes give an error
    row too. Offsets address the profile's canonical form.
    """
    if on_reject not in ("error", "generic"):
        raise ValueError("on_reject is 'error' or 'generic'")
    few(df)
    keep_list = list(keep)
    source = df.select(*[F.col(f"`{n}`") for n in keep_list], route.alias("__profile"), F.col(f"`{content}`").cast("binary").alias("__content"))
    hashed = DIGESTS[digest] if digest else (lambda b: None)
    fields = [("route", pa.string()), ("profile", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]
    fields += [("data", pa.binary())] * with_data + [("error", pa.string()), ("offset", pa.int64())]
    schema = f"{_schema(df, keep_list)}{', ' if keep_list else ''}route string, {CHUNK_FIELDS}{', data binary' if with_data else ''}, error string, offset long"

    def rows_of(profile: str | None, data: bytes | None) -> list[tuple]:
        blank = (None,) * (5 + with_data)
        if data is None or profile is None:
            return [("rejected", profile, *blank, "value is missing" if data is None else "no profile fits what is declared and detected", None)]
        try:
            form, ends, way = chunkers.canonical_form(profile, data), chunkers.boundaries(profile, data, expected), "structured"
        except Rejected as e:
            if on_reject == "error":
                return [("rejected", profile, *blank, e.detail, e.offset)]
            form, ends, profile, way = data, chunkers.boundaries(GENERIC, data), GENERIC, "opaque"
        out, at = [], 0
        for k, end in enumerate(ends):
            body = form[at:end]
            out.append((way, profile, k, at, end, end - at, hashed(body), *([body] if with_data else []), None, None))
            at = end
        return out

    return source.mapInArrow(lambda batches: tabled(batches, len(keep_list), fields, rows_of), schema)


def with_route(df: DataFrame, declared: str | None = None, content: str = "content", registry_version: int = 2) -> DataFrame:
    """df with `detected` (array<string>), `detection` and `profile`, by Columns."""
    found = probe.detected(F.col(f"`{content}`"))
    out = df.withColumn("detected", found).withColumn("detection", probe.state_of(F.col("detected")))
    if declared is None:
        return out.withColumn("profile", probe.resolved(F.col("detected")))
    return out.withColumn("profile", probe.reconciled(F.col("detected"), by_declaration(F.col(f"`{declared}`"), registry_version)))


def profile_ids(profile: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in IDS.items() for x in pair]), profile)


def package_members(df: DataFrame, content: str = "content", keep: tuple[str, ...] = (), profile: str = OOXML) -> DataFrame:
    """The members of canonical packages: `keep`, ordinal, name, offset of the header in the canonical form, size; no row for what isn't one.

    Only the canonicalising profile tells members; any other is an error.
    """
    if known(profile) != OOXML:
        raise ValueError(f"{profile} doesn't tell package members; {OOXML} does")
    few(df)
    keep_list = list(keep)
    source = df.select(*[F.col(f"`{n}`") for n in keep_list], F.col(f"`{content}`").alias("__content"))
    fields = [("ordinal", pa.int64()), ("name", pa.binary()), ("offset", pa.int64()), ("size", pa.int64())]

    def rows_of(data: bytes | None) -> list[tuple]:
        try:
            return [(k, *m) for k, m in enumerate(office.canonical(data or b"").members)]
        except Rejected:
            return []

    return source.mapInArrow(lambda batches: tabled(batches, len(keep_list), fields, rows_of), f"{_schema(df, keep_list)}{', ' if keep_list else ''}ordinal long, name binary, offset long, size long")


# ---------------------------------------------------------------- containers


def events(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of taking each value apart, in order of seq; one row of kind `opaque` where it can't be."""
    few(df, 64)
    keep_list = list(keep)
    source = df.select(*[F.col(f"`{n}`") for n in keep_list], F.col(f"`{content}`").alias("__content"))
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [(n, types[t]) for n, t in (f.split(" ") for f in (EVENT_FIELDS + ", reason string, detail string").split(", "))]

    def rows_of(data: bytes | None) -> list[tuple]:
        try:
            rows = [{"seq": s, **vars(e)} for s, e in enumerate(decompose(data or b""))]
        except Opaque as e:
            rows = [{"seq": 0, "kind": "opaque", "depth": 0, "nested": False, "reason": e.kind, "detail": str(e)}]
        return [tuple(r.get(n) for n, _ in fields) for r in rows]

    return source.mapInArrow(lambda batches: tabled(batches, len(keep_list), fields, rows_of), f"{_schema(df, keep_list)}{', ' if keep_list else ''}{EVENT_FIELDS}, reason string, detail string")


def members(found: DataFrame) -> DataFrame:
    """Member rows of an events table: closed members with their bytes and types."""
    return found.where("kind = 'member_end'")


def containers(found: DataFrame) -> DataFrame:
    """Container rows of an events table: kind, counts and Office kind at each level."""
    return found.where("kind = 'container_end'")
