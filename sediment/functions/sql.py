"""The functions for SQL: registered on a session under their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sediment.functions.media_type import parse_udf
from sediment.functions.probe import detect
from sediment.functions.profiles import Rejected
from sediment.operators import chunkers, office
from sediment.operators.api import boundaries_udf
from sediment.operators.decompose import Opaque, decompose
from sediment.session import prepare


def detect_prefix(prefix: pd.Series) -> pd.Series:
    return prefix.map(lambda p: None if p is None else detect(bytes(p)))


def canonical_package(content: pd.Series) -> pd.Series:
    """The canonical form of a package; null for what isn't one."""

    def form(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else office.canonical(bytes(data)).data
        except Rejected:
            return None

    return content.map(form)


class ChunkRows:
    """cdc_chunks(content, profile): a row a chunk."""

    def eval(self, content: bytes, profile: str):
        if content is None or profile is None:
            return
        at = 0
        try:
            form = chunkers.canonical_form(profile, bytes(content))
            ends = chunkers.boundaries(profile, bytes(content))
        except Rejected as e:
            yield None, None, None, None, None, e.detail
            return
        for k, end in enumerate(ends):
            yield k, at, end, end - at, form[at:end], None
            at = end


class EventRows:
    """cdc_decompose(content): a row a closed member, entry or container; one row with the reason where it can't be taken apart."""

    def eval(self, content: bytes):
        try:
            for seq, e in enumerate(decompose(bytes(content or b""))):
                yield seq, e.kind, e.depth, e.container, e.path, e.size, e.media_type, e.nested, e.content, None
        except Opaque as e:
            yield 0, "opaque", 0, None, None, None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.udf.register("cdc_boundaries", boundaries_udf())
    spark.udf.register("cdc_media_type", parse_udf())
    spark.udf.register("cdc_detect", F.pandas_udf(detect_prefix, "array<string>"))
    spark.udf.register("cdc_canonical_ooxml", F.pandas_udf(canonical_package, "binary"))
    spark.udtf.register("cdc_chunks", F.udtf(ChunkRows, useArrow=True, returnType="ordinal long, start long, end long, length long, data binary, error string"))
    spark.udtf.register("cdc_decompose", F.udtf(EventRows, useArrow=True, returnType="seq long, kind string, depth int, container string, path binary, size long, media_type string, nested boolean, content binary, detail string"))


