"""From raw documents to token ids: quality rules, line dedup, near-duplicate join, mixing, byte-level BPE.

Every stage takes what its predecessor kept, in the columns of documents, and returns it so; the last
returns one row a document copy with its ids.

Stage by stage: a null or empty text fails the quality rules, loses no line, is a class of its own, has size 0
(its copies follow its source's epochs) and has no tokens. A null source is a source of its own; a null language
is judged by script; a row without an id is a class of its own and keeps no id. Rows alike in id and text are one
after the near duplicates. Texts of any length are taken whole. An empty table passes through every stage.
Columns beyond those of documents pass through all stages but the last, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import bpe, jaccard, lines, mixing, quality
from sediment.llm.common import documents, materialize
from sediment.session import prepare

#: Texts of a source that must share a line before it can go: copies, which a later stage removes, make no boilerplate.
MIN_TEXTS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's fertility bands, those of the labelled ones among them, go."""
    prepare(spark)
    return quality.fit_and_keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.production_model())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on many of its documents go; n_chars follows the text, every document stays."""
    out = lines.drop_boilerplate(docs, F.col("source"), min_pages=MIN_TEXTS, different=True).select("row.*")
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one it leaves out goes."""
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether they decode to the text's own bytes."""
    prepare(spark)
    out = bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source", "text"))
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't cut texts by the public vocabularies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
