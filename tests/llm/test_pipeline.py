"""The stages one by one against brute force, and the run as a whole."""

import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm import quality
from sediment.llm.common import documents, materialize
from tests.llm.test_operators import CLASH, EDGE, frame, sentence, shingle_set

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, SF))
        out.append((name, docs.collect(), done.collect()))
        docs = done
    return {name: (before, after) for name, before, after in out}


def test_stages_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "byte_bpe"]
    for name in list(stages)[:-1]:
        assert list(stages[name][1][0].asDict()) == COLUMNS


def test_quality(stages, spark):
    before, after = stages["quality_rules"]
    docs, model = documents(spark, SF), quality.production_model()
    bands = quality.fit_bands(docs, spark.read.parquet(f"{SF}/labels.parquet"), model)
    kept = {r["doc_id"] for r in quality.fertility(docs, model, bands).where("kept").collect()}
    assert {r["doc_id"] for r in after} == kept and 0.7 * len(before) < len(after) < len(before)


def test_lines_only_lose_lines(stages):
    before, after = stages["line_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"] for r in after} == set(texts)
    for r in after:
        rest = iter(texts[r["doc_id"]].split("\n"))
        assert all(x in rest for x in r["text"].split("\n") if x) and r["n_chars"] == len(r["text"])


def test_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    like = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)
    kept = [r["doc_id"] for r in after]
    assert not any(like(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
    gone = set(sets) - set(kept)
    assert gone and all(any(like(sets[g], sets[o]) for o in sets if o != g) for g in gone)


def test_mix_and_ids(stages):
    before, mixed = stages["mix_sources"]
    assert len(mixed) > len(before) and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in before}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed}
    for r in stages["byte_bpe"][1]:
        assert r["ids"] == want.encode_ordinary(texts[r["doc_id"]]) and r["decodes"]


def test_stages_on_edges(spark):
    rows = [*EDGE, *[(100 + i, sentence(i, 120), "en", None if i % 2 else "s", 5) for i in range(6)]]
    for docs in (frame(spark, rows), frame(spark, EDGE[:1]).where("doc_id = 77")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, SF)
            assert done.columns == docs.columns
            done.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert set(CLASH.split()) <= set(frame(spark, EDGE).columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where(~F.col("decodes")).count() == 0
