"""Media types, registries, detection, and the Columns against the plain functions."""

import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import media_type, probe
from sediment.functions.profiles import IDS, PROFILES, name_of, registry
from sediment.operators.decompose import extension
from sediment.plans.routing import BAD_MEDIA_TYPES, MEDIA_TYPES, SIGNATURES


@pytest.mark.parametrize("case", MEDIA_TYPES)
def test_parse(case):
    m = media_type.parse(case[0])
    assert (m.essence, m.suffix, str(m)) == case[1:]
    assert media_type.parse(str(m)) == m


@pytest.mark.parametrize("case", BAD_MEDIA_TYPES)
def test_parse_faults(case):
    with pytest.raises(media_type.BadMediaType) as e:
        media_type.parse(case[0])
    assert (e.value.kind, e.value.offset) == case[1:]


def test_names_may_be_127_bytes():
    assert media_type.parse("a" * 127 + "/" + "b" * 127).top_level == "a" * 127


def test_parameters_by_any_case():
    m = media_type.parse("text/plain; Charset=UTF-8")
    assert m.parameter("CHARSET") == "UTF-8" and m.parameter("missing") is None


def test_registries():
    assert (len(registry(1)), len(registry(2))) == (52, 53)
    assert [IDS[p] for p in PROFILES] == list(range(1, 11))
    assert name_of(4) == "isobmff-v1" and name_of(11) == "unknown-profile-11"
    with pytest.raises(ValueError):
        registry(3)


@pytest.mark.parametrize("i", range(len(SIGNATURES)))
def test_signatures(i):
    prefix, v1, v2 = SIGNATURES[i]
    assert (", ".join(probe.detect(prefix, 1)), ", ".join(probe.detect(prefix, 2))) == (v1, v2)


def test_columns_equal_functions(spark):
    rng = random.Random(5)
    heads = [x[0] for x in SIGNATURES]
    cases = heads + [h[: rng.randint(0, len(h))] + rng.randbytes(rng.randint(0, 6)) for h in heads for _ in range(20)]
    cases += [("aé日😀" * 200).encode()[k : k + n] for k in range(12) for n in (509, 510, 511, 512, 513)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    for version in (1, 2):
        got = {r["i"]: r["d"] for r in rows.select("i", probe.detected(F.col("c"), version).alias("d")).collect()}
        assert [got[i] for i in range(len(cases))] == [probe.detect(c, version) for c in cases]


def test_texts_that_also_look_like_a_box(spark, tmp_path):
    from sediment.plans.routing import detect_documents, detected_sets

    # the first box of a media file: a size of 8 or more, or 0 or 1, and `free`; the reference then tells both
    rows = [(1, "en", "It ofreerwhble. Thatly hean"), (2, "de", "It of reerwhble"), (3, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    both = "structured-text-v1, isobmff-v1"
    assert sorted(map(tuple, detect_documents(spark, str(tmp_path)).collect())) == [(1, both, "ambiguous", None), (2, "structured-text-v1", "recognized", "structured-text-v1"), (3, "", "unrecognized", "generic-cdc-v1")]
    assert sorted(map(tuple, detected_sets(spark, str(tmp_path)).collect())) == [("de", "structured-text-v1"), ("en", both)]


def test_extensions():
    assert extension(b"a/b.tar.GZ") == "gz" and extension(b"a.b/c") is None and extension(b"x.") is None
    assert extension(b"x.ninechars") is None and extension(b"x.\xff") is None


def test_container_kinds(spark):
    from sediment.functions import paths
    from sediment.operators.decompose import container_of
    from sediment.plans.formats import CONTAINERS

    plain = bytearray(dict(CONTAINERS)["tar"][:600])
    plain[257:263] = bytes(6)  # without the magic the checksum tells
    plain[148:156] = b" " * 8
    plain[148:156] = b"%06o\0 " % sum(plain[:512])
    cases = [c for _, c in CONTAINERS] + [bytes(plain), bytes(600), b"", b"PK\1\2", bytes(plain[:300])]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = {r["i"]: r["k"] for r in rows.select("i", paths.container_kind(F.col("c")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [container_of(c[:512]) for c in cases] and got[len(CONTAINERS)] == "tar"


def test_profile_sets(spark):
    from sediment.functions import paths

    row = spark.range(1).select(paths.set_names(paths.set_bits(F.array(F.lit("framed-audio-v1"), F.lit("generic-cdc-v1")))).alias("s")).first()
    assert row["s"] == ["generic-cdc-v1", "framed-audio-v1"]
