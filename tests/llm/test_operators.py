"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sediment.llm import bpe, fingerprints, jaccard, lines, mixing, pfor, pii, quality, sharding, substrings
from sediment.llm.common import WordTable
from sediment.llm.components import components

RANKS = P.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "size row place id th k h t part shard slot start kept lines spans words text_crc32 ids decoded __text __lang"


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = sentence("long", 30_000)
SHARED = sentence("shared", 60)
EDGE = [
    (0, "", "en", "a", 0),
    (1, None, None, None, None),
    (2, sentence(2, 80), "en", "a", 9),
    (2, sentence(2, 80), "en", "a", 9),
    (3, sentence(2, 80), "de", "b", 9),
    (4, LONG, "en", "a", 9),
    (5, "one two", "xx", "b", 9),
    (5, "one two", None, "", 9),
    (6, sentence(6, 40) + " " + SHARED + " " + sentence(7, 40), "en", "b", 9),
    (7, sentence(8, 20) + "\n" + SHARED.replace(" ", "\t") + "\n", "en", "b", 9),
    (8, " \n\t é日本😀  ​ \x85\xa0x\x1c ", "fr", "c", 9),
    (None, sentence(9, 70), "en", "a", 9),
    (None, None, "en", "a", 9),
    (9, sentence(2, 80).replace(" ", "  ", 1) + " tail", "en", "c", 9),
]


def frame(spark, rows=EDGE):
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return out.select("*", *[F.lit(1).alias(c) for c in CLASH.split()])


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, EDGE[:1]).where("doc_id = 77")


def text(row):
    return row[1] or ""


# ---------------------------------------------------------------- 2


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_any_text():
    want, made = reference(), bpe.Encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    alphabet = "ab ' s\n\t é日本😀 ​..!!1239\r\x1c\x85　\0stlv"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["a" * 4000 + " " * 300 + "b", "!" * 999, " " * 7, " x", "x ", "\n x", "don't we'll\n\nx\n", "ab" * 2000, "", LONG[:5000]]
    got = made.encode(texts)
    assert [x.tolist() for x in got] == [want.encode_ordinary(t) for t in texts]
    assert [made.decode(x) for x in got] == [t.encode() for t in texts]


@pytest.mark.parametrize("size", [1, 2, 7, 8, 9, 31, 32, 33, 200])
def test_long_and_short_trees_agree(size):
    v = bpe.Vocabulary(RANKS)
    rng = random.Random(size)
    for _ in range(20):
        piece = bytes(rng.choice(b"the and ing \xc3\xa9on") for _ in range(size))
        if size <= bpe.SHORT:
            assert v.encode_short([piece])[0].tolist() == v.encode_long(piece)
        assert b"".join(v.tokens[i] for i in v.encode_long(piece)) == piece


def test_bpe_rows(docs, none):
    want = reference()
    rows = bpe.digest_column(docs, RANKS, P.PATTERN).collect()
    expected = Counter()
    for r in EDGE:
        ids = want.encode_ordinary(text(r))
        expected[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text(r).encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == expected
    assert bpe.digest_column(none, RANKS, P.PATTERN).count() == 0
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in bpe.encode_column(docs, RANKS, P.PATTERN, keep=("doc_id", "text")).collect())


# ---------------------------------------------------------------- 1


def test_lines(spark, none):
    rows = [(i, f"own {i}\nmenu\n \nmenu\n{'rare' if i == 1 else 'x%d' % i}", "en", None if i % 2 else "h", 1) for i in range(40)]
    rows += [(50, None, "en", "h", 1), (51, "", "en", "h", 1), (52, "menu", "en", "small", 1)] + [(60 + i, "copied page\nof two lines", "en", "h", 1) for i in range(30)]
    rows += [(100 + i, f"same\nanother {i}", "en", "three", 1) for i in range(3)] + [(110, "same\n" + LONG, "en", "three", 1)]
    out = lines.drop_boilerplate(frame(spark, rows), F.col("source"), different=True).select("row.doc_id", "row.text", "row.size", "n_lines", "n_dropped").collect()
    got = {r["doc_id"]: r for r in out}
    assert got[1]["text"] == "own 1\n \nrare" and (got[1]["n_lines"], got[1]["n_dropped"]) == (4, 2)
    assert got[50]["text"] is None and got[51]["text"] == "" and got[51]["n_lines"] == 0
    assert got[52]["text"] == "menu" and got[60]["text"] == "copied page\nof two lines"
    assert got[100]["text"] == "another 0" and got[110]["text"] == LONG
    assert len(out) == len(rows)
    every = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(frame(spark, rows), F.col("source")).select("row.*").collect()}
    assert every[60] == "" and every[52] == "menu" and every[1] == got[1]["text"] and every[102] == "another 2"
    lenient = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(frame(spark, rows), F.col("source"), min_pages=5).select("row.*").collect()}
    assert lenient[102] == "same\nanother 2"
    assert lines.drop_boilerplate(none, F.col("source")).count() == 0


def test_visible_lines(spark):
    page = '<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><p>One <b>bold</b> word.<br>Two</p><script>var t="</p>";</script></body>'
    row = spark.createDataFrame([(page, "https://user@WWW.Example.com:8/x?y#z")], "html string, url string").select(lines.visible_lines(F.col("html")), lines.host_of(F.col("url"))).first()
    assert "Home\nOne bold word.\nTwo" in row[0] and "var" not in row[0] and row[1] == "www.example.com"


# ---------------------------------------------------------------- 3

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.ORDER[x[2]]))


@pytest.mark.parametrize("alphabet", ["0123456789.+-() ab@%é", "01.@a-+ ", "a@b.c-_%+", "4 -0", "+1 ()-.23", "255.0.1 "])
def test_spans_equal_a_plain_search(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [x for x in pii.spans_of(t) if x[2] in pii.BASE] == slow_spans(t)


def test_added_kinds():
    t = 'see https://example.com/a?b. token = "24be64439e3e49cf46b2d7c90f3602a3" IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789 account no. 12345678'
    found = {(k, t[a:b]) for a, b, k in pii.spans_of(t)}
    assert {("url", "https://example.com/a?b"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("account", "12345678")} <= found
    assert pii.redact("a b@c.de f", pii.spans_of("a b@c.de f")) == "a [email] f"
    assert pii.spans_of("token of thanks, the account of the secretary") == []
    assert pii.spans_of("1" * 100_000 + "@" * 1000) == []


def test_cues_in_any_spelling():
    key = "24be64439e3e49cf46b2d7c90f3602a3"
    told = {"secret": [f"API key: {key}", f"API Key = {key}", f"apiKey={key}", f"PassWord:{key}", f"api_key{' ' * 20}={' ' * 20}'{key}'", f"Token number: {key}"],
            "ssn": ["Social Security 123-45-6789", "social security number 123-45-6789", "SSN no.: 123-45-6789", f"ssn{' ' * 30}123-45-6789"],
            "iban": ["Iban Number: DE89 3704 0044 0532 0130 00", "IBAN nr. DE89 3704 0044 0532 0130 00", "iBAN DE89 3704 0044 0532 0130 00"],
            "account": ["ACCount Number 12345678", "Konto Nr. 12345678"], "url": ["Https://a.example/x", "hTTp://a.example/x"]}
    value = {"secret": key, "ssn": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00", "account": "12345678"}
    for kind, texts in told.items():
        for t in texts:
            whole = "İ é " + t
            assert [whole[a:b] for a, b, k in pii.spans_of(whole) if k == kind] == [value.get(kind, t)], t
    assert pii.spans_of(f"token = number{key}")[0] == (8, 8 + 6 + len(key), "secret")
    assert len(pii.lowered("İAé日B😀")) == 6 and not pii.spans_of("token" + " " * 100_000 + "password" + "number " * 10_000)


def test_pii_rows(docs, none, spark, tmp_path):
    told = [(20, "mail a.b@c-d.org, +49 (30) 1234-5678 or 10.0.0.256 and 10.0.0.255", "en", "a", 1), (21, "card 4111 1111 1111 1111 é😀 x@y.zz see https://a.b/c", "en", "a", 1)]
    rows = EDGE + told
    got = pii.find_spans(frame(spark, rows)).collect()
    want = Counter((r[0], tuple((k, a, b) for a, b, k in slow_spans(text(r)))) for r in rows)
    assert Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] in pii.BASE)) for r in got) == want
    assert pii.find_spans(none).count() == 0
    # the registered query, over a table of these rows
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op3_pii(spark, str(tmp_path)).collect()
    expected = Counter()
    for r in rows:
        spans = slow_spans(text(r))
        spelled = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        expected[r[0], *(sum(s[2] == k for s in spans) for k in pii.BASE), hashlib.sha256(spelled.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out) == expected
    whole = next(r["spans"] for r in out if r["doc_id"] == 21)
    assert whole.split(",")[0] == "card:5:24" and "url:" in whole


# ---------------------------------------------------------------- 4


def test_shards(docs, none, spark):
    rows = sharding.assign(docs, shards=3).collect()
    assert len(rows) == len(EDGE)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r[0], len(text(r).encode()) + 1, zlib.crc32(text(r).encode())) for r in EDGE)
    assert sharding.assign(none).count() == 0
    hot = [(i, "the same text again" if i % 3 == 0 else sentence(i, 5 + i % 40), "en", "a", 1) for i in range(6000)]
    out = sharding.assign(frame(spark, hot)).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    sizes, counts = [r["s"] for r in out], [r["n"] for r in out]
    assert len(out) == 8 and max(sizes) < 1.02 * min(sizes) and max(counts) < 1.02 * min(counts) and all(r["m"] == r["n"] - 1 for r in out)


def test_packing_takes_the_highest_dot_product():
    rng = np.random.default_rng(4)
    vectors = rng.random((60, 3)) * [100, 20, 1]
    left, total = [[0.25] * 3 for _ in range(4)], vectors.sum(0)
    share = (vectors / total).tolist()
    got = sharding.pack(vectors, 4)
    for i in sorted(range(60), key=lambda i: -max(share[i])):
        fits = [s for s in range(4) if all(left[s][d] >= share[i][d] - 1e-12 for d in range(3))] or list(range(4))
        dots = {s: sum(left[s][d] * share[i][d] for d in range(3)) for s in fits}
        assert dots[got[i]] == pytest.approx(max(dots.values()))
        left[got[i]] = [left[got[i]][d] - share[i][d] for d in range(3)]


def test_shard_query(spark, tmp_path):
    spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op4_vector_shards(spark, str(tmp_path))
    assert {r["law"] for r in out.collect()} == {"bytes"} and out.where("grown_shard is not null").count() == 0
    assert dict(out.dtypes) | {"tokens": ""} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "tokens": ""}


def test_shards_written(docs, tmp_path, spark):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(EDGE)


# ---------------------------------------------------------------- 5


def shingle_set(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_join(rows):
    sets = [shingle_set(text(r)) for r in rows]
    n = len(rows)
    links = [[j for j in range(n) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    return [(rows[i][0], len(links[i]), root[i]) for i in range(n)]


def near(seed, n, edits):
    w = sentence(seed, n).split()
    rng = random.Random(f"{seed}{edits}")
    for i in rng.sample(range(n), edits):
        w[i] = "changed%d" % i
    return " ".join(w)


@pytest.mark.parametrize("how", [{}, {"bucket": 4, "block": 5, "levels": 2}])
def test_join_equals_brute_force(spark, how):
    rows = [(i, near(f"s{i // 12}", 300, i % 12), "en", "a", 1) for i in range(96)] + [(200 + i, sentence(i, 30 + i), "en", "a", 1) for i in range(20)] + [(300 + i, near("s1", 300, 3), "en", "a", 1) for i in range(40)]
    got = {r["id"]: r for r in jaccard.join(frame(spark, rows), **how).collect()}
    want = slow_join(rows)
    firsts = {}
    for i, (doc, _, root) in enumerate(want):
        firsts.setdefault(root, []).append(doc)
    for doc, n, root in want:
        assert (got[doc]["n_links"], got[doc]["class_id"]) == (n, min(firsts[root]))


def test_join_edges(docs, none):
    rows = jaccard.join(docs).collect()
    assert len(rows) == len(EDGE)
    by = {r["id"]: r for r in rows if r["id"] is not None}
    assert by[3]["class_id"] == 2 and by[2]["n_links"] == 3 and by[1]["class_id"] == 1 and by[0]["n_links"] == 0
    kept = jaccard.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["0", "1", "2", "4", "5", "6", "7", "8", "None", "None"])
    assert kept[0]["size"] == 1
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_chosen_paths_reach_their_recall():
    a = np.arange(0, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:445], np.arange(1000, 1055, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    runs = jaccard.runs_needed(0.8, 0.999, 3)
    hit = sum(bool(set(jaccard.chosen(a, np.array([k], np.uint64), 0.8).tolist()) & set(jaccard.chosen(b, np.array([k], np.uint64), 0.8).tolist())) for k in range(1, 1001))
    assert hit / 1000 > 0.6 and runs >= 10


def test_runs_reach_their_recall_where_one_set_holds_the_other():
    whole = np.arange(0, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part, met = whole[:400], 0
    for k in range(1, 2001):
        paths = np.array([k << jaccard.RUN_BITS], np.uint64)
        for _ in range(3):
            paths = np.intersect1d(jaccard.chosen(whole, paths, 0.8), jaccard.chosen(part, paths, 0.8))
            if not len(paths):
                break
        met += bool(len(paths))
    assert (1 - met / 2000) ** jaccard.runs_needed(0.8, 0.999, 3) < 0.0015


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_recall_against_brute_force(spark, threshold):
    """Every row whose id is divisible by 50 against all rows; groups of copies at and around the threshold."""
    rng, rows = random.Random(threshold), []
    for i in range(120):
        words = sentence(f"r{threshold} {i}", rng.randint(60, 260)).split()
        for edits in (0, 1, 2, 3, 5, 8, 12, 17):
            w = list(words)
            for j in rng.sample(range(len(w)), edits):
                w[j] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.choice([0, 0, len(w) // 6])]), "en", "a", 1))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(50 * i if i < 200 else 10_000 + i, rows[k][1], *rows[k][2:]) for i, k in enumerate(order)]
    sets = [shingle_set(r[1]) for r in rows]
    want = {rows[i][0]: sum(i != j and len(s & x) >= threshold * len(s | x) for j, x in enumerate(sets)) for i, s in enumerate(sets) if rows[i][0] % 50 == 0}
    got = {r["id"]: r["n_links"] for r in jaccard.join(frame(spark, rows), threshold=threshold, bucket=16).collect()}
    assert sum(want.values()) > 100 and all(got[k] <= n for k, n in want.items())
    assert sum(got[k] for k in want) >= 0.99 * sum(want.values())


def test_a_long_text_in_a_large_group(spark):
    long = sentence("long group", 20_000)
    rows = [(i, long + f" end{i} of it" * (i % 3), "en", "a", 1) for i in range(60)] + [(100, sentence("else", 20_000), "en", "a", 1)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(frame(spark, rows), block=8).collect()}
    assert all(got[i] == (0, 59) for i in range(60)) and got[100] == (100, 0)


def test_sketches_rule_out_what_is_below_the_threshold_only():
    assert jaccard.least_agreement(0.8, 0.999) > jaccard.least_agreement(0.6, 0.999) > jaccard.least_agreement(0.5, 0.999) > 5
    assert jaccard.levels_for(0) == jaccard.levels_for(10**6) == 3 and jaccard.levels_for(10**9) == 5


def test_differences_give_what_sets_share():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.shared_counts(sets, sets).tolist() == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(25)] + [(90, 80), (90, 81), (91, 81)]
    links = [(a, b) for a, b in links if a != b]
    got = {r["k"][0]: r["g"][0] for r in components(spark.createDataFrame([(bytearray([a]), bytearray([b])) for a, b in links], "k binary, root binary")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_shingles_and_paths_equal_their_definition():
    """In blocks of paths and of shingles, and whatever words came before."""
    mix = lambda x: int(jaccard.mix64(np.array([x % 2**64], np.uint64))[0])
    low = (1 << jaccard.RUN_BITS) - 1
    for words in (1, 4, 5, 6, 300, 4000):
        t = sentence(f"path {words}", words) + "\u00e9\t\r\n "
        hashed, want = [jaccard.xxhash.xxh64_intdigest(w) for w in t.encode().split()], set()
        for i in range(max(1, len(hashed) - 4)):
            h = 0
            for k, w in enumerate(hashed[i : i + 5]):
                h = mix(h + w + k + 1)
            want.add(h)
        got = jaccard.shingles_of(t)
        assert got.tolist() == sorted(want)
        for paths in (jaccard.seeds_of(17), jaccard.seeds_of(3)[1:], np.empty(0, np.uint64)):
            limit, children = int(2**64 / (0.5 * len(want))), set()
            for p in paths.tolist():
                drawn = jaccard.mix64(got ^ np.uint64(p))
                children |= {mix(d + p) & ~low | p & low for d in drawn.tolist() if d <= limit}
            assert jaccard.chosen(got, paths, 0.5).tolist() == sorted(children)
    many = jaccard.seeds_of(64).repeat(600) + np.arange(64 * 600, dtype=np.uint64)  # more paths than a block
    few = jaccard.shingles_of(sentence("few", 8))
    assert jaccard.chosen(few, many, 0.8).tolist() == np.unique(np.concatenate([jaccard.chosen(few, many[i : i + 1], 0.8) for i in range(len(many))])).tolist()


# ---------------------------------------------------------------- 6


def slow_syncmers(t):
    points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    h = fingerprints._smer_hashes(points)
    out = []
    for i in range(len(points) - fingerprints.K + 1):
        inner = h[i : i + fingerprints.K - fingerprints.S + 1]
        if inner.min() in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers_equal_their_definition():
    t = sentence("sync", 300) + "é日😀" * 30
    assert fingerprints.syncmers(np.frombuffer(t.encode("utf-32-le"), np.uint32))[1].tolist() == slow_syncmers(t)
    inner = sentence("inner", 100)
    a = {inner[i : i + fingerprints.K] for i in slow_syncmers(inner)}
    shifted = "xyz " + inner + " tail"
    assert a <= {shifted[i : i + fingerprints.K] for i in slow_syncmers(shifted)}


def test_likeness():
    a, b = sentence("a", 400), sentence("b", 400)
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(a), f(a)) == 1 and fingerprints.likeness(f(a), f(b)) < 0.05
    assert 0.35 < fingerprints.likeness(f(a), f(fingerprints.edited(a, b))) < 0.7
    assert fingerprints.likeness(f(a), f(a + " x")) > 0.9
    assert f("") == "" and fingerprints.likeness("", "") == 1 and fingerprints.likeness("", f(a)) == 0 and f("ab") != f("ac")


def slow_likeness(a, b):
    """The longest run in one order over all anchors, by dynamic programming."""
    def anchors(t):
        points, found = np.frombuffer(t.encode("utf-32-le"), np.uint32), {}
        for h, p in zip(*(x.tolist() for x in fingerprints.syncmers(points)), strict=True):
            found.setdefault(h >> 16, p)
        return found
    x, y = anchors(a), anchors(b)
    if a == b:
        return 1.0
    common = [y[h] for h in sorted(x.keys() & y.keys(), key=x.get)]
    best = []
    for i, p in enumerate(common):
        best.append(1 + max([best[j] for j in range(i) if common[j] < p], default=0))
    return max(best, default=0) / len(x | y) if x and y else 0.0


def test_likeness_equals_brute_force(spark):
    rows = [(i, sentence(f"like {i // 2}", 60 + i) + (" tail " + sentence(f"t{i}", i % 7 * 10)), "en", "a", 1) for i in range(24)]
    rows.append((30, " ".join(reversed(rows[3][1].split())), "en", "a", 1))
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(frame(spark, rows), kept=None).collect()}
    near = {r["doc_id"]: r for r in fingerprints.compare_with_next(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        want = slow_likeness(r[1], fingerprints.edited(r[1], n[1])), slow_likeness(r[1], n[1])
        assert (got[r[0]]["near_edited"], got[r[0]]["near_next"]) == pytest.approx(want)
        assert (near[r[0]]["near_edited"], near[r[0]]["near_next"]) == pytest.approx(want, abs=0.2)


def test_fingerprint_query_keeps_every_anchor(spark, tmp_path):
    passage = sentence("passage", 12)
    texts = [sentence("x", 500) + passage + sentence("y", 90), sentence("z", 450) + passage + sentence("w", 300), sentence("v", 600), "short", "", None, "k" * 30, sentence("u", 7), "ab"]
    texts += [" ".join(reversed(texts[2].split())), texts[2], sentence("x", 500) + " and " + sentence("x", 200)]
    frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op6_closed_syncmers(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[i - 1] or ""
        points, new = np.frombuffer(t.encode("utf-32-le"), np.uint32), fingerprints.edited(t, n)
        assert len(got[i]["fingerprint"]) == 16 * len({h >> 16 for h in fingerprints.syncmers(points)[0].tolist()})
        assert got[i]["edited_fingerprint"] == fingerprints.fingerprint(new, None)
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((slow_likeness(t, new), slow_likeness(t, n)))
    assert len(got[0]["fingerprint"]) > 16 * fingerprints.KEPT and got[1]["near_next"] > 0  # a passage of two long texts


@pytest.mark.parametrize("named", [None, "snappy"])
def test_fingerprints_take_half_a_byte_a_digit(spark, tmp_path, named):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, named) if named else spark.conf.unset(key)
        frame(spark, [(i, sentence(f"dense {i}", 800), "en", "a", 1) for i in range(40)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        fingerprints.op6_closed_syncmers(spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
        digits = spark.read.parquet(f"{tmp_path}/out").agg(F.sum(F.length("fingerprint") + F.length("edited_fingerprint"))).first()[0]
        share = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) / digits
        assert share < 0.6 if named is None else share > 0.6  # a codec that the session names stays
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_edited_syncmers_equal_those_of_the_edited_text():
    rng = random.Random(6)
    texts = [sentence(i, 30)[: rng.choice([0, 1, 2, 3, 22, 23, 24, 25, 26, 35, 36, 37, 71, 72, 73, 150])] for i in range(60)]
    read = [(p, *fingerprints.syncmers(p)) for p in (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts)]
    for (t, a), (u, b) in zip(zip(texts, read, strict=True), [*zip(texts, read, strict=True)][1:] + [(texts[0], read[0])], strict=True):
        new = np.frombuffer(fingerprints.edited(t, u).encode("utf-32-le"), np.uint32)
        hashes, places, n = fingerprints._edited_syncmers(a, b)
        assert n == len(new) and [x.tolist() for x in (hashes, places)] == [x.tolist() for x in fingerprints.syncmers(new)]


def test_next_documents(docs, none):
    rows = fingerprints.compare_with_next(docs).collect()
    order = sorted(EDGE, key=lambda r: (r[0] is None, -(r[0] or 0), text(r)))
    expected = Counter()
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        expected[r[0], len(text(r)), hashlib.sha256(fingerprints.edited(text(r), text(n)).encode()).hexdigest(), fingerprints.fingerprint(text(r))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in rows) == expected
    assert fingerprints.compare_with_next(none).count() == 0


# ---------------------------------------------------------------- 7


def test_packing_is_exact():
    for n in (0, 1, 5, 1024, 1025, 5000):
        v = np.random.default_rng(n).integers(0, 50_000, n)
        v[::50] = 2**32 - 1
        data = pfor.pack(v)
        assert (pfor.unpack(data) == v).all()
        if n > 100:
            assert (pfor.unpack(data, 0, 37, 60) == v[37:97]).all() and (pfor.unpack(data, 0, n - 5) == v[-5:]).all()
    assert len(pfor.pack(np.arange(7, 7 + 1024))) < 1024 * 10 / 8 + 300


def test_word_ids_equal_the_library():
    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = "ab'sS dD\n\tÉéß İΣς日本́ 1²½!?.<|endoftext|>\xa0 \x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    got = pfor.WordIds(path).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_forget_what_is_rare(monkeypatch):
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    monkeypatch.setattr(pfor, "REMEMBERED", 60)
    made, texts = pfor.WordIds(path), [sentence(i, 30) + " the same é words, again! 日本" for i in range(20)]
    for t in texts:
        assert made.encode([t])[0].tolist() == want.encode(t, add_special_tokens=False).ids
        assert len(made.chunks.table) <= 60 + 40
    assert "again!" in made.chunks.table and sentence(0, 30).split()[0] not in made.chunks.table


def test_word_ids_look_a_chunk_up_once_a_batch():
    class Counted(WordTable):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    made, texts = pfor.WordIds(path), ["The same words,\nthe  same 日本 words,", "", " ", "日本", "The The\t"] * 100
    made.chunks.table = Counted(1000)
    want = [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new chunks, known ones
        Counted.asked = 0
        assert [x.tolist() for x in made.encode(texts)] == want
        assert 0 < Counted.asked <= 8
    ids, ends = made.flat(pa.array(texts).slice(250, 5))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[250:255]
    assert made.encode([]) == []


def test_token_files(docs, none, tmp_path):
    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    folder = f"file://{tmp_path}/tokens"
    files = pfor.write_token_files(docs, path, 2, folder)
    rows = pfor.read_token_files(files, folder).collect()
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r[0] for r in EDGE), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter()
    for r in EDGE:
        ids = np.array([*tk.encode(text(r), add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    written = sorted((tmp_path / "tokens").glob("*.pfor"))
    assert sum(len(pfor.read_image(p.read_bytes())[0]) for p in written) == len(EDGE) and files.count() == len(written)
    assert pfor.read_token_files(pfor.write_token_files(none, path, 2, folder + "0"), folder + "0").count() == 0


def test_token_files_of_many_images(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pfor, "IMAGE", 500)
    rows = [(i, sentence(i, 40), "en", "a", 1) for i in range(200)]
    folder = f"file://{tmp_path}/t"
    files = pfor.write_token_files(frame(spark, rows), P.path("word_bpe_49k.json"), 2, folder)
    got = sorted(pfor.read_token_files(files, folder).collect(), key=lambda r: r["doc_id"])
    assert files.count() > 20
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


# ---------------------------------------------------------------- 8


def slow_removal(rows):
    words = [WORD.findall(text(r)) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out[r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


def test_removal_equals_brute_force(docs, none, spark):
    got = substrings.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == slow_removal(EDGE)
    assert substrings.remove_repeats(none).count() == 0
    rng = random.Random(3)
    passages = [sentence(f"p{i}", rng.randint(30, 90)) for i in range(12)]
    rows = [(i, " ".join(x for k in range(rng.randint(1, 5)) for x in (sentence(f"{i} {k}", rng.randint(0, 40)), rng.choice(passages))), "en", "a", 1) for i in range(150)]
    rows += [(500, "x " * 200, "en", "a", 1), (501, " ".join(passages[0].split()[3:40]), "en", "a", 1), (502, passages[1].upper(), "en", "a", 1)]
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == slow_removal(rows)


def test_factors_are_greedy_matches(spark):
    rng = random.Random(5)
    passages = [sentence(f"f{i}", rng.randint(40, 160)) for i in range(10)]
    cut = lambda p: " ".join(p.split()[rng.randint(0, 15) : rng.randint(60, 200)])
    rows = [(i, " ".join(x for k in range(rng.randint(1, 5)) for x in (sentence(f"f{i} {k}", rng.randint(0, 40)), cut(rng.choice(passages)))), "en", "a", 1) for i in range(80)]
    rows += [(90, passages[0] + " " + passages[1], "en", "a", 1), (91, passages[0] + " " + passages[1], "en", "a", 1), (92, "y " * 100, "en", "a", 1)]
    docs = frame(spark, rows)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    at = {substrings.text_place(hashes[r[0]]) >> 24: WORD.findall(r[1]) for r in rows}
    long_ones = 0
    for r in substrings.remove_repeats(docs).collect():
        own = next(x[1] for x in rows if x[0] == r["doc_id"])
        words, end, place = WORD.findall(own), 0, None
        for f in r["factors"]:
            length, there = f["end"] - f["first"], at[f["place"] >> 24]
            long_ones += length > substrings.WINDOW
            low = f["place"] & (1 << 24) - 1
            assert length >= substrings.WINDOW and words[f["first"] : f["end"]] == there[low : low + length]
            assert f["place"] != substrings.text_place(hashes[r["doc_id"]]) + f["first"]
            # a factor that follows at once doesn't continue the one before
            assert place is None or f["first"] > end - substrings.WINDOW + 1 or f["place"] - place != f["first"] - first
            first, end, place = f["first"], f["end"], f["place"]
        assert [(x["first"], x["end"]) for x in r["removed"]] == substrings.covered([tuple(f) for f in r["factors"]])
    assert long_ones > 100
    assert substrings.parse(7, [(0, 10, 100, 900), (10, 5, 910, 110), (15, 1, 500, 600)]) == [(0, 49, 100), (15, 50, 500)]


# ---------------------------------------------------------------- 9


def slow_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        per = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * per >= 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * per for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix(docs, none, spark):
    rows = [(i, sentence(i, 5 + i % 50), "en", [None, "", "a", "é", "z"][min(4, i % 7)] if i % 3 else "hot", 1) for i in range(3000)]
    for some in (rows, EDGE):
        out = mixing.mix(frame(spark, some)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
        assert len(out) == len(some)
        sizes = Counter()
        for r in some:
            sizes[r[3]] += len(WORD.findall(text(r)))
        want, taken = slow_targets(sizes), Counter()
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["copies"] * r["size"]
        if some is rows:
            assert all(abs(taken[s] - want[s]) <= 55 for s in sizes)
            again = mixing.mix(frame(spark, some).repartition(7)).select("row.doc_id", "copies").collect()
            assert sorted((r[0], r[1]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)
    assert mixing.mix(none).count() == 0


# ---------------------------------------------------------------- 10


def slow_counts(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered)


def test_repeats_in_a_text_of_many_different_words():
    n = 4_500_000
    assert quality.repeat_words(np.arange(n)) == 0
    assert quality.repeat_words(np.append(np.arange(n), [5, 6, 7])) == 6


def test_counts_equal_brute_force(docs, none):
    model = quality.production_model()
    rng = random.Random(6)
    texts = [text(r) for r in EDGE] + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(30)] + ["x\nx\n \n \nx y\n#*$%&|<>", "\x0b\x0c a\x1cb\x85c"]
    got = quality.Meter(model).measure(texts)
    assert [g[:5] for g in got] == [slow_counts(t) for t in texts]
    rows = quality.fertility(docs, model).collect()
    assert len(rows) == len(EDGE)
    assert all(r["kept"] is False for r in rows if r["base_failed"])
    assert quality.fertility(none, model).count() == 0 and quality.keep_good(none, model).columns == none.columns


def test_fertility_tells_junk(spark):
    import sentencepiece

    model = quality.production_model()
    cut = sentencepiece.SentencePieceProcessor(model_file=model)
    t = "The quick brown fox jumps over the lazy dog while the sun sets behind the old stone bridge"
    row = quality.Meter(model).measure([t])[0]
    ids = [i for w in t.split() for i in cut.encode(w)]
    assert row[5] == len(ids) and row[6] == pytest.approx(len(t.replace(" ", "")) / len(ids))
    bands = {"en": (2.0, 8.0, 0.1, 5.0)}
    good = (
        "Early in the morning a fisherman left his small house near the harbour and rowed beyond the grey rocks, where cold currents bring herring "
        "close to shore. He waited for hours without any luck, thinking about winter, about money owed to neighbours, and about his daughter who wanted "
        "to study medicine in another city. When finally the net grew heavy, he laughed aloud and turned home before the storm could reach him."
    )
    bad = " ".join(f"{chr(0x4E00 + i)}|{chr(0x1F600 + i % 60)}" for i in range(80))
    out = {r["doc_id"]: r["kept"] for r in quality.fertility(frame(spark, [(1, good, "en", "a", 1), (2, bad, "en", "a", 1)]), model, bands).collect()}
    assert out == {1: True, 2: False}
    assert [quality.script_of(x) for x in ("abc", "дом", "日本", "", "العربية")] == ["latin", "cyrillic", "han", "other", "arabic"]


def test_bands_use_every_label(spark):
    model = quality.production_model()
    rows = [(i, sentence(f"en {i}", 55), "en", "a", 1) for i in range(12_000)] + [(20_000 + i, sentence(f"rare {i}", 55), "rare", "a", 1) for i in range(60)]
    rows += [(30_000 + i, sentence(f"few {i}", 55), "few", "a", 1) for i in range(20)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    bands = quality.fit_bands(frame(spark, rows), labels, model)
    assert {"en", "rare", ("script", "latin")} == set(bands)
    junk = sentence("junk", 30) + " " + " ".join(f"a {chr(0x4E00 + i)}" for i in range(30))
    assert quality.script_of(junk) == "latin"
    docs = frame(spark, [(1, junk, "en", "a", 1), (2, junk, "few", "a", 1), (3, junk, None, "a", 1), (4, sentence("few 1", 55), "few", "a", 1)])
    kept = {r["doc_id"]: r["kept"] for r in quality.fertility(docs, model, bands).collect()}
    assert kept == {1: False, 2: False, 3: False, 4: True}
    assert {r["doc_id"]: r["kept"] for r in quality.judged(quality.fertility(docs, model, keep=("doc_id", "lang")), bands).collect()} == kept


def test_a_script_band_spans_its_languages(spark):
    model = quality.production_model()
    odd = [(100 + i, sentence(f"odd {i}", 30) + " " + " ".join("xqzwvkj"[k % 5 :] + str(k) for k in range(i, i + 30)), "odd", "a", 1) for i in range(3)]
    rows = [(i, sentence(i, 60), "en", "a", 1) for i in range(90)] + odd
    bands = quality.fit_bands(frame(spark, rows), spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int"), model)
    assert "odd" not in bands and all(r["kept"] for r in quality.fertility(frame(spark, odd[1:]), model, bands).collect())


def test_entropy_floor_goes_by_length(spark):
    good = [(i, "en", "latin", False, 2000, 2.2, 0.0, 8 + i / 1000) for i in range(600)] + [(1000 + i, "en", "latin", False, 120, 2.2, 0.0, 6.2) for i in range(3)]
    asked = [(2000, "en", "latin", False, 120, 2.2, 0.0, 6.2), (2001, "en", "latin", False, 2000, 2.2, 0.0, 6.2), (2002, "xx", "latin", False, 60, 2.2, 0.0, 5.3), (2003, "xx", "latin", False, 2000, 2.2, 0.0, 6.2)]
    kind = "doc_id long, lang string, script string, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"
    bands = quality.bands_of(spark.createDataFrame(good, kind), spark.createDataFrame([(r[0], 1) for r in good], "doc_id long, quality int"))
    assert {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(asked, kind), bands).collect()} == {2000: True, 2001: False, 2002: True, 2003: False}


# ---------------------------------------------------------------- the registered queries


def test_registered_queries_on_edge_rows(spark, tmp_path):
    from sediment.llm import queries

    spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in EDGE if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pages = [(1, "http://a.example/x", "<p>menu</p><p>one</p>"), (2, "http://a.example/y", "<p>menu</p><p>two</p>"), (3, None, "<p>x</p>"), (4, "nonsense", None), (None, "http://b.example", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == len(pages if name == "op1_line_dedup" else EDGE), name
        if name == "op1_line_dedup":
            assert {r["page_id"]: r["text"] for r in rows} == {1: "one", 2: "two", 3: "x", 4: None, None: ""}
