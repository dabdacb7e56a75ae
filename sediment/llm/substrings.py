"""Substring dedup by relative Lempel-Ziv parsing, with the corpus itself as the reference.

Texts are cut by their own content into blocks: every window of WINDOW words is governed by the least hash
among its GRAM-word grams, and the run of windows one gram governs is a block. Equal windows are governed by
equal grams at equal offsets, so a window can recur only in blocks under its gram. The index holds every
block of every text with the first and the last place it stands at; a place is a text and a word of it.

A document is parsed from left to right: a block that stands elsewhere opens a factor at its place there, and
the factor goes on greedily while the next block continues the text at that place; where it doesn't, the
factor ends and the next begins. At factor boundaries, where a block shares its gram but not all its words
with another, its windows are looked up one by one, so a match that starts or ends within a block is found to
the word. Every factor is a window or longer, which makes it a duplicate span; factors overlap at boundaries
by less than a window. The words covered are exact, up to collisions of 128 bits.

Only hashes are shuffled while the index is built; block hashes that are equal collapse, so a passage in
many documents is checked once; texts meet their factors once, and the texts with blocks to check once more.

Words are runs of anything but ASCII white space and stay unchanged. A null or empty text has no words; a
text shorter than a window loses nothing; repeated rows are occurrences of each other, and so are the copies
within one text; a null id is an id like any other; an empty table gives an empty result; a very long text is
parsed whole, in one task; extra columns are left aside, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import WordTable, documents, materialize, mix64, release, remembered, signed, small_batches, text_or_empty

WINDOW = 35
GRAM = 10
REMEMBERED = 400_000
#: Odd, so that it has an inverse modulo 2^64 (public splitmix constant).
BASE = 0x9E3779B97F4A7C15


class Cutter:
    """Texts -> blocks, by hashes of words that a worker remembers."""

    def __init__(self) -> None:
        self.table, self.hashes = WordTable(REMEMBERED), np.empty(0, np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 2 * n + 1024
            steps = np.full(size + 1, BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(BASE, -1, 2**64)
            self.down = np.cumprod(steps)

    def words(self, text: str) -> np.ndarray:
        if self.table.full():
            self.table, self.hashes = WordTable(REMEMBERED), np.empty(0, np.uint64)
        at = self.table.numbers(text.encode().split())
        if self.table.fresh:
            new = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.table.fresh), np.uint64, len(self.table.fresh))
            self.table.fresh, self.hashes = [], np.concatenate([self.hashes, new])
        return self.hashes[at]

    def sums(self, words: np.ndarray) -> np.ndarray:
        """S with hash of words[a:b] = (S[b] - S[a]) * BASE^a."""
        self.powers(len(words))
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.down[: len(words)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((sums[b] - sums[a]) * self.up[a])

    def blocks(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, block hash, first window, windows) of each block."""
        n = len(words)
        if n < WINDOW:
            none = np.empty(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none
        sums = self.sums(words)
        at = np.arange(n - GRAM + 1)
        grams = self.between(sums, at, at + GRAM)
        # the first place of the least gram in 1, 2, 4 ... then in all grams of a window
        span, best = 1, at
        wanted = WINDOW - GRAM + 1
        while span < wanted:
            step = min(span, wanted - span)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(grams[a] <= grams[b], a, b)
            span += step
        starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        counts = np.diff(np.append(starts, len(best)))
        gram = best[starts]
        whole = self.between(sums, starts, starts + counts + WINDOW - 1)
        return grams[gram], mix64(whole + (gram - starts).astype(np.uint64)), starts, counts


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = text_or_empty(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{key}`"), body).alias("th"), body.alias("t"))


def _index(rows: DataFrame, kind: str) -> DataFrame:
    """(gram, block, id, th, a, m): a row a block of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = remembered(Cutter)
        for batch in batches:
            found = [cut.blocks(cut.words(t)) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(f[0]) for f in found], np.int64)
            row = pa.array(np.repeat(np.arange(len(found)), sizes))
            joined = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(joined[0].astype(np.uint64))), pa.array(signed(joined[1].astype(np.uint64))), batch.column(0).take(row), batch.column(1).take(row), pa.array(joined[2].astype(np.int32)), pa.array(joined[3].astype(np.int32))], names=["gram", "block", "id", "th", "a", "m"])

    return rows.mapInArrow(run, f"gram long, block long, id {kind}, th long, a int, m int")


def _windows(rows: DataFrame, kind: str) -> DataFrame:
    """rows (id, th, t, asked array<(gram, block, a, m, c)>) -> (gram, window, id, th, a, c): a row a window of the blocks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = remembered(Cutter)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for id_, th, t, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = cut.words(t)
                sums = cut.sums(words)
                for b in asked:
                    at = np.arange(b["a"], b["a"] + b["m"])
                    out[0] += [b["gram"]] * len(at)
                    out[1] += signed(cut.between(sums, at, at + WINDOW)).tolist()
                    out[2] += [id_] * len(at)
                    out[3] += [th] * len(at)
                    out[4] += at.tolist()
                    out[5] += [b["c"]] * len(at)
            types = [pa.int64(), pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types, strict=True)], names=["gram", "window", "id", "th", "a", "c"])

    return rows.select("id", "th", "t", "asked").mapInArrow(run, f"gram long, window long, id {kind}, th long, a int, c long")


def _place(word: str = "a") -> Column:
    """Where a window stands: 40 bits that tell the row by its id and text, 24 of the word. Words beyond 2^24 count as another row's."""
    far = F.shiftright(word, 24).cast("long")
    return F.shiftleft(F.col("th").bitwiseXOR(far), 24).bitwiseOR(F.col(word).cast("long").bitwiseAND((1 << 24) - 1))


def text_place(text_hash: int) -> int:
    """The place of a row's first word, from xxhash64(id, text)."""
    low = text_hash << 24 & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


FIRST_LAST = (F.min, F.max)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, found array<(a, m, first, last)>): each document's blocks and windows that stand elsewhere, m windows from word a, with the first and last place of all they stand at."""
    small_batches(docs.sparkSession)
    kind, made = docs.schema[key].dataType.simpleString(), []
    rows = _keyed(docs, key, text)
    index = materialize(_index(rows, kind), made)
    ends = [f(_place()).alias(n) for f, n in zip(FIRST_LAST, ("first", "last"), strict=True)]
    # grams that govern blocks in two places or more, and whether these blocks are all one
    # written out, so that the join back is between two plain exchanges and a hot gram's rows can be split
    shared = index.groupBy("gram").agg(F.count("*").alias("n"), (F.min("block") == F.max("block")).alias("one"), *ends)
    shared = materialize(shared.where("n > 1").select("gram", "one", "first", "last"), made)
    hits = materialize(index.join(shared, "gram"), made)
    several = hits.where("not one").drop("first", "last")
    blocks = materialize(several.groupBy("gram", "block").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "a", "m")).alias("at"), *ends), made)
    again = several.join(blocks.where("c > 1").select("gram", "block", "first", "last"), ["gram", "block"])
    # factor boundaries: each distinct block under a shared gram is checked window by window, at one of its places
    asked = blocks.select(F.col("at.id").alias("id"), F.col("at.th").alias("th"), F.struct("gram", "block", F.col("at.a").alias("a"), F.col("at.m").alias("m"), "c").alias("b"))
    asked = asked.groupBy("id", "th").agg(F.collect_list("b").alias("asked"))
    texts = rows.join(asked.select(F.col("id").alias("i"), F.col("th").alias("h"), "asked"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    windows = materialize(_windows(texts, kind).distinct(), made)
    twice = materialize(windows.groupBy("gram", "window").agg(F.sum("c").alias("n"), *ends).where("n > 1").select("gram", "window", "first", "last"), made)
    single = windows.where("c = 1").join(twice, ["gram", "window"]).withColumn("m", F.lit(1))
    names = ["id", "th", "a", "m", "first", "last"]
    found = hits.where("one").select(names).unionByName(again.select(names)).unionByName(single.select(names))
    out = materialize(found.groupBy("id", "th").agg(F.collect_set(F.struct(*names[2:])).alias("found")))
    release(made)
    return out


def parse(text_hash: int, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, place of the first word elsewhere) from matches (a, m, first, last) of one text.

    A match goes on with the open factor if it begins in or right behind its windows and one of its places
    continues the factor's; else it opens a factor at a place other than its own.
    """
    out: list[list[int]] = []
    for a, m, *places in sorted(found):
        if out:
            start, end, place = out[-1]
            if a <= end - WINDOW + 1 and place + a - start in places:
                out[-1][1] = max(end, a + m + WINDOW - 1)
                continue
        own = text_place(text_hash ^ (a >> 24)) + (a & (1 << 24) - 1)
        out.append([a, a + m + WINDOW - 1, next((p for p in places if p != own), own)])
    return [tuple(f) for f in out]


def covered(factors: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Factors as word ranges: those that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for a, b, _ in factors:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, factors array<(first, end, place)>, removed array<(first, end)>, kept): the parse, the word ranges it covers, and the other words."""
    kind = docs.schema[key].dataType.simpleString()
    found = matches(docs, key, text).select(F.col("id").alias("i"), F.col("th").alias("h"), "found")
    rows = _keyed(docs, key, text).join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    factor = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, parsed, ranges, kept = [], [], [], [], []
            for t, th, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = t.encode().split()
                factors = parse(th, [tuple(x.values()) for x in some or []])
                parts = covered(factors)
                left, at = [], 0
                for a, b in parts:
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words))
                gone.append(len(words) - len(left))
                parsed.append([{"first": a, "end": b, "place": p} for a, b, p in factors])
                ranges.append([{"first": a, "end": b} for a, b in parts])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(parsed, pa.list_(factor)), pa.array(ranges, pa.list_(span)), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "factors", "removed", "kept"])

    return rows.select("id", "t", "th", "found").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, factors array<struct<first: int, end: int, place: long>>, removed array<struct<first: int, end: int>>, kept string")


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows WHERE h IN (SELECT h FROM twice)),
lost AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
parts AS (
  SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM words)),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY j) AS t
  FROM parts p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.j = p.j GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN lost l ON l.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
