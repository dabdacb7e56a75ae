"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if the least of its s-mers, by hash, stands first or last in it. The
choice looks at the k-mer alone, so an edit moves no anchor outside its own reach, and any k - s + 1
consecutive k-mers hold one. A fingerprint keeps all anchors in text order (kept=None, as the query does) or the
`kept` of least hash, each with its place as a fraction of the text; it needs no other document. Likeness
matches the anchors both fingerprints would have kept, in the same order in both: the longest increasing run
of their places, over all of them. With all anchors it is exact; with KEPT the fingerprint has a bounded size
and likeness estimates the exact one, with a standard deviation of about 0.04 (README).

A null text counts as empty; a text shorter than a k-mer has one anchor, of the whole text; an empty text
has the empty fingerprint, which is like itself (1) and like nothing else (0); equal texts have equal
fingerprints; an empty table gives an empty result; extra columns are left aside, whatever they are called;
texts of any length are read whole; as a string of Spark holds 2 GB, a text whose fingerprint takes every
anchor can have some 600 million characters. Fingerprints are hex digits, which Parquet's default codec leaves as
long as they are; the query has its result written with zstd, unless the session names a codec.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import dense_tables, documents, key_cuts, mix64, range_of, shuffle_parts, small_batches, text_or_empty

K, S = 24, 16
KEPT = 96
#: Places are told as a fraction of the text in so many steps.
STEPS = 1 << 16
CHUNK = 1 << 18
#: Characters of fingerprints that a batch of rows holds, and one row more.
OUT = 8 << 20
#: An odd multiplier of the rolling sum of characters (public splitmix constant).
BASE = 0x9E3779B97F4A7C15


def _smer_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each s-mer: doubling sums h_2m(p) = h_m(p) * BASE^m + h_m(p + m), S a power of two."""
    h, m, power = mix64(points.astype(np.uint64) + np.uint64(1)), 1, BASE
    while m < S:
        h = h[:-m] * np.uint64(power) + h[m:]
        m, power = 2 * m, power * power % 2**64
    return mix64(h)


def syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers of an array of code points, chunk by chunk."""
    n = len(points)
    if n < K:
        return (np.array([xxhash.xxh64_intdigest(points.tobytes())], np.uint64), np.zeros(1, np.int64)) if n else (np.empty(0, np.uint64), np.empty(0, np.int64))
    hashes, places = [], []
    for a in range(0, n - K + 1, CHUNK):
        smers = _smer_hashes(points[a : a + CHUNK + K - 1])
        count, inner = len(smers) - (K - S), K - S + 1
        least = smers[:count].copy()
        for d in range(1, inner):
            np.minimum(least, smers[d : d + count], out=least)
        at = np.flatnonzero((smers[:count] == least) | (smers[K - S : K - S + count] == least))
        # a k-mer is told by its first and last s-mer, which cover it
        hashes.append(mix64(smers[at] * np.uint64(3) + smers[at + K - S]))
        places.append(at + a)
    return np.concatenate(hashes), np.concatenate(places)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _kept_words(hashes: np.ndarray, places: np.ndarray, n: int, kept: int | None) -> np.ndarray:
    """Of the anchors of a text of n characters the first of each hash, in text order: 48 bits of hash, 16 of place."""
    told = hashes >> np.uint64(16)
    order = np.argsort(told)
    ranked = told[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    first = np.sort(np.minimum.reduceat(order, starts)[:kept]) if len(starts) else starts
    return told[first] << np.uint64(16) | (places[first] * STEPS // max(1, n)).astype(np.uint64)


def _spelled(words: np.ndarray) -> str:
    return words.astype(">u8").tobytes().hex()


def fingerprint(text: str, kept: int | None = KEPT) -> str:
    """The anchors of least hash, or all, in text order, 12 hex digits of hash and 4 of place each."""
    points = _points(text)
    return _spelled(_kept_words(*syncmers(points), len(points), kept))


def _longest_run(ranks: np.ndarray) -> int:
    """The longest increasing run of a permutation of 0 .. n - 1, block by block: no run loses by taking all it can of each."""
    n = len(ranks)
    ends = np.flatnonzero(np.maximum.accumulate(ranks) == np.arange(n)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    single = ends - starts == 1
    total = int(single.sum())
    for a, b in zip(starts[~single].tolist(), ends[~single].tolist(), strict=True):
        run: list[int] = []
        for place in ranks[a:b].tolist():
            at = bisect_left(run, place)
            run[at : at + 1] = [place]
        total += len(run)
    return total


def _likeness(a: np.ndarray, b: np.ndarray, kept: int | None) -> float:
    """`likeness` of fingerprints as arrays."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, y = a >> np.uint64(16), b >> np.uint64(16)
    # both keep the least of their own anchors; of the union only the least `kept` can be told apart
    full = [z.max() for z in (x, y) if kept and len(z) >= kept]
    if full:
        x, y = x[x <= min(full)], y[y <= min(full)]
    order = np.argsort(y)
    ranked = y[order]
    at = np.searchsorted(ranked, x)
    at[at == len(ranked)] = 0
    both = order[at[ranked[at] == x]] if len(ranked) else order
    union = len(x) + len(y) - len(both)
    ranks = np.empty(len(both), np.int64)
    ranks[np.argsort(both)] = np.arange(len(both))
    return _longest_run(ranks) / union if union else 0.0


def likeness(a: str, b: str, kept: int | None = KEPT) -> float:
    """0 to 1: of the anchors among the least of both, how many stand in both in one order."""
    return _likeness(*(np.frombuffer(bytes.fromhex(z), ">u8").astype(np.uint64) for z in (a, b)), kept)


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", kept: int | None = KEPT) -> DataFrame:
    """(key, fingerprint): one pass, no shuffle."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, kept) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "fingerprint"])

    return df.select(F.col(f"`{key}`"), text_or_empty(f"`{text}`").alias("__text")).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the head of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _edited_syncmers(own: tuple, nxt: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """Syncmers and length of the edited text, from (points, hashes, places) of a text and the following one.

    A k-mer is chosen by itself, so those within either part are known; only those across the seam are looked at.
    """
    points, following = own[0], nxt[0]
    cut = len(points) // 3
    seam, n = len(points) - cut, len(points) - cut + min(cut, len(following))
    if n < K:
        return *syncmers(np.concatenate([points[:seam], following[:cut]])), n
    left, right = own[2] <= seam - K, nxt[2] <= n - seam - K
    a = max(0, seam - K + 1)
    across = np.concatenate([points[a:seam], following[: min(cut, K - 1)]])
    hashes, places = syncmers(across) if len(across) >= K else (own[1][:0], own[2][:0])
    return np.concatenate([own[1][left], hashes, nxt[1][right]]), np.concatenate([own[2][left], places + a, nxt[2][right] + seam]), n


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: int | None = KEPT) -> DataFrame:
    """Each document against its edited text and the next document, in descending order of an integer key.

    A text's anchors are found once; those of its edited form are put together from its own and the next one's.
    Rows go once to ranges of the key, the first row of each range also to the range before it, so every
    task finds the next document of its last row; the first row of all also follows the last. Rows without
    a key come last; rows of one key are ordered by text.
    """
    small_batches(docs.sparkSession, 500)
    parts = max(2, shuffle_parts(docs.sparkSession))
    cuts = key_cuts(docs, key, parts)
    body = text_or_empty(f"`{text}`")
    k = F.col(f"`{key}`")
    # range 0 holds the largest keys; rows without a key are in the last range
    rows = docs.select(k.cast("long").alias("k"), body.alias("t"), (F.lit(len(cuts)) - range_of(k, cuts)).alias("part"))
    heads = {r["part"]: r["k"] for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect()}  # a row a range
    order = sorted(heads)
    # the range before each range; the last before the first
    feeds = {p: order[i - 1] for i, p in enumerate(order)}
    everywhere = range(len(cuts) + 1)
    at = F.col("part") + 1
    head = F.element_at(F.array(*[F.lit(heads.get(p)).cast("long") for p in everywhere]), at)
    feed = F.element_at(F.array(*[F.lit(feeds.get(p)).cast("int") for p in everywhere]), at)
    own = F.struct(F.col("part").alias("at"), F.lit(False).alias("extra"))
    # a head row goes to its own range and, marked, to the one before it
    copies = F.when(F.col("k").eqNullSafe(head), F.array(own, F.struct(feed.alias("at"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    dealt = rows.withColumn("c", F.explode(copies)).select("k", "t", F.col("c.at").alias("at"), F.col("c.extra").alias("extra"))
    dealt = dealt.repartitionById(parts, F.col("at")).sortWithinPartitions("at", "extra", F.col("k").desc_nulls_last(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, at_now, done, out, size = None, None, False, [], 0

        def read(text: str) -> tuple:
            points = _points(text)
            hashes, places = syncmers(points)
            return text, (points, hashes, places), _kept_words(hashes, places, len(points), kept)

        def flush(key_: int | None, this: tuple, following: tuple) -> int:
            changed, new = edited(this[0], following[0]), _kept_words(*_edited_syncmers(this[1], following[1]), kept)
            prints = _spelled(this[2]), _spelled(new)
            out.append((key_, len(this[0]), hashlib.sha256(changed.encode()).hexdigest(), *prints, _likeness(this[2], new, kept), _likeness(this[2], following[2], kept)))
            return sum(map(len, prints))

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            for key_, t, at, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != at_now:
                    held, at_now, done = None, at, False
                if done:
                    continue
                now = read(t)
                if held is not None:
                    size += flush(*held, now)
                if extra:
                    done = True  # of several rows of the head's key the first in order follows
                else:
                    held = key_, now
                if size > OUT:
                    yield taken()
                    out, size = [], 0
            if out:
                yield taken()
                out, size = [], 0

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("k", "t", "at", "extra").mapInArrow(run, schema).withColumnRenamed("id", key)


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense_tables(spark)
    return compare_with_next(documents(spark, sf_dir), kept=None)
