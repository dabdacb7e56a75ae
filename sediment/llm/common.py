"""Helpers the training-data operators share: scratch tables, ids of rows, word tables, blocks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; if none is named, a local one of our own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="sediment-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder belongs to the cluster's own clean-up
        pass


#: Scratch tables and folders not yet deleted, by path.
_tables: dict[str, SparkSession] = {}


@atexit.register
def _delete_all() -> None:
    for path, spark in _tables.items():
        _delete(spark, path)


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared scratch folder; what stands there goes with `release`, or when Python ends."""
    path = f"{scratch_dir(spark)}/sediment-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def materialize(df: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: a cut of the lineage that outlives executors.

    The shuffle files that fed the table go as soon as it is written; the table itself goes with `release`,
    or when Python ends. made: a list that gets the table, to be released together with others.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if made is not None:
        made.append(out)
    return out


def release(tables: list[DataFrame]) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _tables:
            _delete(_tables.pop(path), path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(base: str, taken: list[str]) -> str:
    """A column name that no column in `taken` has."""
    while base.lower() in {t.lower() for t in taken}:
        base += "_"
    return base


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch of whole texts can hold, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def dense_tables(spark: SparkSession) -> None:
    """Have Parquet tables written with zstd, unless the session names a codec. The setting is the session's."""
    key = "spark.sql.parquet.compression.codec"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "zstd")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (public splitmix constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Growing:
    """A NumPy array that grows by doubling."""

    def __init__(self, dtype) -> None:
        self.a, self.n = np.empty(1024, dtype), 0

    def extend(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.a):
            grown = np.empty(max(need, 2 * len(self.a)), self.a.dtype)
            grown[: self.n] = self.a[: self.n]
            self.a = grown
        self.a[self.n : need] = values
        self.n = need

    def view(self) -> np.ndarray:
        return self.a[: self.n]


class WordTable(dict):
    """Word -> dense number, in order of first sight; a new word is noted in `fresh`.

    Memory stays bounded however large the vocabulary: who keeps one starts anew once it holds `limit` words.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.fresh = limit, []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def full(self) -> bool:
        return len(self) >= self.limit

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def numbers_of(self, words: pa.Array) -> np.ndarray:
        """`numbers` of an Arrow column: each distinct word is looked up once, the new ones are noted in bulk."""
        told = words.dictionary_encode()
        distinct = told.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        unseen = np.flatnonzero(at < 0)
        at[unseen] = np.arange(len(self), len(self) + len(unseen))
        new = distinct[unseen].tolist()
        self.update(zip(new, at[unseen].tolist(), strict=True))
        self.fresh += new
        return at[told.indices.to_numpy()]


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i] : starts[i] + lens[i]], one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(total)
    return flat[at]


class Slices:
    """Words -> slices of ids, learned in bulk. When `limit` words are held, those asked for twice or more since
    the last time stay, half of the limit at most, and the others go: memory is bounded, and common words are learned once."""

    def __init__(self, limit: int) -> None:
        self.limit, self.table = limit, WordTable(limit)
        self.ids, self.start, self.len, self.seen = Growing(np.int32), Growing(np.int64), Growing(np.int32), Growing(np.int32)

    def fresh(self) -> list:
        """The words that wait for their ids; `add` gives them, in this order."""
        out, self.table.fresh = self.table.fresh, []
        return out

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        self.start.extend(self.ids.n + np.cumsum(lens) - lens)
        self.len.extend(lens)
        self.ids.extend(flat)
        self.seen.extend(np.zeros(len(lens), np.int32))

    def noted(self, at: np.ndarray) -> np.ndarray:
        self.seen.view()[:] += np.bincount(at, minlength=self.seen.n).astype(np.int32)
        return at

    def of(self, at: np.ndarray) -> np.ndarray:
        return gather(self.ids.view(), self.start.view()[at], self.len.view()[at])

    def renew(self) -> None:
        if not self.table.full():
            return
        seen, words = self.seen.view(), list(self.table)
        keep = np.flatnonzero(seen >= 2)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(seen[keep], kind="stable")[-(self.limit // 2) :]])
        lens, flat = self.len.view()[keep], self.of(keep)
        self.__init__(self.limit)
        self.table.update(zip([words[i] for i in keep], range(len(keep)), strict=True))
        self.add(flat, lens)


_remembered: dict = {}


def remembered(make: Callable, *args):
    """What a worker remembers for the operator at work: make(*args), kept through its tasks.

    A worker serves one operator after the other; what it remembered for the last is forgotten then, so that
    it holds one cache at a time.
    """
    key = (make, args)
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make(*args)
    return _remembered[key]


def forget() -> None:
    _remembered.clear()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def key_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """Cuts that deal an integer key into about equal ranges: quantiles of a sketch, at most parts - 1 numbers."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(f"`{key}`").cast("long"), shares, max(10_000, 20 * parts))).first()[0]
    return sorted(set(found or []))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at or below the key; 0 without a key. Only the key travels to Python."""
    bounds = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return F.when(key.isNull(), F.lit(0)).otherwise(place(F.coalesce(key.cast("long"), F.lit(0))))
