"""N-gram Jaccard self-join by the chosen-path method.

Texts with one set of five-word shingles are one class from the start. A run of the join splits the classes
recursively: at each level a class goes into the bucket of every shingle whose hash, drawn anew for each
path, falls below 1 / (t * size of its set), so two sets of similarity t meet with a constant chance. A
bucket of at most BUCKET sets is compared by brute force; a larger one is split at the next level, and one
that is still larger at the last level is compared in blocks, so nothing is left out. The levels grow with
the logarithm of the corpus. Runs are repeated until the chance that a pair at the threshold was never in
one bucket is below 1 - RECALL. Two runs more come first and only group what is plainly alike, so that in
the others a large group of near copies meets what is not in it, and not itself.

Buckets hold a small MinHash sketch instead of the set; pairs that the sketch can't rule out link classes
into provisional groups. Each group is then judged exactly. Its sets travel as what they have more or less
than the group's first set, which is little where copies are near, however long the texts; the common part
of two sets follows from these differences. Groups beyond a block are paired by blocks that grow with the
root of the group, so rows grow with n^1.5 and a task's memory with the root of n. Links are counted where
they are found and only labels and counts leave a block.

Results: one row a document: its class (the least id its links lead to), its number of links (other
documents at the threshold or above) and of linked different sets. A null or empty text has no shingle, no
link and a class of its own, as has a row without an id; a text of one to four words is one shingle;
repeated rows are links of each other; an empty table gives an empty result; extra columns are left aside,
whatever they are called. Long texts are compared whole: a task holds one whole set and a block of differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import documents, forget, materialize, mix64, release, signed, small_batches, text_or_empty
from sediment.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Runs before the first grouping, on top of those that the recall needs: they look into single blocks of
#: large buckets; the later runs look into all of a bucket, but only if it holds more than one group.
FIRST_RUNS = 2
#: The low bits of a path tell its run.
RUN_BITS = 6
#: Sets compared by brute force in one bucket, the least levels a run may split, and sets a level more is worth.
BUCKET = 128
LEVELS = 3
FANOUT = 100
#: MinHash values of a sketch, a byte each.
SKETCH = 64
#: Sets in one block of a comparison: so many, or SPREAD times the root of what is to be compared.
BLOCK, SPREAD = 1024, 16
#: Bytes of differences in one block.
BLOCK_BYTES = 8 << 20
#: Sets of one task that takes differences from a group's first set.
CHUNK = 512
#: Hashes drawn at once.
DRAWN = 1 << 14


def levels_for(n: int) -> int:
    """Levels of n documents: a bucket shrinks by FANOUT or so a level unless its sets are alike."""
    return max(LEVELS, math.ceil(math.log(max(n, 2), FANOUT)))


def least_agreement(threshold: float, recall: float) -> int:
    """Sketch values that must agree for a pair to be judged: a pair at the threshold falls below with 1e-4 of the recall's miss."""
    p, allowed, below, out = threshold + (1 - threshold) / 256, (1 - recall) * 1e-4, 0.0, 0
    while out < SKETCH:
        below += math.comb(SKETCH, out) * p**out * (1 - p) ** (SKETCH - out)
        if below > allowed:
            break
        out += 1
    return out


def runs_needed(threshold: float, recall: float, levels: int) -> int:
    """Repeats until a pair at the threshold met in a last-level bucket with probability `recall`.

    Two sets at similarity t share t times their union, and a shared shingle is chosen in both below 1 / (t n), n
    the larger size. So they share a Poisson number of chosen ones with the mean union / n: 1 at least, where one
    set holds the other, whatever t. Meeting through all levels is the survival of that branching process.
    """
    survive = 1.0
    for _ in range(levels):
        survive = 1 - math.exp(-survive)
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


def shingles_of(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text. A word is hashed each time: that is quicker than to look it up."""
    found = text.encode().split()
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    h = np.zeros(count, np.uint64)
    for k in range(width):
        h = mix64(h + words[k : k + count] + np.uint64(k + 1))
    return np.unique(h)


MULTIPLIERS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(shingles: np.ndarray) -> bytes:
    """One byte of each of SKETCH MinHash values."""
    least = np.full(SKETCH, ~np.uint64(0))
    for a in range(0, len(shingles), 4096):
        np.minimum(least, (MULTIPLIERS[:, None] * shingles[None, a : a + 4096]).min(1), out=least)
    return (mix64(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def chosen(shingles: np.ndarray, paths: np.ndarray, threshold: float) -> np.ndarray:
    """The children of each path: one per shingle whose hash under that path falls below 1 / (t n). They keep the path's run."""
    n = len(shingles)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * n))))
    low = np.uint64((1 << RUN_BITS) - 1)
    out = [paths[:0]]
    # all paths of a block at once, in blocks that stay in cache
    for a in range(0, len(paths), DRAWN):
        some = paths[a : a + DRAWN, None]
        for b in range(0, n, max(1, DRAWN // len(some))):
            drawn = mix64(shingles[None, b : b + max(1, DRAWN // len(some))] ^ some)
            at = np.flatnonzero(drawn <= limit)
            path = some[at // drawn.shape[1], 0]
            out.append(mix64(drawn.ravel()[at] + path) & ~low | path & low)
    return np.unique(np.concatenate(out))


def seeds_of(runs: int) -> np.ndarray:
    """The root path of each run."""
    low = np.uint64((1 << RUN_BITS) - 1)
    return mix64(np.arange(1, runs + 1, dtype=np.uint64)) & ~low | np.arange(runs, dtype=np.uint64)


class Joined:
    """Members of a block, joined step by step; members of one label are one from the start."""

    def __init__(self, labels: np.ndarray) -> None:
        self.root = labels.copy()

    def link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Join i with others; the least of them that were apart, one of each part."""
        parts, first = np.unique(self.root[others], return_index=True)
        apart = parts != self.root[i]
        if not apart.any():
            return others[:0]
        merged = np.append(parts[apart], self.root[i])
        self.root[np.isin(self.root, merged)] = merged.min()
        return others[first[apart]]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches sorted by them; one run in memory at a time."""
    held: list[pa.RecordBatch] = []

    def end(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(k)[at].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*columns, strict=True))
        cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        if held and end(held[-1], held[-1].num_rows - 1) != rows[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sets(docs: DataFrame, key: str, text: str, threshold: float, runs: int) -> DataFrame:
    """(id, th, k, n, sketch, paths): a row a document; k names its shingle set, th its text."""
    small_batches(docs.sparkSession)
    seeds = seeds_of(runs)
    body = text_or_empty(f"`{text}`")
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("th"), body.alias("t"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what other operators left in the worker
        for batch in batches:
            k, n, sk, paths = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles_of(t)
                n.append(len(s))
                k.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sk.append(sketch(s) if len(s) else None)
                paths.append(signed(chosen(s, seeds, threshold)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k, pa.binary()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], names=["id", "th", "k", "n", "sketch", "paths"])

    return source.mapInArrow(run, f"id {kind}, th long, k binary, n int, sketch binary, paths array<long>")


def _with_text(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """wanted (rep_id, rep_th, ...) with the text t of that document; copies of a row give copies of a row."""
    body = text_or_empty(f"`{text}`")
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("th"), body.alias("t"))
    return source.join(wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).drop("id", "th", "rep_id", "rep_th")


def _compare_buckets(rows: DataFrame, threshold: float, agree: int) -> DataFrame:
    """(k, root): in each bucket (block of one), links that the sketch can't rule out, as a forest over what has one label.

    Rows of the bucket's main label come last and needn't be compared with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            ks, n = table.column("k").to_pylist(), table.column("n").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            joined = Joined(np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)[1])
            left, right = [], []
            for i in range(min(len(ks) - 1, len(ks) - sum(table.column("in_main").to_pylist()))):
                some = np.flatnonzero((joined.root[i + 1 :] != joined.root[i]) & (np.minimum(n[i], n[i + 1 :]) >= threshold * np.maximum(n[i], n[i + 1 :]))) + i + 1
                near = some[(sk[some] == sk[i]).sum(1) >= agree] if len(some) else some
                if len(near):
                    new = joined.link(i, near).tolist()
                    left += [ks[i]] * len(new)
                    right += [ks[j] for j in new]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["k", "root"])

    parts = rows.repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi", "in_main")
    return parts.select("path", "lo", "hi", "k", "n", "sketch", "label", "in_main").mapInArrow(run, "k binary, root binary")


def _parts(size: Column, total: Column, block: int) -> Column:
    """Blocks for `size` rows of a bucket or group of `total`."""
    return F.ceil(size / F.greatest(F.lit(float(block)), SPREAD * F.sqrt(total))).cast("int")


def _own(parts: Column) -> Column:
    return F.pmod(F.xxhash64("k"), parts).cast("int")


def _lone_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Each bucket's rows in blocks that aren't paired, dealt anew for each path: what the first runs look at."""
    own = F.pmod(F.xxhash64("k", "path"), F.ceil(F.col("size") / block)).cast("int")
    return rows.withColumns({"lo": own, "hi": own, "in_main": F.lit(False)})


def _label_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Blocks in which every two rows of a bucket with different labels meet.

    Rows of the bucket's most frequent label needn't meet each other: their blocks are paired with the
    blocks of the rest only, and the rest's blocks with one another where there are several.
    """
    main_parts = _parts(F.col("size") - F.col("rest"), F.col("size"), block)
    rest_parts = _parts(F.col("rest"), F.col("size"), block)
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    upto = lambda parts: F.sequence(F.lit(0), parts - 1)
    of_main = F.transform(upto(rest_parts), lambda j: pair(-_own(main_parts) - 1, j))
    of_rest = F.transform(upto(main_parts), lambda i: pair(-i - 1, _own(rest_parts)))
    among = F.transform(upto(rest_parts), lambda j: pair(F.least(j, _own(rest_parts)), F.greatest(j, _own(rest_parts))))
    among = F.when(rest_parts > 1, among).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("in_main"), of_main).otherwise(F.concat(of_rest, among))))
    return dealt.select("*", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))


def _differences(rows: DataFrame) -> DataFrame:
    """rows (g, k, copies, size, t) -> (g, k, copies, size, first_n, n, miss, diff): each set against the set of the group's first class.

    diff holds the shingles that only one of the two has, `miss` of them only the first. The first class's
    text goes to every CHUNK of its group ahead of the members, so a task holds one whole set at a time.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    place = lambda c, lead: F.struct(c.cast("int").alias("chunk"), F.lit(lead).alias("lead"))
    own = F.array(place(_own(chunks), False))
    ahead = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: place(c, True))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("k") == F.col("g"), F.concat(ahead, own)).otherwise(own)))
    dealt = dealt.select("g", F.col("at.chunk").alias("chunk"), F.col("at.lead").alias("lead"), "k", "copies", "size", "t")
    dealt = dealt.repartition("g", "chunk").sortWithinPartitions("g", "chunk", F.col("lead").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, np.empty(0, np.uint64)
        forget()
        for batch in batches:
            kept, numbers, diffs = [], [], []
            for i, (g, chunk, lead, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "chunk", "lead", "t")), strict=True)):
                own = shingles_of(t)
                if lead:
                    if (g, chunk) != at:  # rows alike in id and text give the first text more than once
                        at, first = (g, chunk), own
                    continue
                diff = np.setxor1d(first, own, True)
                # len(own) = len(first) - miss + (len(diff) - miss)
                kept.append(i)
                numbers.append((len(first), len(own), (len(first) + len(diff) - len(own)) // 2))
                diffs.append(diff.tobytes())
            out = batch.select(["g", "k", "copies", "size"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array([x[c] for x in numbers], pa.int64()) for c in range(3)), pa.array(diffs, pa.binary())], names=[*out.schema.names, "first_n", "n", "miss", "diff"])

    return dealt.mapInArrow(run, "g binary, k binary, copies long, size long, first_n long, n long, miss long, diff binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each left set shares with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    if not sizes[0].sum() or not sizes[1].sum():
        return out
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flat)
    cells = []
    for values, lens in zip(flat, sizes, strict=True):
        at = np.searchsorted(both, values)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(len(values), bool)
        who, at = np.repeat(np.arange(len(lens)), lens)[hit], at[hit]
        order = np.argsort(at, kind="stable")
        cells.append((who[order], at[order]))
    for a in range(0, len(both), 2048):
        held = []
        for (who, at), lens in zip(cells, sizes, strict=True):
            b, e = np.searchsorted(at, [a, a + 2048])
            x = np.zeros((len(lens), min(2048, len(both) - a)), np.float32)
            x[who[b:e], at[b:e] - a] = 1
            held.append(x)
        out += held[0] @ held[1].T
    return out


def _exact(rows: DataFrame, threshold: float, block: int, made: list[DataFrame]) -> DataFrame:
    """rows of _differences -> (k, root, links, sets): exact links within each pair of blocks of a group."""
    sizes = materialize(rows.groupBy("g").agg(F.sum(F.octet_length("diff")).alias("bytes")), made)
    rows = rows.join(sizes, "g")
    parts = F.greatest(_parts(F.col("size"), F.col("size"), block), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    dealt = rows.withColumn("own", _own(parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            ks, first = np.unique(np.array(table.column("k").to_pylist(), object), return_index=True)
            table = table.take(first)
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            own = table.column("own").to_numpy()
            copies, n, miss = (table.column(c).to_numpy().astype(np.int64) for c in ("copies", "n", "miss"))
            first_n = table.column("first_n")[0].as_py()
            diffs = [np.frombuffer(x, np.uint64) for x in table.column("diff").to_pylist()]
            links, sets, joined = np.zeros(len(ks), np.int64), np.zeros(len(ks), np.int64), Joined(np.arange(len(ks)))
            lows, highs = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            for a in range(0, len(lows), 512):
                some = lows[a : a + 512]
                for b in range(0, len(highs), 4096):
                    others = highs[b : b + 4096]
                    common = first_n - miss[some][:, None] - miss[others][None, :] + shared_counts([diffs[i] for i in some], [diffs[i] for i in others])
                    near = common >= threshold * (n[some][:, None] + n[others][None, :] - common) - 1e-9
                    near &= some[:, None] != others[None, :]
                    links[some] += near @ copies[others]
                    sets[some] += near.sum(1)
                    if lo != hi:
                        links[others] += near.T @ copies[some]
                        sets[others] += near.sum(0)
                    for i in np.flatnonzero(near.any(1)):
                        joined.link(some[i], others[near[i]])
            yield pa.RecordBatch.from_arrays([pa.array(list(ks), pa.binary()), pa.array([ks[r] for r in joined.root], pa.binary()), pa.array(links, pa.int64()), pa.array(sets, pa.int64())], names=["k", "root", "links", "sets"])

    dealt = dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return dealt.select("g", "lo", "hi", "own", "k", "copies", "first_n", "n", "miss", "diff").mapInArrow(run, "k binary, root binary, links long, sets long")


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (k, label, over, t) -> (k, label, paths): the next level of the paths in `over`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what other operators left in the worker
        for batch in batches:
            new = [signed(chosen(shingles_of(t), np.array(p, np.int64).view(np.uint64), threshold)) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.list_(pa.int64()))], names=["k", "label", "paths"])

    return rows.select("k", "label", "over", "t").mapInArrow(run, "k binary, label binary, paths array<long>")


def _grouped_by_runs(docs: DataFrame, key: str, text: str, classes: DataFrame, threshold: float, agree: int, bucket: int, levels: int, block: int, some_runs: Column, groups: DataFrame | None) -> DataFrame:
    """(k, g): the provisional groups after the runs that `some_runs` picks, on top of earlier `groups`.

    A bucket whose sets are all in one group already can add nothing and is passed over. Buckets are counted
    by partial sums, and the counts join back as a written table, so a hot path's rows can be split.
    """
    made: list[DataFrame] = []
    labelled = classes.select("k", "n", "sketch", "paths")
    if groups is None:
        labelled = labelled.withColumn("label", F.col("k"))
    else:
        labelled = materialize(labelled.join(groups, "k", "left").withColumn("label", F.coalesce("g", "k")).drop("g"), made)
    level, found = labelled.select("k", "label", "paths"), None
    for depth in range(1, levels + 1):
        rows = level.select("k", "label", F.explode("paths").alias("path"))
        rows = rows.where(some_runs) if depth == 1 else rows
        same = rows.groupBy("path", "label").agg(F.count("*").alias("same"))
        buckets = same.groupBy("path").agg(F.sum("same").alias("size"), F.count("*").alias("labels"), F.max(F.struct("same", "label")).alias("main")).where("labels > 1")
        if groups is None:
            # a label is one class here, so a bucket's rows are counted at once
            buckets = rows.groupBy("path").agg(F.count("*").alias("size"), F.lit(None).cast("struct<same: long, label: binary>").alias("main")).where("size > 1")
        buckets = materialize(buckets.select("path", "size", (F.col("size") - F.coalesce("main.same", F.lit(0))).alias("rest"), F.col("main.label").alias("main")), made)
        sized = rows.join(buckets, "path").select("k", "path", "size", "rest", F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("in_main"))
        sized = materialize(sized.join(labelled.select("k", "n", "sketch", "label"), "k"), made)
        small = sized if depth == levels else sized.where(F.col("rest") <= bucket)
        blocks = _lone_blocks(small, block) if groups is None else _label_blocks(small, block)
        linked = _compare_buckets(blocks, threshold, agree)
        found = linked if found is None else found.unionByName(linked)
        large = sized.where(F.col("rest") > bucket)
        if depth == levels or large.isEmpty():
            break
        over = large.groupBy("k", "label").agg(F.collect_set("path").alias("over"))
        over = over.join(classes.select("k", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "k")
        level = materialize(_split(_with_text(docs, key, text, over), threshold).dropDuplicates(["k"]), made)
    if groups is not None:
        found = found.unionByName(groups.select("k", F.col("g").alias("root")))
    out = components(found)
    release(made)
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, levels: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, th, class_id, n_links, n_linked_sets, keeper): a row a document; keeper marks one document of each class."""
    levels = levels or levels_for(docs.count())
    agree, made, runs = least_agreement(threshold, recall), [], FIRST_RUNS + runs_needed(threshold, recall, levels)
    if runs > 1 << RUN_BITS:
        raise ValueError(f"{runs} runs for a recall of {recall}; paths can tell {1 << RUN_BITS} apart")
    members = materialize(_sets(docs, key, text, threshold, runs))
    classes = materialize(members.where("k is not null").groupBy("k").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th")).alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("paths").alias("paths")))
    run_of, groups = F.col("path").bitwiseAND((1 << RUN_BITS) - 1), None
    for some_runs in (run_of < FIRST_RUNS, run_of >= FIRST_RUNS):
        groups = _grouped_by_runs(docs, key, text, classes, threshold, agree, bucket, levels, block, some_runs, groups)
        made.append(groups)
    # written out, so that a large group's rows aren't dealt by group to meet its size
    sizes = materialize(groups.groupBy("g").agg(F.count("*").alias("size")), made)
    wanted = groups.join(sizes, "g").join(classes.select("k", "copies", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "k")
    differences = materialize(_differences(_with_text(docs, key, text, wanted)), made)
    judged = materialize(_exact(differences, threshold, block, made), made)
    links = judged.groupBy("k").agg(F.sum("links").alias("links"), F.sum("sets").alias("sets"))
    joined = components(judged.where("k <> root").select("k", "root"))
    made.append(joined)
    # the id of a class is the least among its documents, whatever its sets' names are
    named = materialize(joined.join(classes.select("k", "rep"), "k").groupBy("g").agg(F.min("rep").alias("first")), made)
    named = joined.join(named, "g").select("k", "first")
    per_set = classes.select("k", "copies", "rep").join(links, "k", "left").join(named, "k", "left")
    per_set = materialize(per_set.select("k", F.coalesce("first", "rep").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("sets", F.lit(0)).alias("n_linked_sets")))
    release([*made, classes])
    out = members.select("id", "th", "k").join(per_set, "k", "left")
    alone = F.col("first").isNull()
    return out.select("id", "th", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_sets", F.lit(0)).alias("n_linked_sets"), (alone | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th")))).alias("keeper"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, the one of the least id, with all columns of docs; of rows alike in id and text one stays."""
    kept = join(docs, key, text, **how).where("keeper").select("id", "th").distinct()
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(f"`{key}`").alias("k"), F.xxhash64(text_or_empty(f"`{text}`")).alias("h"))
    out = rows.join(kept, F.col("k").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")), "left_semi")
    return out.groupBy("k", "h").agg(F.any_value("row").alias("row")).select("row.*")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_linked_sets")


OP5_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y, p.n = c AND q.n = c AS copy
  FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9),
names AS (
  SELECT doc_id, least(doc_id, coalesce(min(y) FILTER (copy), doc_id)) AS name
  FROM documents LEFT JOIN links ON x = doc_id GROUP BY doc_id),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, r.class_id, coalesce(l.n, 0) AS n_links, coalesce(l.sets, 0) AS n_linked_sets
FROM documents d
JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) r ON r.x = d.doc_id
LEFT JOIN (
  SELECT x, count(*) AS n, count(DISTINCT name) FILTER (NOT copy) AS sets
  FROM links JOIN names ON names.doc_id = y GROUP BY x) l ON l.x = d.doc_id
"""
