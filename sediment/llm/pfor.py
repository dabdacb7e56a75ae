"""Token ids as patched frame-of-reference files.

A file image holds documents in ascending order of their ids. Its values stand in blocks of BLOCK: the block
minimum is subtracted, the rest packed at the width that the PERCENTILE of the block needs, and what is
wider goes to an exception list of positions and values. An index of block starts lets a reader decode any
range of ids without the rest. An image is at most IMAGE ids and one document; a document is never split.

The executors write the files into a folder they share, under names that follow the order of the documents;
a file appears whole or not at all, and a task that runs again writes the same bytes under the same name.

A null text counts as empty and has only the end id; rows without an id come first; rows of one id are
ordered by their ids' bytes; repeated rows stay; an empty table gives no file; extra columns are left aside,
whatever they are called. Texts are encoded whole; a document of any length is in one file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import Slices, documents, forget, gather, key_cuts, materialize, remembered, scratch_path, shuffle_parts, small_batches, text_or_empty

BLOCK = 1024
PERCENTILE = 0.95
#: Ids of one file image.
IMAGE = 1 << 20
MAGIC = b"SPFR"
HEADER = struct.Struct("<4sHHQQQQ")
#: Chunks and pieces that an encoder remembers, each.
REMEMBERED = 300_000


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Blocks of unsigned 32-bit values: count, index of block starts, blocks."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QQ", 0, 0)
    padded = np.empty(blocks * BLOCK, np.int64)
    padded[:n] = values
    padded[n:] = values[-1]
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(1)
    rest = rows - least[:, None]
    cut = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    width = bit_widths(np.partition(rest, cut, 1)[:, cut])
    wide = rest >= (np.int64(1) << width)[:, None]
    patched = wide.sum(1)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        for a in range(0, len(these), 256):
            some = these[a : a + 256]
            kept = np.where(wide[some], 0, rest[some]).astype("<u2" if w <= 16 else "<u4")
            bits = np.unpackbits(kept.view(np.uint8).reshape(len(some), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
            for i, row in zip(some, np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little"), strict=True):
                packed[i] = row.tobytes()
    body, starts, at = [], np.empty(blocks, np.uint64), 0
    where, what = np.nonzero(wide)
    values_out = rest[where, what].astype("<u4")
    what = what.astype("<u2")
    ends = np.cumsum(patched)
    for i in range(blocks):
        a, b = ends[i] - patched[i], ends[i]
        block = struct.pack("<IBH", int(least[i]), int(width[i]), int(patched[i])) + packed[i] + what[a:b].tobytes() + values_out[a:b].tobytes()
        starts[i] = at
        at += len(block)
        body.append(block)
    return struct.pack("<QQ", n, blocks) + starts.astype("<u8").tobytes() + b"".join(body)


def unpack(data: bytes, at: int = 0, first: int = 0, count: int | None = None) -> np.ndarray:
    """Values first .. first + count of a packed run; only the blocks that hold them are read."""
    n, blocks = struct.unpack_from("<QQ", data, at)
    count = n - first if count is None else count
    if not count:
        return np.empty(0, np.uint32)
    index = np.frombuffer(data, "<u8", blocks, at + 16)
    base = at + 16 + 8 * blocks
    lo, hi = first // BLOCK, -(-(first + count) // BLOCK)
    out = np.empty((hi - lo, BLOCK), np.int64)
    heads = [struct.unpack_from("<IBH", data, base + int(index[i])) for i in range(lo, hi)]
    by_width: dict[int, list[int]] = {}
    for k, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(k)
    for w, all_of in by_width.items():
        size = BLOCK * w // 8
        for a in range(0, len(all_of), 256):
            some = all_of[a : a + 256]
            if not w:
                out[some] = 0
                continue
            raw = np.stack([np.frombuffer(data, np.uint8, size, base + int(index[lo + k]) + 7) for k in some])
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            # whole bytes of each value, then one wide integer
            room = 16 if w <= 16 else 32
            whole = np.zeros((len(some), BLOCK, room), np.uint8)
            whole[:, :, :w] = bits
            out[some] = np.packbits(whole, axis=2, bitorder="little").reshape(len(some), -1).view("<u2" if room == 16 else "<u4")
    for k, (least, w, patched) in enumerate(heads):
        if patched:
            p = base + int(index[lo + k]) + 7 + BLOCK * w // 8
            out[k, np.frombuffer(data, "<u2", patched, p)] = np.frombuffer(data, "<u4", patched, p + 2 * patched)
        out[k] += least
    skip = first - lo * BLOCK
    return out.ravel()[skip : skip + count].astype(np.uint32)


def write_image(keys: list, documents_ids: list[np.ndarray], before: int = 0) -> bytes:
    """One file: header, document ids (with a null mark each), lengths, ids. before: ids in earlier files of its part."""
    lengths = np.array([len(x) for x in documents_ids], np.int64)
    ids = np.concatenate(documents_ids) if documents_ids else np.empty(0, np.uint32)
    marks = np.array([k is None for k in keys], np.uint8).tobytes()
    names = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    packed = pack(lengths)
    return HEADER.pack(MAGIC, 2, BLOCK, len(keys), len(ids), before, len(packed)) + marks + names + packed + pack(ids)


def read_image(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, where each document's ids start in the part and the end of the last, all ids)."""
    magic, version, block, n_docs, n_ids, before, packed = HEADER.unpack_from(data)
    if magic != MAGIC or version != 2 or block != BLOCK:
        raise ValueError("not a token file of this version")
    at = HEADER.size
    marks = np.frombuffer(data, np.uint8, n_docs, at)
    names = np.frombuffer(data, "<i8", n_docs, at + n_docs)
    at += 9 * n_docs
    lengths = unpack(data, at)
    ids = unpack(data, at + packed)
    if len(ids) != n_ids:
        raise ValueError("token file is cut short")
    keys = [None if m else int(k) for m, k in zip(marks, names, strict=True)]
    return keys, before + np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]), ids


class WordIds:
    """Texts -> ids of a tokenizers vocabulary whose pre-tokens never cross white space and end in an end-of-word token.

    Texts are split at spaces as Arrow columns, so that Python meets each chunk once a batch. Chunks are cut once and
    remembered. Those of plain Latin characters are lowered and cut into pre-tokens here, all new ones in one pass, so
    their pieces are shared between forms; each new piece goes once through the library's merges, in the byte alphabet
    they are spelled in. Any other chunk goes to the library whole.
    """

    plain = re.compile(r"[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]+").fullmatch
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF ]+| ").findall

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.merges = self.library.model
        self.chunks, self.pieces = Slices(REMEMBERED), Slices(REMEMBERED)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self) -> None:
        found = [self.merges.tokenize(p if p.isascii() else spelled(p)) if p != " " else () for p in self.pieces.fresh()]
        if found:
            self.pieces.add(np.array([x.id for f in found for x in f], np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    def learn(self) -> None:
        fresh = self.chunks.fresh()
        plain = np.array([self.plain(c) is not None for c in fresh])
        # a space after each chunk, a piece without ids, tells where its pieces end
        found = self.cut("".join([c + " " for c, p in zip(fresh, plain.tolist(), strict=True) if p]).lower())
        self.pieces.renew()
        at = self.pieces.table.numbers_of(pa.array(found, pa.string()))
        self._new_pieces()
        self.pieces.noted(at)
        ends = np.cumsum(self.pieces.len.view()[at])[at == self.pieces.table.get(" ", -1)]
        whole = self._whole([c for c, p in zip(fresh, plain.tolist(), strict=True) if not p])
        lens = np.empty(len(fresh), np.int64)
        lens[plain], lens[~plain] = np.diff(ends, prepend=0), [len(x) for x in whole]
        # ids of plain chunks, then those of the others; gathered in the order of the chunks
        starts = np.empty(len(fresh), np.int64)
        for these in (plain, ~plain):
            starts[these] = np.cumsum(lens[these]) - lens[these]
        flat = self.pieces.of(at)
        starts[~plain] += len(flat)
        self.chunks.add(gather(np.concatenate([flat, *whole]), starts, lens), lens)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text end."""
        self.chunks.renew()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        at = self.chunks.table.numbers_of(split.flatten())
        if self.chunks.table.fresh:
            self.learn()
        self.chunks.noted(at)
        ends = np.concatenate([[0], np.cumsum(self.chunks.len.view()[at], dtype=np.int64)])
        return self.chunks.of(at), ends[split.offsets.to_numpy()[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if texts else []


#: Byte -> the character that stands for it in the vocabulary: printable Latin-1 characters stand for themselves, the
#: other bytes, in order, for what follows U+0100 (the public byte-level alphabet).
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: b for b in _SELF} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}


def spelled(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_ALPHABET)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then give it its name, so that it appears whole."""
    store, base = fs.FileSystem.from_uri(folder)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, f"{base}/{name}")
    except OSError:  # a store that doesn't replace: an earlier run of this task has written the same
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
            raise
        store.delete_file(own)


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, seq, n_docs, n_ids): the files that the executors wrote to the shared folder as part-seq.pfor, in ascending order of the key.

    folder: a URI of a store that the executors' Python can write (file:// on a shared mount, hdfs://, s3://, gs://).
    """
    spark = docs.sparkSession
    small_batches(spark)
    _make_folder(spark, folder)
    parts = max(1, shuffle_parts(spark))
    k = F.col(f"`{key}`").cast("long")
    rows, bounds = docs.select(k.alias("id"), text_or_empty(f"`{text}`").alias("t")), np.array(key_cuts(docs, key, parts), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = remembered(WordIds, tokenizer)
        for batch in batches:
            out = []
            for a in range(0, len(batch), 1024):
                flat, ends = made.flat(batch.column(1).slice(a, 1024))
                flat = np.insert(flat, ends, end_id)
                ends = [0, *(ends + np.arange(1, len(ends) + 1)).tolist()]
                # two bytes an id while they do: what is shuffled
                mark, kind, size = (b"\2", "<u2", 2) if flat.max() < 1 << 16 else (b"\4", "<u4", 4)
                raw = flat.astype(kind).tobytes()
                out += [mark + raw[size * i : size * j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            # the range of keys, found here: a second Python worker for it would hold its own memory
            ids = batch.column(0)
            part = np.where(ids.is_null(), 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(part.astype(np.int32)), pa.array(out, pa.binary())], names=["id", "part", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker may have encoded before: what it remembers is of no use from here on
        keys, held, size, part, seq, before = [], [], 0, None, 0, 0

        def written() -> pa.RecordBatch:
            _put(folder, f"{part:06d}-{seq:06d}.pfor", write_image(keys, held, before))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64())], names=["part", "seq", "n_docs", "n_ids"])

        for batch in batches:
            for id_, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)
                if keys and (at != part or size + len(ids) > IMAGE):
                    yield written()
                    seq, before = (seq + 1, before + size) if at == part else (0, 0)
                    keys, held, size = [], [], 0
                part = at
                keys.append(id_)
                held.append(ids)
                size += len(ids)
        if keys:
            yield written()

    encoded = rows.mapInArrow(encode, "id long, part int, ids binary")
    # a range of keys is a partition, whatever its number hashes to
    sorted_ = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids")
    return materialize(sorted_.mapInArrow(build, "part int, seq int, n_docs long, n_ids long"))


def read_token_files(files: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files of a folder, told by `files` of write_token_files.

    A file knows its place in its part; the driver adds up one count a part, so no file is shuffled.
    """
    spark = files.sparkSession
    small_batches(spark)
    first, starts = 0, []
    counts = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row a part
    for part in range(max(counts, default=0) + 1):
        starts.append(first)
        first += counts.get(part, 0)
    part = F.regexp_extract("path", r"(\d+)-\d+\.pfor$", 1).cast("int")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("content", F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), part + 1).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for data, first in zip(batch.column(0), batch.column(1), strict=True):
                keys, at, ids = read_image(data.as_py())
                raw, own = memoryview(ids.astype("<u4").tobytes()), at - at[0]
                crc = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(own[:-1], own[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at[:-1] + first.as_py(), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return images.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op7_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark)
    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, folder), folder)
