"""Byte-level BPE by a segment tree over byte positions, and its exact inverse.

Each leaf of the tree is a live token start and holds the rank of the pair it forms with the live token to
its right; an inner node holds the smaller (rank, position) of its two children, so the root is the
leftmost pair of minimum rank. A merge rewrites two leaves and removes one: three point updates of
logarithmic cost. Short pieces go through the tree many at a time, as columns of one array; long pieces
one by one. Results equal tiktoken's on every input.

Nulls count as empty texts; an empty text has no tokens; a null id stays null; repeated rows give repeated
rows; an empty table gives an empty result; extra columns are left aside, whatever they are called. A text of
any length is encoded whole: its cost is n log n in its longest piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import Slices, documents, fresh, gather, remembered, small_batches, text_or_empty

#: Pieces of up to this many bytes go through the batched tree.
SHORT = 32
#: Distinct chunks a worker remembers.
REMEMBERED = 300_000
NONE = np.int64(1) << 60


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes by id, and the id of each pair that merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.width = len(self.tokens)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge or a side is missing (-1)."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece by its own segment tree."""
        n = len(piece)
        ids = [int(self.byte_id[b]) for b in piece]
        if n < 2:
            return ids
        pairs, width, none = self.pairs, self.width, (int(NONE), n)
        size = 1 << (n - 1).bit_length()
        tree = [none] * (2 * size)
        for p in range(n - 1):
            if (r := pairs.get(ids[p] * width + ids[p + 1])) is not None:
                tree[size + p] = (r, p)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, value: tuple[int, int]) -> None:
            node = size + p
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while tree[1][0] < none[0]:
            rank, p = tree[1]
            gone = after[p]
            ids[p], ids[gone] = rank, -1
            after[p] = after[gone]
            if after[p] < n:
                before[after[p]] = p
            put(gone, none)
            r = pairs.get(rank * width + ids[after[p]]) if after[p] < n else None
            put(p, none if r is None else (r, p))
            if (q := before[p]) >= 0:
                r = pairs.get(ids[q] * width + rank)
                put(q, none if r is None else (r, q))
        return [i for i in ids if i >= 0]

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of at most SHORT bytes: their ids, one after the other, and how many each has.

        tree[node, column] holds rank * SHORT + position for the piece of that column.
        """
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count, longest = len(pieces), int(lens.max(initial=1))
        size = 1 << max(0, longest - 1).bit_length()
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size).T
        ids = np.where(np.arange(size)[:, None] < lens, self.byte_id[raw], -1)
        place = np.arange(size, dtype=np.int64)[:, None]
        tree = np.full((2 * size, count), NONE)
        if size > 1:
            ranks = self.pair_ranks(ids[:-1].ravel(), ids[1:].ravel()).reshape(size - 1, count)
            tree[size : 2 * size - 1] = np.where(ranks < NONE, ranks * SHORT + place[:-1], NONE)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        before = np.repeat(place - 1, count, 1)
        after = np.repeat(place + 1, count, 1)

        def put(p: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
            node = size + p
            tree[node, col] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[node, col] = np.minimum(tree[2 * node, col], tree[2 * node + 1, col])

        live = np.flatnonzero(tree[1] < NONE)
        while len(live):
            rank, p = np.divmod(tree[1, live], SHORT)
            gone = after[p, live]
            ids[p, live], ids[gone, live] = rank, -1
            nxt = after[gone, live]
            after[p, live] = nxt
            inside = nxt < size
            before[nxt[inside], live[inside]] = p[inside]
            put(gone, live, np.full(len(live), NONE))
            right = np.where(inside, ids[np.minimum(nxt, size - 1), live], -1)
            r = self.pair_ranks(rank, right)
            put(p, live, np.where(r < NONE, r * SHORT + p, NONE))
            has = before[p, live] >= 0
            q, col = before[p, live][has], live[has]
            if len(q):
                r = self.pair_ranks(ids[q, col], rank[has])
                put(q, col, np.where(r < NONE, r * SHORT + q, NONE))
            live = live[tree[1, live] < NONE]
        by_piece = ids.T
        keep = by_piece >= 0
        return by_piece[keep], keep.sum(1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and where each piece's ids start in it and how many they are."""
        starts, lens = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        groups: dict[int, list[int]] = {8: [], 16: [], SHORT: []}
        parts, total = [], 0

        def add(where, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal total
            lens[where] = counts
            starts[where] = total + np.cumsum(counts) - counts
            parts.append(ids)
            total += len(ids)

        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                add([i], np.array([r]), np.array([1]))
            elif len(p) > SHORT:
                ids = np.array(self.encode_long(p))
                add([i], ids, np.array([len(ids)]))
            else:
                groups[8 if len(p) <= 8 else 16 if len(p) <= 16 else SHORT].append(i)
        for some in groups.values():
            for a in range(0, len(some), 8192):
                part = some[a : a + 8192]
                add(part, *self.encode_short([pieces[i] for i in part]))
        return np.concatenate(parts) if parts else np.empty(0, np.int64), starts, lens

    def encode_one(self, pieces: list[str]) -> np.ndarray:
        return gather(*self.encode_pieces([p.encode() for p in pieces]))


class Encoder:
    """Texts -> ids. Chunks between isolated spaces and line ends are encoded once and remembered."""

    def __init__(self, vocabulary_path: str, pattern: str) -> None:
        self.vocabulary = Vocabulary(vocabulary_path)
        self.findall = regex.compile(pattern).findall
        #: A chunk without ids can't stand alone.
        self.chunks, self.pieces = Slices(REMEMBERED), Slices(REMEMBERED)

    def learn(self) -> None:
        """Encode the chunks not seen before.

        A chunk stands behind a space, which its first piece takes along, unless it begins with a line
        end; a chunk that begins a text is kept with a mark before it. White space at the edge of a chunk
        touches other white space, so the texts that hold such a chunk are split as a whole.
        """
        found = []
        for chunk in self.chunks.fresh():
            body = chunk[1:] if chunk[:1] in ("\0", "\n") else chunk
            odd = not body or body[0].isspace() or body[-1].isspace()
            found.append(() if odd else self.findall(body if chunk[0] == "\0" else chunk if chunk[0] == "\n" else " " + chunk))
        self.pieces.renew()
        at = self.pieces.table.numbers([p for x in found for p in x])
        new = self.pieces.fresh()
        ids, starts, lens = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.pieces.add(gather(ids, starts, lens), lens)
        self.pieces.noted(at)
        ends = np.concatenate([[0], np.cumsum(self.pieces.len.view()[at])])[np.cumsum([0, *map(len, found)])]
        self.chunks.add(self.pieces.of(at), np.diff(ends))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.chunks.renew()
        numbers = [None if "\0" in t else self.chunks.table.numbers(("\0" + t.replace("\n", " \n")).split(" ")) for t in texts]
        if self.chunks.table.fresh:
            self.learn()
        known = [at for at in numbers if at is not None]
        if known:
            self.chunks.noted(np.concatenate(known))
        lens = self.chunks.len.view()
        return [self.vocabulary.encode_one(self.findall(t)) if at is None or not lens[at].all() else self.chunks.of(at) for t, at in zip(texts, numbers, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def encode_column(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `ids` (array of int) and `decoded` (the bytes the ids stand for)."""
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{n}`") for n in keep], text_or_empty(f"`{text}`").alias(fresh("__text", list(keep))))
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keep) + ", ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = remembered(Encoder, vocabulary, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = enc.encode(part.column(len(keep)).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
                arrays = [*(part.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([enc.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "ids", "decoded"])

    return source.mapInArrow(run, schema)


def digest_column(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, decode, and keep digests: key, n_tokens, ids_sha256, decoded_sha256. One pass, no shuffle."""
    small_batches(df.sparkSession)
    source = df.select(key, text_or_empty(text).alias("__text"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = remembered(Encoder, vocabulary, pattern)
        names = [str(i) for i in range(enc.vocabulary.width)]
        for batch in batches:
            counts, spelled, decoded = [], [], []
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                for ids in enc.encode(texts[a : a + 256]):
                    listed = ids.tolist()
                    counts.append(len(listed))
                    spelled.append(hashlib.sha256(" ".join([names[i] for i in listed]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_column(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
