"""Streams put together from the values of a table, cut by many tasks in bounded memory.

A stream is the values of one key in order, joined by line ends; it is cut under the generic or the text profile.
Beyond the reach of the rolling hash a value's cut candidates depend on itself alone, so each value is hashed
where it lies. To the stream's task goes a short row a value: its length, its candidates, the bytes at its two
ends, and under the text profile which of its bytes go on a scalar, packed; there the candidates near the ends are
added and the cuts chosen, with the rows of the open chunk in memory. The values themselves are not moved, unless
digests are asked for: then their pieces go to the chunks they lie in, and a task hashes chunk by chunk. No
task holds a stream.

Values without an order come last; the row tells values of one order apart. A null value is empty, a null key is a
stream of its own, a stream without a byte has no row.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.gear import low_cuts
from sediment.functions.profiles import GENERIC, GENERIC_MASKS, MAX_CHUNK, TEXT
from sediment.operators.api import few
from sediment.operators.content import text_cuts, text_end
from sediment.operators.cuts import next_cut

#: Bytes before a position that its hash looks at, as far as the profile asks.
REACH = {GENERIC: 31, TEXT: 63}
NO_CUTS = np.empty(0, np.int64)
CHUNKS = [("ordinal", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("length", pa.int64())]
PIECES = [*CHUNKS, ("place", pa.int64()), ("led", pa.bool_()), ("skip", pa.int64()), ("take", pa.int64()), ("file", pa.int64()), ("row", pa.int64())]


def candidates(body: np.ndarray, profile: str) -> tuple[np.ndarray, np.ndarray]:
    return text_cuts(body) if profile == TEXT else low_cuts(body, profile, GENERIC_MASKS)


def listed(at: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list a row: values[i] belongs to row at[i], in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]), pa.int32()), pa.array(values, pa.int64()))


def sketched(values: list[bytes], profile: str) -> list[pa.Array]:
    """(n, edge, strict, relaxed, inner) of each value: all of it that its stream's cuts depend on."""
    reach, body = REACH[profile], np.frombuffer(b"".join(values), np.uint8)
    lens = np.fromiter(map(len, values), np.int64, len(values))
    starts = np.cumsum(lens) - lens

    def own(ends: np.ndarray) -> pa.Array:
        at = np.searchsorted(starts, ends - 1, "right") - 1
        local = ends - starts[at]
        far = local > reach
        return listed(at[far], local[far], len(values))

    cuts = [own(ends) for ends in candidates(body, profile)]
    inner: list[bytes | None] = [None] * len(values)
    if profile == TEXT:
        going_on = body & 0xC0 == 0x80
        at = np.searchsorted(starts, np.flatnonzero(going_on), "right") - 1
        for i in np.unique(at).tolist():
            inner[i] = zlib.compress(np.packbits(going_on[starts[i] : starts[i] + lens[i]]).tobytes(), 1)
    edges = [v if len(v) <= 2 * reach else v[:reach] + v[-reach:] for v in values]
    return [pa.array(lens, pa.int64()), pa.array(edges, pa.binary()), *cuts, pa.array(inner, pa.binary())]


class Joined:
    """One stream: the bytes its next hash looks at, the candidates and the values of the open chunk."""

    def __init__(self, name: str | None, profile: str) -> None:
        self.name, self.profile, self.reach = name, profile, REACH[profile]
        self.carry, self.begun, self.total = b"", False, 0
        self.start, self.ordinal = 0, 0
        self.strict = self.relaxed = NO_CUTS
        #: Of each value in the open chunk: where its line end stands, where it begins and ends, inner, file, row.
        self.values: list[tuple] = []
        self.unpacked: tuple = (None, b"")

    def take(self, batch: pa.RecordBatch) -> None:
        """The next values of the stream: file, row, n, edge, strict, relaxed, inner."""
        lens, edges = batch.column("n").to_numpy(), batch.column("edge").to_pylist()
        led = np.ones(len(lens), np.int64)
        led[0] = self.begun
        begins = self.total + np.cumsum(lens + led) - lens - led
        near = self.carry + (b"\n" if self.begun else b"") + b"\n".join(edges)
        blocks = np.fromiter(map(len, edges), np.int64, len(edges)) + led
        first = len(self.carry) + np.cumsum(blocks) - blocks
        known = led + np.minimum(lens, self.reach)

        def placed(ends: np.ndarray, own: pa.Array) -> np.ndarray:
            at = np.searchsorted(first, ends - 1, "right") - 1
            local = ends - first[at]
            keep = (at >= 0) & (local <= known[at])
            far = own.flatten().to_numpy() + np.repeat(begins + led, np.diff(own.offsets.to_numpy()))
            return np.sort(np.concatenate([begins[at[keep]] + local[keep], far]))

        strict, relaxed = candidates(np.frombuffer(near, np.uint8), self.profile)
        self.strict = np.concatenate([self.strict, placed(strict, batch.column("strict"))])
        self.relaxed = np.concatenate([self.relaxed, placed(relaxed, batch.column("relaxed"))])
        self.values += zip(begins.tolist(), (begins + led).tolist(), (begins + led + lens).tolist(), *(batch.column(c).to_pylist() for c in ("inner", "file", "row")), strict=True)
        self.total += int((lens + led).sum())
        self.carry, self.begun = near[-self.reach :], True

    def goes_on(self, place: int) -> bool:
        """Whether the byte at `place` goes on a scalar."""
        value = self.values[bisect_right(self.values, place, key=lambda v: v[0]) - 1]
        if value[3] is None or place < value[1]:
            return False
        if self.unpacked[0] is not value:
            self.unpacked = value, zlib.decompress(value[3])
        k = place - value[1]
        return bool(self.unpacked[1][k >> 3] >> (7 - (k & 7)) & 1)

    def next_end(self, final: bool) -> int | None:
        """The end of the open chunk, if it is sure."""
        rest = self.total if final else None
        if self.profile == GENERIC:
            end = next_cut(self.strict, self.relaxed, self.start, self.start)
            return end if end <= self.total else rest
        end = text_end(self.strict, self.relaxed, self.start)
        if end is None:
            end = self.start + MAX_CHUNK
            if end >= self.total:
                return rest
            while self.goes_on(end):
                end -= 1
        return end

    def chosen(self, final: bool, pieces: bool) -> list[tuple]:
        """A row for each chunk that is sure now, or for each piece of a value in it."""
        out, k = [], 0
        while self.start < self.total and (end := self.next_end(final)) is not None:
            chunk = (self.ordinal, self.start, end, end - self.start)
            if not pieces:
                out.append(chunk)
            while k < len(self.values) and self.values[k][2] <= self.start:
                k += 1
            while pieces and k < len(self.values):
                begin, body, stop, _, file, row = self.values[k]
                lo, hi = max(begin, self.start), min(stop, end)
                if lo < hi:
                    out.append((*chunk, lo, body > begin, lo - begin, hi - lo, file, row))
                if stop > end:
                    break
                k += 1
            self.ordinal, self.start = self.ordinal + 1, end
        self.strict, self.relaxed = (c[np.searchsorted(c, self.start, "right") :] for c in (self.strict, self.relaxed))
        self.values = [v for v in self.values if v[2] > self.start]
        return out


def _rows(stream_id: pa.DataType, names: list, rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, stream_id), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields))], names=["stream_id", *(n for n, _ in fields)])


def _ddl(stream_id: str, fields: list) -> str:
    return ", ".join([f"stream_id {stream_id}", *(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in fields)])


def chunk_joined(docs: DataFrame, by: str, order: str, value: Column, profile: str, digest: bool = True, keep_first: bool = True) -> DataFrame:
    """(stream_id, ordinal, start, end, length, [digest]) of the streams of `by`: values in order, joined by line ends.

    docs has the columns file and row (long), which name each of its rows; value is binary. Without keep_first the
    values of a stream's least order, and those without an order, are left out.
    """
    few(docs)
    kind, ordered = docs.schema[by].dataType.simpleString(), docs.schema[order].dataType.simpleString()
    source = docs.select(F.col(f"`{by}`").alias("stream_id"), F.col(f"`{order}`").alias("at"), "file", "row", F.coalesce(value, F.lit(b"")).alias("value"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *sketched(batch.column(4).to_pylist(), profile)], names=["stream_id", "at", "file", "row", "n", "edge", "strict", "relaxed", "inner"])

    rows = source.mapInArrow(sketches, f"stream_id {kind}, at {ordered}, file long, row long, n long, edge binary, strict array<long>, relaxed array<long>, inner binary")
    rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", F.col("at").asc_nulls_last(), "file", "row")
    fields = PIECES if digest else CHUNKS

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream: Joined | None = None
        least = named = None
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.schema.field(0).type
            names, at, out, told = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []

            def say(found: list[tuple]) -> None:
                out.extend(found)  # noqa: B023
                told.extend([stream.name] * len(found))  # noqa: B023

            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if stream is None or stream.name != names[a]:
                    if stream is not None:
                        say(stream.chosen(True, digest))
                    stream, least = Joined(names[a], profile), at[a]
                part = batch.slice(a, b - a)
                if not keep_first:
                    part = part.filter(pa.array([x is not None and x != least for x in at[a:b]]))
                if part.num_rows:
                    stream.take(part)
                    say(stream.chosen(False, digest))
            yield _rows(named, told, out, fields)
        if stream is not None and (found := stream.chosen(True, digest)):
            yield _rows(named, [stream.name] * len(found), found, fields)

    chosen = rows.mapInArrow(choose, _ddl(kind, fields))
    if not digest:
        return chosen
    body = F.when(F.col("led"), F.concat(F.lit(b"\n"), F.col("value"))).otherwise(F.col("value"))
    # each piece goes to the value's row, which isn't sorted for it, and with its bytes to its chunk
    pieces = source.select("file", "row", "value").join(chosen.hint("shuffle_hash"), ["file", "row"])
    pieces = pieces.select("stream_id", *(n for n, _ in CHUNKS), "place", F.substring(body, F.col("skip").cast("int") + 1, F.col("take").cast("int")).alias("data"))
    pieces = pieces.repartition("stream_id", "ordinal").sortWithinPartitions("stream_id", "ordinal", "place")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [*CHUNKS, ("digest", pa.string())]
        chunk, running, named = None, None, None
        for batch in batches:
            out, named = [], batch.schema.field(0).type
            for *now, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != chunk:
                    out += [(*chunk, running.hexdigest())] if chunk else []
                    chunk, running = now, hashlib.sha256()
                running.update(data)
            yield _rows(named, [r[0] for r in out], [r[1:] for r in out], told)
        if chunk:
            yield _rows(named, [chunk[0]], [(*chunk[1:], running.hexdigest())], told)

    return pieces.mapInArrow(hashed, f"{_ddl(kind, CHUNKS)}, digest string")
