"""Cutting streams that arrive as windows: rows (stream_id, seq, window, is_last) in any split, for every profile.

The windows of a stream count from 0; the last is marked is_last. Each window is pushed through the profile's
stream (operators.push), whose state is bounded; a batch table and a streaming query use the same state. The
profile is named, or told by the first bytes, which are held back until they are enough to tell and then go
through the profile they chose; a named profile can be checked against them as well. A
window that comes before its turn waits for it, one that comes again is passed over, and a stream that ends
with a window missing says so. Once its profile has refused a stream, every later window gives an error row.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sediment.functions.probe import confirms, detect
from sediment.functions.profiles import GENERIC, PROBE_BYTES, Rejected, known
from sediment.operators import push

OUT = "profile string, ordinal long, start long, end long, length long, digest string, error string, pushed long"
NAMES = ["stream_id", "profile", "ordinal", "start", "end", "length", "digest", "error", "pushed"]
TYPES = [pa.string()] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]


class Feed:
    """One stream: what it has been fed, and what waits for its turn."""

    def __init__(self, profile: str | None, stream_id, checked: bool = False) -> None:
        self.profile, self.stream_id, self.checked = profile, stream_id, checked
        self.stream = None if profile is None or checked else push.opened(profile)
        self.head = b""
        self.next_seq, self.ordinal, self.rejected, self.over = 0, 0, False, False
        self.waiting: dict[int, tuple[bytes, bool]] = {}

    def error(self, detail: str) -> tuple:
        return (self.stream_id, self.profile, None, None, None, None, None, detail, self.next_seq)

    def probed(self) -> push.Stream:
        """The stream of the profile that the first bytes show, or of the named one if they don't gainsay it."""
        found = detect(self.head[:PROBE_BYTES])
        if self.profile is None:
            if len(found) > 1:
                raise Rejected(f"byte prefix matches several chunking profiles ({', '.join(found)}); declare a media type")
            self.profile = found[0] if found else GENERIC
        elif not confirms(found, self.profile):
            raise Rejected(f"declared chunking profile {self.profile} but the byte prefix is recognized as {', '.join(found)}")
        return push.opened(self.profile)

    def take(self, seq: int, window: bytes | None, last: bool) -> list[tuple]:
        """The rows that a window, and those that waited for it, make certain."""
        out: list[tuple] = []
        if seq >= self.next_seq and not self.over:
            self.waiting.setdefault(int(seq), (bytes(window or b""), bool(last)))
        while self.next_seq in self.waiting and not self.over:
            out += self.pushed(*self.waiting.pop(self.next_seq))
        return out

    def pushed(self, window: bytes, last: bool) -> list[tuple]:
        self.next_seq, self.over = self.next_seq + 1, last
        if self.rejected:
            return [self.error(f"chunking profile {self.profile} already rejected this stream")]
        try:
            if self.stream is None:
                self.head += window
                if len(self.head) < PROBE_BYTES and not last:
                    return []
                self.stream, window, self.head = self.probed(), self.head, b""
            found = self.stream.push(window, last)
        except Rejected as e:
            self.rejected, self.stream = True, None
            return [self.error(e.detail)]
        out = []
        for start, data in found:
            out.append((self.stream_id, self.profile, self.ordinal, start, start + len(data), len(data), hashlib.sha256(data).hexdigest(), None, self.next_seq))
            self.ordinal += 1
        return out

    def ended(self) -> list[tuple]:
        """What there is to say when no more windows will come."""
        return [self.error(f"window {self.next_seq} is missing")] if self.waiting and not self.over else []


def chunk_windows(windows: DataFrame, profile: str | None = GENERIC, checked: bool = False) -> DataFrame:
    """A streaming or batch table of windows -> chunk rows, with the number of windows pushed when each was certain. stream_id is of any type.

    profile: a name, or None for what the first bytes show; checked: refuse streams whose first bytes gainsay the name.
    """
    if profile is not None:
        known(profile)
    schema = f"stream_id {windows.schema['stream_id'].dataType.simpleString()}, {OUT}"
    source = windows.select("stream_id", F.col("seq").cast("long").alias("seq"), "window", "is_last")
    if windows.isStreaming:

        def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            feed = pickle.loads(state.get[0]) if state.exists else Feed(profile, key[0], checked)
            rows: list[tuple] = []
            for frame in frames:
                for seq, window, last in frame.sort_values("seq")[["seq", "window", "is_last"]].itertuples(index=False):
                    rows += feed.take(seq, window, last)
            if feed.over:
                state.remove()
            else:
                state.update((pickle.dumps(feed),))
            yield pd.DataFrame(rows, columns=NAMES).astype({n: "Int64" for n in (*NAMES[2:6], "pushed")})

        return source.groupBy("stream_id").applyInPandasWithState(step, schema, "feed binary", "append", GroupStateTimeout.NoTimeout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed: Feed | None = None
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for i, (stream_id, seq, last) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if feed is None or stream_id != feed.stream_id:
                    rows += feed.ended() if feed else []
                    feed = Feed(profile, stream_id, checked)
                rows += feed.take(seq, batch.column(2)[i].as_py(), last)
            yield made(kind, rows)
        if feed and (rows := feed.ended()):
            yield made(kind, rows)

    # a task goes through its streams window by window: it holds one stream's state, not the stream
    return source.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, schema)


def made(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([kind, *TYPES])], names=NAMES)


def windows_of(df: DataFrame, stream_id: str, content: str, size: int) -> DataFrame:
    """Values as windows of `size` bytes: what a feed of them would carry."""
    data = F.col(f"`{content}`")
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return df.select(F.col(f"`{stream_id}`").alias("stream_id"), data.alias("d"), count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("seq")).select("stream_id", F.col("seq").cast("long").alias("seq"), F.substr("d", F.col("seq") * size + 1, F.lit(size)).alias("window"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
