"""Rebuilding containers in one canonical form: no clocks, owners or compression choices of the source."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sediment.operators.office import Entry, descriptor, directory, local_header

# Fixed values of the canonical forms.
BLOCK = 512
FILE_MODE, DIRECTORY_MODE = 0o644, 0o755
PAX_NAME, NAME_BYTES = b"@PaxHeader", 100
GZIP_HEADER = bytes.fromhex("1f8b08000000000000ff")
GZIP_LEVEL = 6
#: (kind, path, body or link target)
Entries = tuple[str, bytes, bytes]
TAR_FLAGS = {"directory": b"5", "symlink": b"2", "hardlink": b"1", "member": b"0"}


def _tar_block(path: bytes, size: int, mode: int, flag: bytes, link: bytes) -> bytes:
    octal = lambda value, width: b"%0*o\0" % (width - 1, value)
    head = path[:NAME_BYTES].ljust(NAME_BYTES, b"\0") + octal(mode, 8) + octal(0, 8) * 2 + octal(size, 12) + octal(0, 12)
    rest = flag + link[:NAME_BYTES].ljust(NAME_BYTES, b"\0") + b"ustar\0" + b"00"
    unsummed = (head + b" " * 8 + rest).ljust(BLOCK, b"\0")
    return unsummed[:148] + b"%06o\0 " % sum(unsummed) + unsummed[156:]


def _pax(key: bytes, value: bytes) -> bytes:
    body = b" %s=%s\n" % (key, value)
    size = len(body)
    while len(str(size)) + len(body) != size:
        size = len(str(size)) + len(body)
    return b"%d" % size + body


def _filled(body: bytes) -> bytes:
    return body + bytes(-len(body) % BLOCK)


def tar_pieces(entries: Iterable[Entries]) -> Iterator[bytes]:
    """A piece an entry and the end. Long names go to a record of their own before the entry."""
    for kind, path, body in entries:
        link = body if kind in ("symlink", "hardlink") else b""
        long = b"".join(_pax(k, v) for k, v in ((b"path", path), (b"linkpath", link)) if len(v) > NAME_BYTES)
        before = _tar_block(PAX_NAME, len(long), FILE_MODE, b"x", b"") + _filled(long) if long else b""
        size = len(body) if kind == "member" else 0
        flag = TAR_FLAGS.get(kind) or body  # another kind carries its own flag
        block = _tar_block(path, size, DIRECTORY_MODE if kind == "directory" else FILE_MODE, flag, link)
        yield before + block + (_filled(body) if size else b"")
    yield bytes(2 * BLOCK)


def tar(entries: list[Entries]) -> bytes:
    """entries: (kind, path, body or link target) in order."""
    return b"".join(tar_pieces(entries))


def is_utf8(name: bytes) -> bool:
    try:
        name.decode()
    except UnicodeDecodeError:
        return False
    return True


def zip_pieces(entries: Iterable[Entries]) -> Iterator[bytes]:
    """A piece an entry and the directory; members are stored behind a header that leaves the sizes to a descriptor."""
    listed, at = [], 0
    for kind, path, body in entries:
        if kind == "directory":
            path, body = path if path.endswith(b"/") else path + b"/", b""
        crc, utf8 = zlib.crc32(body), is_utf8(path)
        piece = local_header(path, utf8) + body + descriptor(crc, len(body))
        listed.append(Entry(path, utf8, crc, len(body), at, True))
        at += len(piece)
        yield piece
    yield directory(listed, at)


def zip_(entries: list[Entries]) -> bytes:
    """entries: (kind, path, body)."""
    return b"".join(zip_pieces(entries))


def gzip_pieces(bodies: Iterable[bytes]) -> Iterator[bytes]:
    """One member without name or time, from its bytes in pieces."""
    packer, crc, size = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, -15), 0, 0
    yield GZIP_HEADER
    for body in bodies:
        crc, size = zlib.crc32(body, crc), size + len(body)
        yield packer.compress(body)
    yield packer.flush() + struct.pack("<II", crc, size & 0xFFFFFFFF)


def gzip(body: bytes) -> bytes:
    return b"".join(gzip_pieces([body]))


def containers(entries: DataFrame, kind: str) -> DataFrame:
    """(container, seq, data): each container rebuilt as `kind` (tar, zip or gzip); its pieces in order of seq are its bytes.

    entries: (container, ordinal, kind, path, content), in order of ordinal; a link's content is its target. A
    task holds an entry at a time. gzip joins the contents of a container's members to one.
    """
    make = {"tar": tar_pieces, "zip": zip_pieces, "gzip": lambda found: gzip_pieces(body for _, _, body in found)}[kind]
    id_kind = entries.schema["container"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c) for c in range(4)]
                for i in range(batch.num_rows):
                    key, what, path, body = (c[i].as_py() for c in columns)
                    yield key, (what, bytes(path or b""), body or b"")

        for key, found in itertools.groupby(flat(), key=lambda r: r[0]):
            for seq, piece in enumerate(make(e for _, e in found)):
                yield pa.RecordBatch.from_pydict({"container": [key], "seq": [seq], "data": [piece]}, schema=pa.schema([("container", types), ("seq", pa.int64()), ("data", pa.binary())]))

    types = to_arrow_type(entries.schema["container"].dataType)
    sorted_ = entries.repartition("container").sortWithinPartitions("container", "ordinal")
    source = sorted_.select("container", "kind", F.col("path").cast("binary").alias("path"), F.col("content").cast("binary").alias("content"))
    return source.mapInArrow(run, f"container {id_kind}, seq long, data binary")
