"""Tagged binary containers by byte ranges, visibility blocks as rows, and a sink that commits, as data sources.

``register(spark)`` makes two formats known:

- ``container``: a row for each chunk (``SCHEMA``). Tags are read one by one, skipping over payloads; with equality
  filters on tags, names, user index or type (pushed down with ``spark.sql.python.filterPushdown.enabled``) only
  the payloads that fit are read, and none with ``payload=false``. Writing takes ``data_type`` and ``payload``, ``group_id`` and
  ``tag_id`` or ``group_name`` and ``tag_name``, and ``user_index``, and makes files of about ``max_bytes`` each: chunks
  of one user index that follow one another stay in one file.
- ``visibility_blocks``: samples (``SAMPLE_SCHEMA``). The four payloads of a block (u, v, w and amplitudes) are read side by
  side, some times of a block at a time, so that a block is neither held as a whole nor shuffled.

A task has a file and a range of its bytes: the chunks whose tags begin there, or the runs of times whose
amplitudes do. What can't be read is a row with the problem. Checksums are verified by ``container`` (``crc_ok``) where a
payload is read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter
from pyspark.sql.types import StructType

from . import container
from .fits import arrow_of, problem_batch
from .fits_source import MAX_BYTES, SPLIT_BYTES, Piece, Written, pieces
from .store import Output, Ranges

SCHEMA = container.SCHEMA.replace(", problem string", ", place long, problem string")
SAMPLE_SCHEMA = "path string, block int, time int, channel int, baseline int, pol int, uu double, vv double, ww double, re double, im double, problem string"
#: Bytes of amplitudes that are read together, unless one time has more.
PIECE_BYTES = 4 << 20
# Fixed values of visibility files: the group of blocks, and tags in it.
BLOCK_GROUP = 12
DIMENSIONS, AMPLITUDES, U, V, W = 1, 3, 4, 5, 6
_ERRORS = (ValueError, KeyError, TypeError, OSError, struct.error)


@dataclass
class Tag:
    """A chunk's tag: its number and place in the file, what it says, and where its payload is."""

    chunk: int
    at: int
    extended: bool
    data_type: int
    group: int | str
    tag: int | str
    user_index: int
    place: int
    size: int
    has_crc: bool
    big_endian: bool

    def payload(self, file: Ranges) -> bytes:
        data = file.at(self.place, self.size)
        return container._swapped(data, self.data_type) if self.big_endian else data

    def values(self, file: Ranges, kind: np.dtype, first: int, count: int) -> np.ndarray:
        """``count`` elements of ``kind`` from ``first`` on, the others unread; ``ValueError`` beyond the payload."""
        if (first + count) * kind.itemsize > self.size:
            raise ValueError(f"chunk {self.chunk} holds {self.size} bytes, not {(first + count) * kind.itemsize}")
        return np.frombuffer(file.at(self.place + first * kind.itemsize, count * kind.itemsize), kind.newbyteorder(">" if self.big_endian else "<"))


def scan_tags(file: Ranges) -> Iterator[Tag]:
    """The tags of a file, of whose payloads not a byte is read; ``ValueError`` where no tag follows."""
    at, end, number = container.HEADER_BYTES, file.seek(0, 2), 0
    if 0 < end < container.HEADER_BYTES:
        raise ValueError(f"a file of {end} bytes holds no header")
    while at + container.TAG_BYTES <= end:
        t, _, g, _, flags, data_type, group, tag, index, block = struct.unpack(container.TAG, file.at(at, container.TAG_BYTES))
        if (t, g) != (ord("T"), ord("G")) or flags & 0x1F or block < 0:
            raise ValueError(f"no tag at byte {at}")
        place, extended, crc = at + container.TAG_BYTES, bool(flags & container.EXTENDED_FLAG), 4 if flags & container.CRC_FLAG else 0
        names = group + tag if extended else 0
        if extended:
            text = file.at(place, names)
            group, tag = text[:group].rstrip(b"\0").decode("utf-8", "replace"), text[group:].rstrip(b"\0").decode("utf-8", "replace")
        if place + block > end:
            raise ValueError(f"chunk of {block} bytes at byte {at} is cut short")
        yield Tag(number, at, extended, data_type, group, tag, index, place + names, block - names - crc, bool(crc), bool(flags & container.BIG_ENDIAN_FLAG))
        at, number = place + block, number + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[Piece]:
        return pieces(self.root, self.split_bytes)


class ChunkReader(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = ("group_id", "tag_id", "group_name", "tag_name", "user_index", "data_type")
        self.wanted = {f.attribute[0]: f.value for f in filters if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in names}
        yield from filters

    def fits(self, t: Tag) -> bool:
        own = {"user_index": t.user_index, "data_type": t.data_type} | ({"group_name": t.group, "tag_name": t.tag} if t.extended else {"group_id": t.group, "tag_id": t.tag})
        return all(own.get(k) == v for k, v in self.wanted.items())

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there are no files
            return
        schema = arrow_of(SCHEMA)
        rows: list[dict[str, object]] = []
        held = 0
        try:
            with Ranges(self.root, piece.path) as file:
                for t in scan_tags(file):
                    if t.at >= piece.stop:
                        break
                    if t.at < piece.start or not self.fits(t):
                        continue
                    rows.append(self.row(file, piece.path, t))
                    held += t.size if self.payload else 0
                    if held > container.BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
        except _ERRORS as problem:
            # Each range of a damaged file meets the damage; the first tells of it.
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            if piece.start == 0:
                yield problem_batch(schema, path=piece.path, problem=str(problem))

    def row(self, file: Ranges, path: str, t: Tag) -> dict[str, object]:
        ok = payload = None
        if self.payload:
            payload = t.payload(file)
            if t.has_crc:
                before = t.place - t.at
                ok = container.crc32c(file.at(t.at, before + t.size)) == struct.unpack("<I", file.at(t.place + t.size, 4))[0]
        names = {"group_name": t.group, "tag_name": t.tag} if t.extended else {"group_id": t.group, "tag_id": t.tag}
        return {"path": path, "chunk": t.chunk, "extended": t.extended, "data_type": t.data_type, "user_index": t.user_index, "size": t.size, "crc_ok": ok, "payload": payload, "place": t.place, **names}


class SampleReader(_Reader):
    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there are no files
            return
        schema = arrow_of(SAMPLE_SCHEMA)
        try:
            with Ranges(self.root, piece.path) as file:
                for number, chunks in sorted(self.blocks(file).items()):
                    try:
                        yield from self.samples(file, piece, number, chunks, schema)
                    except _ERRORS as problem:
                        if piece.start == 0:
                            yield problem_batch(schema, path=piece.path, block=number, problem=f"{type(problem).__name__}: {problem}")
        except _ERRORS as problem:
            if piece.start == 0:
                yield problem_batch(schema, path=piece.path, problem=f"{type(problem).__name__}: {problem}")

    def blocks(self, file: Ranges) -> dict[int, dict[int, Tag]]:
        """For each block its chunks by tag."""
        blocks: dict[int, dict[int, Tag]] = {}
        for t in scan_tags(file):
            if t.group == BLOCK_GROUP and t.tag in (DIMENSIONS, AMPLITUDES, U, V, W):
                blocks.setdefault(t.user_index, {})[t.tag] = t
        return blocks

    def samples(self, file: Ranges, piece: Piece, number: int, chunks: dict[int, Tag], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        start_time, start_channel, times, channels, baselines, _ = chunks[DIMENSIONS].values(file, np.dtype("<i4"), 0, 6).tolist()
        if lacking := [tag for tag in (AMPLITUDES, U, V, W) if tag not in chunks]:
            raise ValueError(f"no chunks {lacking}")
        if min(times, channels, baselines) <= 0:
            return
        amplitude, coordinate = chunks[AMPLITUDES].data_type, chunks[U].data_type
        pols = 4 if amplitude & container.MATRIX else 1
        kind, length = container.element_type(amplitude & ~container.MATRIX), container.element_type(coordinate)
        if kind is None or kind.kind != "c" or length is None or length.kind != "f":
            raise ValueError(f"types {amplitude} and {coordinate} of amplitudes and coordinates")
        of_time = channels * baselines * pols
        step = max(1, PIECE_BYTES // (of_time * kind.itemsize))
        for first in range(0, times, step):
            if not piece.start <= chunks[AMPLITUDES].place + first * of_time * kind.itemsize < piece.stop:
                continue
            n = min(step, times - first)
            values = chunks[AMPLITUDES].values(file, kind, first * of_time, n * of_time)
            shape = (n, channels, baselines, pols)
            spread = lambda x, axis: np.broadcast_to(x.reshape([-1 if i == axis else 1 for i in range(4)]), shape).ravel()
            lengths = [np.broadcast_to(chunks[c].values(file, length, first * baselines, n * baselines).reshape(n, 1, baselines, 1), shape).astype(float).ravel() for c in (U, V, W)]
            ids = [spread(np.arange(at, at + size, dtype=np.int32), i) for i, (at, size) in enumerate(((start_time + first, n), (start_channel, channels), (0, baselines), (0, pols)))]
            rows = values.size
            columns = [pa.repeat(pa.scalar(piece.path), rows), pa.repeat(pa.scalar(number, pa.int32()), rows), *map(pa.array, ids), *map(pa.array, lengths), pa.array(values.real.astype(float)), pa.array(values.imag.astype(float)), pa.nulls(rows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.output = Output(options["path"], overwrite)
        self.max_bytes, self.name = int(options.get("max_bytes", MAX_BYTES)), options.get("name", "").encode()
        names = set(schema.names)
        if not {"user_index", "data_type", "payload"} <= names or not ({"group_id", "tag_id"} <= names or {"group_name", "tag_name"} <= names):
            raise ValueError(f"no chunks in columns {sorted(names)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        chunks = ((r["user_index"], self.chunk(r)) for batch in iterator for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist())
        index, pending = next(chunks, (None, None))
        while pending is not None:
            with self.output.create(".bin") as (name, stream):
                stream.write(container.file_header(self.name))
                size, last = container.HEADER_BYTES, index
                # Chunks of one user index, as the parts of a block are, stay together.
                while pending is not None and (index == last or size + len(pending) <= self.max_bytes):
                    stream.write(pending)
                    size, last = size + len(pending), index
                    index, pending = next(chunks, (None, None))
            names.append(name)
        return Written(names)

    def chunk(self, r: dict) -> bytes:
        named = r.get("group_name") is not None
        return container.encode_chunk(r["group_name"] if named else r["group_id"], r["tag_name"] if named else r["tag_id"], r["user_index"], r["data_type"], bytes(r["payload"] or b""))

    def commit(self, messages: list[Written | None]) -> None:
        self.output.commit([name for m in messages if m for name in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        self.output.abort()


class Container(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options, schema, overwrite)


class VisibilityBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "visibility_blocks"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (Container, VisibilityBlocks):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
