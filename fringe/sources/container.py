"""Tagged binary containers: files of chunks, each with a tag, a payload and a CRC-32C.

A file is read as bytes by Spark's ``binaryFile`` source and cut into one row for each chunk, so many
files spread over the cluster. The rows are the index: a chunk is looked up by filtering them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
HEADER_BYTES, NAME_BYTES, TAG_BYTES, VERSION = 64, 9, 20, 2
TAG = "<BBBBBBBBiq"  # 'T', 0x40 + version, 'G', element size, flags, data type, group, tag, user index, block size
CRC_FLAG, EXTENDED_FLAG, BIG_ENDIAN_FLAG = 0x40, 0x80, 0x20
CHAR, INT, SINGLE, DOUBLE, COMPLEX, MATRIX = 0x01, 0x02, 0x04, 0x08, 0x20, 0x40
CRC_POLYNOMIAL = 0x82F63B78

SCHEMA = "path string, chunk int, extended boolean, data_type int, group_id int, tag_id int, group_name string, tag_name string, user_index int, size long, crc_ok boolean, payload binary, problem string"


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC_POLYNOMIAL), table >> 1)
    return table


@cache
def _zeros_table(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of a checksum's state: tables (4, 256) for its bytes, as the step is linear."""
    if length == 1:
        states = np.uint32(1) << np.arange(32, dtype=np.uint32)
        bits = (states >> np.uint32(8)) ^ _crc_table()[states & np.uint32(255)]
    else:
        half = _zeros_table(length // 2)
        bits = _through(half, _through(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
        if length % 2:
            bits = _through(_zeros_table(1), bits)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            out[k] ^= np.where(np.arange(256) >> i & 1, bits[8 * k + i], np.uint32(0))
    return out


def _through(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    return table[0][states & 255] ^ table[1][states >> 8 & 255] ^ table[2][states >> 16 & 255] ^ table[3][states >> 24]


#: Pieces of a payload whose checksums run side by side.
LANES = 512


def crc32c(data: bytes, start: int = 0) -> int:
    """The CRC-32C (Castagnoli) of bytes, going on from ``start``.

    Long data is cut into pieces whose states go on together, byte by byte; a tree of steps then puts them one behind the other.
    """
    table = _crc_table()
    state = start ^ 0xFFFFFFFF
    length = len(data) // LANES
    if length >= 16:
        pieces = np.ascontiguousarray(np.frombuffer(data, np.uint8, LANES * length).reshape(LANES, length).T)
        states = np.zeros(LANES, np.uint32)
        states[0] = state
        for row in pieces:
            states = (states >> np.uint32(8)) ^ table[(states ^ row) & np.uint32(255)]
        while len(states) > 1:
            states = _through(_zeros_table(length), states[::2]) ^ states[1::2]
            length *= 2
        state, data = int(states[0]), data[LANES * (len(data) // LANES) :]
    plain = table.tolist()
    for byte in data:
        state = plain[(state ^ byte) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def element_type(data_type: int) -> np.dtype | None:
    """The little-endian numpy type of a payload's elements, which is how chunks are given out; null for characters."""
    base = {INT: np.dtype("<i4"), SINGLE: np.dtype("<f4"), DOUBLE: np.dtype("<f8")}.get(data_type & 0x0F)
    if base is not None and data_type & COMPLEX:
        base = np.dtype("<c8" if base == np.dtype("<f4") else "<c16")
    return base


def element_bytes(data_type: int) -> int:
    base = {CHAR: 1, INT: 4, SINGLE: 4, DOUBLE: 8}[data_type & 0x0F]
    return base * (2 if data_type & COMPLEX else 1) * (4 if data_type & MATRIX else 1)


def _swapped(payload: bytes, data_type: int) -> bytes:
    """A payload's numbers in the other byte order; characters and what is left of a number stay."""
    size = {INT: 4, SINGLE: 4, DOUBLE: 8}.get(data_type & 0x0F, 1)
    whole = len(payload) // size * size
    return np.frombuffer(payload[:whole], f"u{size}").byteswap().tobytes() + payload[whole:]


def file_header(name: bytes = b"") -> bytes:
    """The start of a file; ``name`` is the format's name."""
    return name.ljust(NAME_BYTES, b"\0")[:NAME_BYTES] + bytes([VERSION]) + bytes(HEADER_BYTES - NAME_BYTES - 1)


def encode_chunk(group: int | str, tag: int | str, index: int, data_type: int, payload: bytes, big_endian: bool = False) -> bytes:
    """A chunk's bytes; text names make an extended tag. With ``big_endian`` the little-endian payload is swapped and the chunk marked so."""
    extended = isinstance(group, str)
    names = group.encode() + b"\0" + tag.encode() + b"\0" if extended else b""
    ids = (len(group.encode()) + 1, len(tag.encode()) + 1) if extended else (group, tag)
    flags = CRC_FLAG | (EXTENDED_FLAG if extended else 0) | (BIG_ENDIAN_FLAG if big_endian else 0)
    payload = _swapped(payload, data_type) if big_endian else payload
    body = struct.pack(TAG, ord("T"), 0x40 + VERSION, ord("G"), element_bytes(data_type), flags, data_type, *ids, index, len(names) + len(payload) + 4) + names + payload
    return body + struct.pack("<I", crc32c(body))


def encode(chunks: Sequence[tuple[int | str, int | str, int, int, bytes]], name: bytes = b"", big_endian: bool = False) -> bytes:
    """A file of (group, tag, user index, data type, payload), as ``encode_chunk`` takes them."""
    return file_header(name) + b"".join(encode_chunk(*c, big_endian=big_endian) for c in chunks)


def header(data: bytes) -> dict[str, object]:
    """Name and version at the start of a file."""
    return {"name": data[:NAME_BYTES].rstrip(b"\0").decode("ascii", "replace"), "version": data[NAME_BYTES] if len(data) > NAME_BYTES else None}


def _chunks(path: str, data: bytes, check: bool) -> Iterator[tuple]:
    """The chunks of a file; where no tag follows, one row with the problem ends it. Fewer bytes than a tag at the end are left alone."""
    at, number = HEADER_BYTES, 0
    if 0 < len(data) < HEADER_BYTES:
        yield path, 0, *[None] * 9, None, f"a file of {len(data)} bytes holds no header"
    while at + TAG_BYTES <= len(data):
        t, _, g, _, flags, data_type, group, tag, index, block = struct.unpack_from(TAG, data, at)
        if (t, g) != (ord("T"), ord("G")) or flags & 0x1F or block < 0:
            yield path, number, *[None] * 9, None, f"no tag at byte {at}"
            return
        extended, has_crc = bool(flags & EXTENDED_FLAG), bool(flags & CRC_FLAG)
        body = data[at + TAG_BYTES : at + TAG_BYTES + block]
        names = group + tag if extended else 0
        payload = body[names : block - (4 if has_crc else 0)]
        ok = None
        if check and has_crc:
            ok = len(body) == block and crc32c(body[:-4], crc32c(data[at : at + TAG_BYTES])) == struct.unpack("<I", body[-4:])[0]
        problem = None if len(body) == block else f"chunk of {block} bytes is cut short to {len(body)}"
        text = [body[:group].rstrip(b"\0").decode("utf-8", "replace"), body[group:names].rstrip(b"\0").decode("utf-8", "replace")] if extended else [None, None]
        given = _swapped(bytes(payload), data_type) if flags & BIG_ENDIAN_FLAG else bytes(payload)
        yield path, number, extended, data_type, None if extended else group, None if extended else tag, *text, index, len(payload), ok, given, problem
        at += TAG_BYTES + block
        number += 1


_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
#: Bytes of payloads in a batch of chunks.
BATCH_BYTES = 16 << 20


def chunks_of(files: DataFrame, check_crc: bool = True) -> DataFrame:
    """A row for each chunk of files given as (path, content); a damaged file's last row has a ``problem``. A null or empty file holds none."""
    kinds = {part.split()[0]: _KINDS[part.split()[1]] for part in SCHEMA.split(", ")}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files_ in batches:
            for name, data in zip(files_.column("path"), files_.column("content"), strict=True):
                rows, held = [], 0
                for chunk in _chunks(name.as_py(), data.as_py() or b"", check_crc):
                    rows.append(chunk)
                    held += chunk[9] or 0
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_container(spark: SparkSession, path: str, check_crc: bool = True) -> DataFrame:
    """A row for each chunk of the files at ``path``."""
    return chunks_of(spark.read.format("binaryFile").load(path), check_crc)


def find(index: DataFrame, group: int | str, tag: int | str, user_index: int, data_type: int = 0, start: int = 0) -> DataFrame:
    """The first chunk from ``start`` on with this tag; any type for 0. No row where there is none."""
    ids = (F.col("group_name") == group) & (F.col("tag_name") == tag) if isinstance(group, str) else (F.col("group_id") == group) & (F.col("tag_id") == tag)
    met = index.where(ids & (F.col("user_index") == user_index) & (F.col("chunk") >= start))
    return (met.where(F.col("data_type") == data_type) if data_type else met).orderBy("chunk").limit(1)


def find_each(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row of ``wanted`` the first chunk with its tag, by one join: ``wanted`` has ``group_id, tag_id`` or ``group_name, tag_name``, and ``user_index``, and may have ``data_type`` and ``start``.

    Rows without such a chunk have no result; null and 0 stand for any type.
    """
    keys = [c for c in ("group_id", "tag_id", "group_name", "tag_name", "user_index") if c in wanted.columns]
    asked = wanted.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(f"wanted_{c}") if c in wanted.columns else F.lit(0).alias(f"wanted_{c}") for c in ("data_type", "start")]).distinct()
    met = index.join(asked, keys).where("(wanted_data_type = 0 or data_type = wanted_data_type) and chunk >= wanted_start")
    first = met.groupBy(*keys, "wanted_data_type", "wanted_start").agg(F.min_by(F.struct(*index.columns), F.struct("chunk", "path")).alias("found"))
    return first.select("found.*")


def values(payload: Column, data_type: int) -> Column:
    """A payload's elements as an array of doubles (real and imaginary parts in turn for complex ones)."""
    kind = element_type(data_type)

    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else (np.frombuffer(b, kind).view(kind.type(0).real.dtype) if kind.kind == "c" else np.frombuffer(b, kind)).astype(float))

    return run(payload)
