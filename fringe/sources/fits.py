"""FITS files: headers, images and binary tables as DataFrames.

Here files are read as bytes by Spark's ``binaryFile`` source, one task for each file (of up to 2 GB), from any
store that Spark reads, and cut into header units; ``fits_source`` reads byte ranges instead. A table's schema comes
from the first file's header. Undefined values (TNULL, BLANK, NaN) are null; TSCAL and TZERO are applied. A
file that can't be read so (no such unit, damaged, other columns) is one row that says so in its problem column.
Files may be compressed with gzip.

A unit is named by its number from 0, as ``"image"`` or ``"table"`` (the first that holds one), or as ``"NAME"`` or
``"NAME,version"`` by its EXTNAME (in any case) and EXTVER.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK, CARD = 2880, 80
#: Pixel types by BITPIX, and column types by letter with the bytes of an element.
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMNS = {"L": ("S1", 1), "X": (">u1", 1), "B": (">u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "A": ("S", 1), "E": (">f4", 4), "D": (">f8", 8), "C": (">c8", 8), "M": (">c16", 16), "P": (">i4", 8), "Q": (">i8", 16)}
SPARK_TYPES = {"L": "boolean", "X": "string", "B": "short", "I": "short", "J": "int", "K": "long", "A": "string", "E": "float", "D": "double", "C": "struct<re:double,im:double>", "M": "struct<re:double,im:double>"}
HEADER_SCHEMA = "path string, hdu int, pos int, key string, value string, comment string"
PIXEL_SCHEMA = "path string, hdu int, plane int, y int, x int, value double, problem string"
#: Columns of a table besides its own.
ROW, PROBLEM, RAW, FILE = "_row", "_problem", "_raw", "_file"
OWN = (ROW, PROBLEM, RAW, FILE)
#: Values of a batch of rows.
BATCH_VALUES = 1 << 20


@dataclass
class Unit:
    """One header unit: its number, its cards (key, value, comment), where its data begins in the file, how long it is, and the data where it has been read."""

    cards: list[tuple[str, str, str]]
    data: bytes = b""
    number: int = 0
    start: int = 0
    size: int = 0

    def get(self, key: str, default=None):
        for k, v, _ in self.cards:
            if k == key:
                return _value(v)
        return default

    @property
    def axes(self) -> list[int]:
        return [int(self.get(f"NAXIS{i}")) for i in range(1, int(self.get("NAXIS", 0)) + 1)]

    @property
    def kind(self) -> str:
        """``image``, ``table``, ``ascii`` (a table of characters) or ``empty``."""
        extension = str(self.get("XTENSION", "IMAGE")).strip()
        return {"BINTABLE": "table", "A3DTABLE": "table", "TABLE": "ascii"}.get(extension, "image" if self.axes and all(self.axes) else "empty")

    @property
    def row_bytes(self) -> int:
        """Bytes of a table's row or an image's line."""
        return self.axes[0] * (1 if self.kind != "image" else abs(int(self.get("BITPIX"))) // 8)


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:].rsplit("'", 1)[0].replace("''", "'").rstrip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E"))
        except ValueError:
            continue
    return text


def _card(card: str) -> tuple[str, str, str]:
    key = card[:8].strip()
    if card[8:10] != "= ":
        return key, "", card[8:].strip()
    found = re.match(r"\s*('(?:[^']|'')*'|[^/]*)\s*(?:/(.*))?$", card[10:])
    return key, found[1].strip(), (found[2] or "").strip()


def scan(file: BinaryIO) -> Iterator[Unit]:
    """The header units of an open file; of their data not a byte is read."""
    at, number = 0, 0
    end = file.seek(0, io.SEEK_END)
    while at + BLOCK <= end:
        cards: list[tuple[str, str, str]] = []
        ended = False
        file.seek(at)
        while not ended and at + BLOCK <= end:
            text = file.read(BLOCK).decode("ascii", "replace")
            for i in range(0, BLOCK, CARD):
                card = _card(text[i : i + CARD])
                if card[0] == "END" and not card[1]:
                    ended = True
                    break
                if card[0] == "CONTINUE" and cards:  # a long string goes on
                    key, value, comment = cards[-1]
                    more = re.match(r"\s*'((?:[^']|'')*)'", text[i + 8 : i + CARD])
                    if more:
                        cards[-1] = (key, value.rstrip("'").rstrip("&") + more[1].rstrip("&") + "'", comment)
                    continue
                if card[0] or card[2]:
                    cards.append(card)
            at += BLOCK
        unit = Unit(cards, b"", number, at)
        unit.size = abs(int(unit.get("BITPIX", 8))) // 8 * int(unit.get("GCOUNT", 1)) * (int(unit.get("PCOUNT", 0)) + int(np.prod(unit.axes))) if unit.axes else 0
        at += -(-unit.size // BLOCK) * BLOCK
        yield unit
        number += 1


def plain_bytes(data: bytes) -> bytes:
    """A file's bytes, unpacked where they are compressed with gzip."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def units(data: bytes) -> Iterator[Unit]:
    """The header units of a file's bytes, with their data."""
    data = plain_bytes(data)
    for unit in scan(io.BytesIO(data)):
        unit.data = data[unit.start : unit.start + unit.size]
        yield unit


def choose(all_units: Iterator[Unit], hdu: int | str) -> Unit:
    """The unit that ``hdu`` names (module docstring); ``ValueError`` if there is none."""
    wanted = int(hdu) if isinstance(hdu, int) or str(hdu).lstrip("-").isdigit() else str(hdu)
    name, _, version = str(wanted).partition(",")
    for unit in all_units:
        if isinstance(wanted, int):
            found = unit.number == wanted
        elif wanted in ("image", "table"):
            found = unit.kind == wanted or (wanted == "table" and unit.kind == "ascii")
        else:
            own = str(unit.get("EXTNAME", unit.get("HDUNAME", ""))).strip()
            found = own.upper() == name.strip().upper() and (not version or int(unit.get("EXTVER", unit.get("HDUVER", 1))) == int(version))
        if found:
            return unit
    raise ValueError(f"no unit {hdu!r}")


def encode(header: Mapping[str, object], data: bytes = b"", primary: bool = True) -> bytes:
    """A header unit's bytes: cards in order and padded data."""
    first = [("SIMPLE", True)] if primary else []
    cards = []
    for key, value in [*first, *header.items()]:
        text = "T" if value is True else "F" if value is False else "'" + str(value).replace("'", "''").ljust(8) + "'" if isinstance(value, str) else repr(value)
        cards.append(f"{key:<8}= {text:>20}"[:CARD].ljust(CARD))
    head = "".join([*cards, "END".ljust(CARD)])
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode("ascii") + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def encode_image(pixels: np.ndarray, header: Mapping[str, object] | None = None, primary: bool = True) -> bytes:
    """An image of any dimension; numpy's last axis is the first of the file."""
    bitpix = next(b for b, kind in PIXELS.items() if np.dtype(kind) == pixels.dtype.newbyteorder(">") or np.dtype(kind).newbyteorder("=") == pixels.dtype)
    shape = {"BITPIX": bitpix, "NAXIS": pixels.ndim, **{f"NAXIS{i + 1}": int(n) for i, n in enumerate(pixels.shape[::-1])}}
    start = {} if primary else {"XTENSION": "IMAGE"}
    end = {} if primary else {"PCOUNT": 0, "GCOUNT": 1}
    return encode({**start, **shape, **end, **(header or {})}, pixels.astype(PIXELS[bitpix]).tobytes(), primary)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def headers_of(files: DataFrame) -> DataFrame:
    """Every card of every file, given as (path, content): ``path, hdu, pos, key, value, comment``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                found = scan(io.BytesIO(plain_bytes(bytes(content or b""))))
                yield pd.DataFrame([(name, unit.number, p, *card) for unit in found for p, card in enumerate(unit.cards, 1)], columns=["path", "hdu", "pos", "key", "value", "comment"])

    return files.select("path", "content").mapInPandas(run, HEADER_SCHEMA)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return headers_of(_files(spark, path))


def _with_nulls(values: np.ndarray, bad: np.ndarray | None) -> pa.Array:
    return pa.array(values, mask=bad if bad is not None and bad.any() else None)


def pixel_values(raw: np.ndarray, unit: Unit) -> pa.Array:
    """Raw pixels of an image as doubles, scaled, undefined ones null."""
    whole = raw.dtype.kind in "iu"
    blank = unit.get("BLANK") if whole else None
    bad = raw == blank if blank is not None else np.isnan(raw) if not whole else None
    return _with_nulls(raw.astype(float) * float(unit.get("BSCALE", 1.0)) + float(unit.get("BZERO", 0.0)), bad)


def image_shape(unit: Unit) -> tuple[int, int]:
    """Pixels of a line and lines of a plane."""
    if unit.kind != "image":
        raise ValueError(f"unit {unit.number} holds no image")
    return unit.axes[0], unit.axes[1] if len(unit.axes) > 1 else 1


def image_batch(path: str, unit: Unit, raw: np.ndarray, lines: np.ndarray, xs: np.ndarray) -> pa.RecordBatch:
    """Rows of ``PIXEL_SCHEMA`` of raw pixels (lines, xs); lines count from 0 over all planes."""
    n, height = raw.size, image_shape(unit)[1]
    each = lambda v: pa.array(np.repeat(v, len(xs)).astype(np.int32))
    columns = [pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(unit.number, pa.int32()), n), each(lines // height + 1), each(lines % height + 1), pa.array(np.tile(xs + 1, len(lines)).astype(np.int32)), pixel_values(raw.ravel(), unit), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "hdu", "plane", "y", "x", "value", "problem"])


def problem_batch(schema: pa.Schema, **values: object) -> pa.RecordBatch:
    """One row with these values and nulls."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


_PIXEL_ARROW = pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("plane", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("value", pa.float64()), ("problem", pa.string())])


def image_of(files: DataFrame, hdu: int | str = 0) -> DataFrame:
    """The pixels of an image or cube in each file: ``path, hdu, plane, y, x, value, problem``, all counted from 1; further axes run on in ``plane``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, content in zip(rows.column("path"), rows.column("content"), strict=True):
                try:
                    unit = choose(units(content.as_py() or b""), hdu)
                    width = image_shape(unit)[0]
                    raw = np.frombuffer(unit.data, PIXELS[int(unit.get("BITPIX"))]).reshape(-1, width)
                    step = max(1, BATCH_VALUES // width)
                    for at in range(0, len(raw), step):
                        part = raw[at : at + step]
                        yield image_batch(name.as_py(), unit, part, np.arange(at, at + len(part)), np.arange(width))
                except (ValueError, KeyError, TypeError, OSError, EOFError) as problem:
                    yield problem_batch(_PIXEL_ARROW, path=name.as_py(), problem=str(problem))

    return files.select("path", "content").mapInArrow(run, PIXEL_SCHEMA)


def read_image(spark: SparkSession, path: str, hdu: int | str = 0) -> DataFrame:
    return image_of(_files(spark, path), hdu)


@dataclass(frozen=True)
class TableColumn:
    """A table's column: name, elements of a row, letter of its form, letter of its elements, scale, zero and null, its place and width in a row, and its dimensions (the fastest first; one where it has no TDIM that fits)."""

    name: str
    repeat: int
    letter: str
    element: str
    scale: float
    zero: float
    null: object
    at: int
    width: int
    dims: tuple[int, ...] = ()

    @property
    def lists(self) -> tuple[int, ...]:
        """Sizes of the arrays in a cell, the innermost first."""
        if self.letter in "XPQ":
            return ()
        if self.letter == "A":  # the first dimension is that of the strings
            return self.dims[1:]
        return self.dims if len(self.dims) > 1 else () if self.repeat == 1 else (self.repeat,)

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1, 0)

    @property
    def whole(self) -> bool:
        """Whether scaled numbers stay whole, as unsigned ones do."""
        return self.scale == 1 and float(self.zero).is_integer() and self.element in "BIJK"

    @property
    def spark_type(self) -> str:
        kind = SPARK_TYPES[self.element]
        if self.scaled:
            kind = "long" if self.whole else "double"
        depth = 1 if self.letter in "PQ" else len(self.lists)
        return "array<" * depth + kind + ">" * depth


#: Element letters of a table of characters by the first of their form.
_CHARACTER_FORMS = {"A": "A", "I": "K", "F": "D", "E": "D", "D": "D"}


def table_columns(unit: Unit) -> list[TableColumn]:
    if unit.kind not in ("table", "ascii"):
        raise ValueError(f"unit {unit.number} holds no table")
    out, at = [], 0
    for i in range(1, int(unit.get("TFIELDS", 0)) + 1):
        form = str(unit.get(f"TFORM{i}")).strip()
        name = str(unit.get(f"TTYPE{i}", f"col{i}")).strip()
        rest = (unit.get(f"TSCAL{i}", 1), unit.get(f"TZERO{i}", 0), unit.get(f"TNULL{i}"))
        if unit.kind == "ascii":
            letter, width = re.match(r"([A-Z])(\d+)", form).groups()
            out.append(TableColumn(name, 1, _CHARACTER_FORMS[letter], _CHARACTER_FORMS[letter], *rest, int(unit.get(f"TBCOL{i}")) - 1, int(width)))
            continue
        repeat, letter, more = re.match(r"(\d*)([A-Z])(.*)", form).groups()
        repeat = int(repeat or 1)
        element = more.lstrip("(")[:1] if letter in "PQ" else letter
        width = COLUMNS[letter][1] * (-(-repeat // 8) if letter == "X" else repeat)
        dims = tuple(int(d) for d in re.findall(r"\d+", str(unit.get(f"TDIM{i}", ""))))
        out.append(TableColumn(name, repeat, letter, element, *rest, at, width, dims if dims and repeat and int(np.prod(dims)) == repeat else ()))
        at += width
    return out


def _texts(raw: np.ndarray) -> pa.Array:
    """Strings of rows of characters: up to a zero byte, without blanks at the end."""
    n, width = raw.shape
    if not width:
        return pa.array([""] * n, pa.string())
    ends = np.where((raw == 0).any(1), (raw == 0).argmax(1), width)
    raw = np.where(np.arange(width)[None, :] < ends[:, None], raw, 32).astype(np.uint8)
    raw[raw > 127] = ord("?")
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pc.ascii_rtrim(pa.Array.from_buffers(pa.string(), n, [None, offsets, pa.py_buffer(raw.tobytes())]), " ")


def _numbers(values: np.ndarray, c: TableColumn) -> pa.Array:
    """Elements of a column, scaled, undefined ones null."""
    if c.element == "L":
        return pa.array(values == b"T", mask=(values != b"T") & (values != b"F"))
    if c.element in "CM":
        parts = [pa.array(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("="))) for x in (values.real, values.imag)]
        return pa.StructArray.from_arrays(parts, ["re", "im"])
    bad = np.isnan(values) if values.dtype.kind == "f" else values == c.null if c.null is not None else None
    if c.scaled:
        values = values.astype(np.int64) + int(c.zero) if c.whole else values * float(c.scale) + float(c.zero)
    elif c.element == "B":
        values = values.astype(np.int16)
    return _with_nulls(values.astype(values.dtype.newbyteorder("=")), bad)


def _characters(raw: np.ndarray, c: TableColumn) -> pa.Array:
    """A column of a table of characters."""
    texts = _texts(raw)
    if c.element == "A":
        return texts if c.null is None else pc.if_else(pc.equal(texts, str(c.null).rstrip()), pa.scalar(None, pa.string()), texts)
    texts = pc.ascii_trim_whitespace(texts)
    missing = pc.or_(pc.equal(texts, ""), pc.equal(texts, str(c.null).strip()))
    numbers = pc.cast(pc.replace_substring(pc.if_else(missing, pa.scalar(None, pa.string()), texts), "D", "E"), pa.int64() if c.element == "K" else pa.float64())
    return numbers if not c.scaled else pc.add(pc.multiply(numbers.cast(pa.float64()), float(c.scale)), float(c.zero)).cast(pa.int64() if c.whole else pa.float64())


def table_arrays(unit: Unit, columns: Sequence[TableColumn], rows: np.ndarray, heap: Callable[[int, int], bytes]) -> list[pa.Array]:
    """Columns of raw rows (n, bytes of a row); ``heap`` gives a stretch of what lies behind the table, for arrays of variable length."""
    out: list[pa.Array] = []
    n = len(rows)
    for c in columns:
        own = np.ascontiguousarray(rows[:, c.at : c.at + c.width])
        if unit.kind == "ascii":
            out.append(_characters(own, c))
        elif c.letter == "A":
            out.append(_nested(_texts(own.reshape(-1, c.dims[0]) if c.lists else own), c.lists))
        elif c.letter == "X":
            out.append(_texts((np.unpackbits(own, axis=1)[:, : c.repeat] + 48).astype(np.uint8)))
        elif c.letter in "PQ":
            kind, size = COLUMNS[c.element]
            counts, places = own.view(COLUMNS[c.letter][0]).reshape(n, 2).astype(np.int64).T
            used = counts > 0
            low = int(places[used].min()) if used.any() else 0
            data = heap(low, int((places + counts * size)[used].max()) - low) if used.any() else b""
            parts = [np.frombuffer(data, kind, m, at - low) for m, at in zip(counts.tolist(), places.tolist(), strict=True) if m]
            flat = np.concatenate(parts) if parts else np.zeros(0, kind)
            out.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), _numbers(flat, c)))
        elif not c.repeat:
            out.append(pa.ListArray.from_arrays(np.zeros(n + 1, np.int32), _numbers(np.zeros(0, COLUMNS[c.letter][0]), c)))
        else:
            out.append(_nested(_numbers(own.view(COLUMNS[c.letter][0]).ravel(), c), c.lists))
    return out


def _nested(values: pa.Array, sizes: Sequence[int]) -> pa.Array:
    """Arrays of these sizes, the innermost first, of values one after the other."""
    for size in sizes:
        values = pa.ListArray.from_arrays((np.arange(len(values) // size + 1) * size).astype(np.int32), values)
    return values


def _raw_rows(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def table_schema(columns: Sequence[TableColumn]) -> str:
    """Schema of a table's rows."""
    return ", ".join(f"`{name}` {kind}" for name, kind in [(ROW, "long"), *((c.name, c.spark_type) for c in columns), (PROBLEM, "string")])


_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(pa.field("element", _arrow_type(kind[6:-1])))
    if kind.startswith("struct<"):
        return pa.struct([tuple((n, _arrow_type(k)) for n, k in [part.split(":")])[0] for part in kind[7:-1].split(",")])
    return _ARROW[kind]


def arrow_of(ddl: str) -> pa.Schema:
    """A schema text of this module for Arrow, in tasks as well."""
    return pa.schema([(name.strip("`"), _arrow_type(kind)) for name, kind in re.findall(r"(`[^`]*`|\w+) ([^ ]+?)(?:, |$)", ddl)])


def table_batch(schema: pa.Schema, unit: Unit, columns: Sequence[TableColumn], first: int, rows: np.ndarray, heap: Callable[[int, int], bytes], file: str | None = None) -> pa.RecordBatch:
    """Rows of ``schema``: row numbers from ``first`` on, columns by their names, and where it asks for them the rows' bytes and the file's name."""
    by_name = {c.name: c for c in columns}
    chosen = [by_name[f.name] for f in schema if f.name not in OWN]
    arrays = dict(zip([c.name for c in chosen], table_arrays(unit, chosen, rows, heap), strict=True))
    arrays |= {ROW: pa.array(np.arange(first, first + len(rows))), PROBLEM: pa.nulls(len(rows), pa.string())}
    if RAW in schema.names:
        arrays[RAW] = _raw_rows(rows)
    if FILE in schema.names:
        arrays[FILE] = pa.repeat(pa.scalar(file, pa.string()), len(rows))
    return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in schema], schema=schema)


def differing(schema: pa.Schema, columns: Sequence[TableColumn]) -> str | None:
    """What a file's columns lack of ``schema``."""
    own = {f.name: f.type for f in arrow_of(table_schema(columns))}
    lacking = [f.name for f in schema if f.name not in OWN and own.get(f.name) != f.type]
    return f"no columns {lacking} of the types of the first file" if lacking else None


def table_of(files: DataFrame, hdu: int | str = 1) -> DataFrame:
    """The rows of each file's table, with ``_row`` from 1 in its file, and ``_problem``; without files no rows and no other columns."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for content in rows["content"]:
                try:
                    found = table_schema(table_columns(choose(scan(io.BytesIO(plain_bytes(bytes(content or b"")))), hdu)))
                except (ValueError, KeyError, TypeError, AttributeError, OSError, EOFError):
                    continue
                yield pd.DataFrame({"kind": [found]})

    files = files.select("path", "content")
    schema = next((r.kind for r in files.orderBy("path").mapInPandas(first, "kind string").take(1)), table_schema([]))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content in rows.column("content"):
                try:
                    unit = choose(units(content.as_py() or b""), hdu)
                    columns = table_columns(unit)
                    if problem := differing(arrow, columns):
                        raise ValueError(problem)
                    width, n = unit.axes
                    heap_at = int(unit.get("THEAP", width * n))
                    raw = np.frombuffer(unit.data, np.uint8, width * n).reshape(n, width)
                    step = max(1, BATCH_VALUES // max(1, width))
                    for at in range(0, n, step):
                        yield table_batch(arrow, unit, columns, at + 1, raw[at : at + step], lambda place, size, unit=unit, heap_at=heap_at: unit.data[heap_at + place : heap_at + place + size])
                except (ValueError, KeyError, TypeError, AttributeError, OSError, EOFError) as problem:
                    yield problem_batch(arrow, **{PROBLEM: str(problem)})

    return files.mapInArrow(run, schema)


def read_table(spark: SparkSession, path: str, hdu: int | str = 1) -> DataFrame:
    return table_of(_files(spark, path), hdu)


def encode_table(columns: Mapping[str, np.ndarray], header: Mapping[str, object] | None = None) -> bytes:
    """A binary table with its empty primary unit, from columns of one length (numbers, also of two dimensions, booleans and byte strings)."""
    letters = {"u1": "B", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D", "c8": "C", "c16": "M"}
    kinds, forms = [], []
    for name, values in columns.items():
        repeat = int(np.prod(values.shape[1:])) if values.ndim > 1 else 1
        if values.dtype.kind == "b":
            kinds.append((name, "S1"))
            forms.append("1L")
        elif values.dtype.kind == "S":
            kinds.append((name, values.dtype))
            forms.append(f"{values.dtype.itemsize}A")
        else:
            kinds.append((name, values.dtype.newbyteorder(">"), (repeat,)))
            forms.append(f"{repeat}{letters[values.dtype.str[1:]]}")
    n = len(next(iter(columns.values())))
    rows = np.zeros(n, kinds)
    for name, values in columns.items():
        rows[name] = np.where(values, b"T", b"F") if values.dtype.kind == "b" else values if values.dtype.kind == "S" else values.reshape(n, -1)
    head: dict[str, object] = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kinds)}
    for i, (kind, form) in enumerate(zip(kinds, forms, strict=True), 1):
        head |= {f"TTYPE{i}": kind[0], f"TFORM{i}": form}
    return encode({"BITPIX": 8, "NAXIS": 0}) + encode(head | dict(header or {}), rows.tobytes(), primary=False)


def kernel_from_cubes(spark: SparkSession, real: str, imaginary: str) -> tuple[DataFrame, DataFrame]:
    """Kernel table ``w, y, x, re, im`` and support table ``w, support`` from two cubes, of which the real one's file holds the supports."""
    from pyspark.sql import functions as F

    from fringe.operators.gridding import zip_complex

    cube = lambda path: read_image(spark, path).select((F.col("plane") - 1).alias("w"), (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"), "value")
    table = read_table(spark, real)
    support = table.select((F.col("_row") - 1).cast("int").alias("w"), F.col(table.columns[1]).cast("int").alias("support"))
    return zip_complex(cube(real), cube(imaginary)), support
