"""FITS images and tables by byte ranges, and a sink for tables, as data sources.

``register(spark)`` makes four formats known:

- ``fits_image``: pixels (``fits.PIXEL_SCHEMA``). Options ``hdu``, ``section``, ``split_bytes``. ``write_images`` writes them.
- ``fits_table``: rows with ``_row`` and ``_problem``. Options ``hdu``, ``columns`` (names between commas),
  ``rows`` (ranges such as ``1-100,500-``), ``raw`` (``true`` adds ``_raw``, a row's bytes), ``file`` (``true`` adds
  ``_file``, where a row is from), ``split_bytes``. Cells with TDIM are nested arrays. Writing makes files of at most ``max_bytes`` each.
- ``fits_header``: cards (``fits.HEADER_SCHEMA``). A file costs its header blocks alone; one that can't be read has no card but one of the key ``problem``.
- ``raw_image``: pixels of files without a header. Options ``pixels`` (``u1 i2 u2 i4 f4 f8``, with ``>`` or ``<`` in
  front for the bytes' order; without the smallest comes first), ``shape`` (pixels of a line, lines, planes ...), ``offset`` in bytes, and ``section`` and ``split_bytes``.

A read is planned from a listing alone: each task has a file and a range of its bytes, and reads the lines or
rows that begin in it. Headers are read by the tasks, each skipping over data, so a file of any size costs
its few header blocks for each range. Of lines and rows only those are read that the section, the row ranges
and comparisons of ``plane``, ``y``, ``x`` and ``_row`` in a filter leave (with
``spark.sql.python.filterPushdown.enabled``); the filter itself is still Spark's. A compressed file is one
range. Files that can't be read as asked are a row with the problem.

Paths are those that ``pyarrow.fs`` opens; stores that only Spark reads are for ``fits.read_image`` and ``read_table``.
"""

from __future__ import annotations

import contextlib
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from . import fits
from .store import Output, Ranges, files_of, place_of

SPLIT_BYTES = 64 << 20
MAX_BYTES = 256 << 20
#: Bytes that are read together, and the largest gap between two wanted pieces that is read rather than skipped.
READ_BYTES, GAP_BYTES = 8 << 20, 4 << 10
_ERRORS = (ValueError, KeyError, TypeError, AttributeError, OSError, EOFError)


@dataclass
class Span:
    """Places from 1: ``first`` to ``last`` (None: the end) in steps of ``step``."""

    first: int = 1
    last: int | None = None
    step: int = 1

    def within(self, size: int) -> np.ndarray:
        """Places from 0 of this span among ``size``."""
        return np.arange(max(0, self.first - 1) if self.step == 1 else self.first - 1, min(size, self.last or size), self.step)


def parse_section(text: str | None) -> list[Span]:
    """``x1:x2[:step],y1:y2[:step],plane1:plane2[:step]``; ``*`` or nothing is a whole axis."""
    out = []
    for part in (text or "").split(","):
        part = part.strip()
        if part in ("", "*"):
            out.append(Span())
            continue
        found = re.fullmatch(r"(\d+)(?::(\d+))?(?::(\d+))?", part)
        if not found or int(found[1]) < 1 or found[3] == "0" or (found[2] and int(found[2]) < int(found[1])):
            raise ValueError(f"no section {text!r}")
        out.append(Span(int(found[1]), int(found[2] or found[1]), int(found[3] or 1)))
    return (out + [Span()] * 3)[:3]


def parse_rows(text: str | None) -> list[Span]:
    """Row ranges between commas; either end may be left out."""
    out = []
    for part in (text or "-").split(","):
        found = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", part)
        if not found or not (found[1] or found[2]):
            raise ValueError(f"no row ranges {text!r}")
        first = int(found[1] or 1)
        out.append(Span(first, (int(found[3]) if found[3] else None) if found[2] else first))
    return out


class Limits:
    """Bounds of named whole numbers, from filters."""

    def __init__(self, *names: str) -> None:
        self.low = dict.fromkeys(names, 1)
        self.high: dict[str, int | None] = dict.fromkeys(names)

    def take(self, filters: Sequence[Filter]) -> None:
        """What the filters say; they stay filters, as only whole bounds are used."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name not in self.low or not isinstance(f.value, int):
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high[name] = high if self.high[name] is None else min(high, self.high[name])

    def keep(self, name: str, places: np.ndarray) -> np.ndarray:
        """Of places from 0 those within the bounds."""
        high = self.high[name]
        return places[(places + 1 >= self.low[name]) & (places + 1 <= (high if high is not None else np.iinfo(np.int64).max))]


@dataclass
class Piece(InputPartition):
    """A file and the range of its bytes in which the rows of a task begin."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def pieces(path: str, split_bytes: int) -> list[Piece]:
    out = []
    for file, size in files_of(path):
        step = max(1, size) if file.endswith(".gz") else split_bytes
        out += [Piece(file, at, at + step if at + step < size else 1 << 62) for at in range(0, max(1, size), step)]
    return out


def _begin_in(piece: Piece, start: int, width: int, count: int) -> tuple[int, int]:
    """Of ``count`` things of ``width`` bytes from ``start`` on those that begin in the piece: the first, and the one behind the last."""
    first, stop = (-(-(at - start) // width) for at in (piece.start, piece.stop))
    return min(count, max(0, first)), min(count, max(0, stop))


def _runs(places: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Ascending places of things of ``width`` bytes in runs that are read together."""
    if not len(places):
        return
    apart = np.flatnonzero((np.diff(places) - 1) * width > GAP_BYTES) + 1
    for run in np.split(places, apart):
        most = max(1, READ_BYTES // width)
        bounds = np.searchsorted(run, np.arange(run[0], run[-1] + 1, most))
        yield from (x for x in np.split(run, bounds[1:]) if len(x))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: Sequence[str]) -> None:
        self.root = options["path"]
        self.hdu = options.get("hdu")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.limits = Limits(*names)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.limits.take(filters)
        yield from filters

    def partitions(self) -> Sequence[Piece]:
        return pieces(self.root, self.split_bytes)


def _data_problem(schema: pa.Schema, path: str, problem: Exception) -> pa.RecordBatch:
    return fits.problem_batch(schema, **({"path": path, "problem": str(problem)} if "path" in schema.names else {fits.PROBLEM: f"{path}: {problem}", fits.FILE: path}))


class ImageReader(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options, ("plane", "y", "x"))
        self.section = parse_section(options.get("section"))

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there are no files
            return
        schema = fits.arrow_of(fits.PIXEL_SCHEMA)
        began = False
        try:
            with Ranges(self.root, piece.path) as file:
                unit, kind = self.image(file)
                began = True
                for batch in self.lines(file, piece, unit, kind):
                    yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)
        except _ERRORS as problem:
            # What is wrong with the header every range meets, and the first one says it; what is wrong with the data says each that meets it.
            if began or piece.start == 0:
                yield _data_problem(schema, piece.path, problem)

    def image(self, file: Ranges) -> tuple[fits.Unit, np.dtype]:
        """The image, and its pixels as they are stored."""
        unit = fits.choose(fits.scan(file), self.hdu or "image")
        fits.image_shape(unit)
        return unit, np.dtype(fits.PIXELS[int(unit.get("BITPIX"))])

    def batches(self, file: Ranges, piece: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.lines(file, piece, *self.image(file))

    def lines(self, file: Ranges, piece: Piece, unit: fits.Unit, kind: np.dtype) -> Iterator[pa.RecordBatch]:
        width, height = fits.image_shape(unit)
        xs, ys, planes = (self.limits.keep(name, span.within(size)) for name, span, size in zip(("x", "y", "plane"), self.section, (width, height, int(np.prod(unit.axes[2:], dtype=np.int64))), strict=True))
        if not len(xs):
            return
        first, stop = _begin_in(piece, unit.start, unit.row_bytes, unit.size // unit.row_bytes)
        # The wanted lines of this range, plane by plane, so that a cube's lines are never all listed.
        wanted = (lines for plane in planes[np.searchsorted(planes, first // height) : np.searchsorted(planes, -(-stop // height))] if len(lines := (at := plane * height + ys)[(at >= first) & (at < stop)]))
        low, span = int(xs[0]), int(xs[-1]) + 1 - int(xs[0])
        for lines in wanted:
            narrow = (width - span) * kind.itemsize > GAP_BYTES
            for run in [np.array([x]) for x in lines] if narrow else _runs(lines, unit.row_bytes):
                # From the first wanted pixel of the first line to the last of the last one.
                size = ((run[-1] - run[0]) * width + span) * kind.itemsize
                raw = np.frombuffer(file.at(unit.start + int(run[0] * width + low) * kind.itemsize, int(size)), kind)
                yield fits.image_batch(piece.path, unit, raw[((run - run[0]) * width)[:, None] + (xs - low)[None, :]], run, xs)


class RawImageReader(ImageReader):
    """Images whose shape is told and not read."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        found = re.fullmatch(r"([<>]?)(u1|i2|u2|i4|f4|f8)", options.get("pixels", ""))
        if not found:
            raise ValueError(f"no pixels {options.get('pixels')!r}")
        self.kind = np.dtype((found[1] or "<") + found[2])
        self.axes = [int(n) for n in options.get("shape", "").split(",") if n.strip()]
        self.offset = int(options.get("offset", 0))
        if not self.axes or min(self.axes) < 1 or self.offset < 0:
            raise ValueError(f"no shape {options.get('shape')!r}")

    def image(self, file: Ranges) -> tuple[fits.Unit, np.dtype]:
        bits = 8 * self.kind.itemsize
        cards = [("BITPIX", str(-bits if self.kind.kind == "f" else bits), ""), ("NAXIS", str(len(self.axes)), ""), *((f"NAXIS{i}", str(n), "") for i, n in enumerate(self.axes, 1))]
        return fits.Unit(cards, b"", 0, self.offset, int(np.prod(self.axes, dtype=np.int64)) * self.kind.itemsize), self.kind


class HeaderReader(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options, ())

    def partitions(self) -> Sequence[Piece]:
        return [Piece(path, 0, 1 << 62) for path, _ in files_of(self.root)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        schema = fits.arrow_of(fits.HEADER_SCHEMA)
        try:
            with Ranges(self.root, piece.path) as file:
                for unit in fits.scan(file):
                    cards = [*zip(*unit.cards, strict=True)] if unit.cards else [(), (), ()]
                    n = len(unit.cards)
                    columns = [[piece.path] * n, [unit.number] * n, range(1, n + 1), *cards]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        except _ERRORS as problem:
            yield fits.problem_batch(schema, path=piece.path, key="problem", value=str(problem))


class TableReader(_Reader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, (fits.ROW,))
        self.rows = parse_rows(options.get("rows"))
        self.arrow = to_arrow_schema(schema)

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        began = False
        try:
            with Ranges(self.root, piece.path) as file:
                unit, columns = self.table(file, self.arrow)
                began = True
                yield from self.lines(file, piece, self.arrow, unit, columns)
        except _ERRORS as problem:
            if began or piece.start == 0:
                yield _data_problem(self.arrow, piece.path, problem)

    def table(self, file: Ranges, schema: pa.Schema) -> tuple[fits.Unit, Sequence[fits.TableColumn]]:
        unit = fits.choose(fits.scan(file), self.hdu or "table")
        columns = fits.table_columns(unit)
        if problem := fits.differing(schema, columns):
            raise ValueError(problem)
        return unit, columns

    def batches(self, file: Ranges, piece: Piece, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        yield from self.lines(file, piece, schema, *self.table(file, schema))

    def lines(self, file: Ranges, piece: Piece, schema: pa.Schema, unit: fits.Unit, columns: Sequence[fits.TableColumn]) -> Iterator[pa.RecordBatch]:
        width, n = unit.axes
        first, stop = _begin_in(piece, unit.start, max(1, width), n)
        heap_at = unit.start + int(unit.get("THEAP", width * n))
        for at in range(first, stop, max(1, READ_BYTES // max(1, width))):
            every = np.arange(at, min(stop, at + max(1, READ_BYTES // max(1, width))))
            wanted = self.limits.keep(fits.ROW, every[np.any([(every + 1 >= s.first) & (every < (s.last if s.last is not None else n)) for s in self.rows], axis=0)])
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
                if len(run):
                    raw = np.frombuffer(file.at(unit.start + int(run[0]) * width, len(run) * width), np.uint8).reshape(len(run), width)
                    yield fits.table_batch(schema, unit, columns, int(run[0]) + 1, raw, lambda place, size: file.at(heap_at + place, size), piece.path)


#: Forms of a column by its Spark type.
_FORMS = {BooleanType: ("L", "S1"), ByteType: ("I", ">i2"), ShortType: ("I", ">i2"), IntegerType: ("J", ">i4"), LongType: ("K", ">i8"), FloatType: ("E", ">f4"), DoubleType: ("D", ">f8")}


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's files."""

    names: list[str]


class TableWriter(DataSourceArrowWriter):
    """Rows of numbers, booleans, strings and arrays of numbers, as binary tables of bounded size.

    Whole numbers that are null are written as the smallest of their type, which is then TNULL (such a
    number itself is refused), other nulls as NaN, zero bytes and empty strings and arrays. Strings take the
    width of the longest in the file, arrays that of the longest, filled up with nulls; arrays of arrays do so on
    each level and say it as TDIM.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.output = Output(options["path"], overwrite)
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.fields = [f for f in schema if f.name not in fits.OWN]
        for f in self.fields:
            kind = f.dataType
            while isinstance(kind, ArrayType):
                kind = kind.elementType
            if type(kind) not in _FORMS and not (isinstance(kind, StringType) and kind is f.dataType):
                raise ValueError(f"{f.name}: no form for {f.dataType.simpleString()}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, held, size = [], [], 0
        for batch in iterator:
            # A batch is cut so that a file stays within its bounds.
            step = max(1, batch.num_rows * self.max_bytes // max(1, 2 * batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and size + part.nbytes > self.max_bytes:
                    names.append(self._file(held))
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            names.append(self._file(held))
        return Written(names)

    def _file(self, batches: list[pa.RecordBatch]) -> str:
        table = pa.Table.from_batches(batches).combine_chunks()
        kinds, header, columns = [], {}, []
        for i, f in enumerate(self.fields, 1):
            column = table.column(f.name).chunk(0) if table.num_rows else table.column(f.name)
            form, kind, values, null, sizes = _cells(column, f)
            kinds.append((f"c{i}", kind))
            columns.append(values)
            header |= {f"TTYPE{i}": f.name, f"TFORM{i}": form} | ({f"TNULL{i}": null} if null is not None else {})
            if len(sizes) > 1:
                header[f"TDIM{i}"] = f"({','.join(map(str, reversed(sizes)))})"
        rows = np.zeros(table.num_rows, kinds)
        for (name, _), values in zip(kinds, columns, strict=True):
            rows[name] = values
        head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kinds)}
        with self.output.create(".fits") as (name, stream):
            stream.write(fits.encode({"BITPIX": 8, "NAXIS": 0}) + fits.encode(head | header, rows.tobytes(), primary=False))
        return name

    def commit(self, messages: list[Written | None]) -> None:
        self.output.commit([name for m in messages if m for name in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        self.output.abort()


def _cells(column: pa.Array, field) -> tuple[str, object, np.ndarray, int | None, list[int]]:
    """A column's form, its numpy type, its cells, what stands for null, and the sizes of its arrays from the outermost on."""
    if isinstance(field.dataType, StringType):
        texts = [(t or "").encode("ascii", "replace") for t in column.to_pylist()]
        width = max([1, *map(len, texts)])
        return f"{width}A", f"S{width}", np.array(texts, f"S{width}"), None, []
    n, kind, sizes = len(column), field.dataType, []
    places = np.arange(n)  # of each element, in cells that are as long as the longest
    while isinstance(kind, ArrayType):
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes.append(max([1, *counts.tolist()]))
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = np.repeat(places, counts) * sizes[-1] + within
        column, kind = column.flatten(), kind.elementType
    letter, form = _FORMS[type(kind)]
    bad = column.is_null().to_numpy(zero_copy_only=False)
    dtype = np.dtype(form)
    null = int(np.iinfo(dtype).min) if dtype.kind == "i" else None
    values = column.fill_null(False if letter == "L" else 0).to_numpy(zero_copy_only=False)
    if letter == "L":
        flat = np.where(bad, b"", np.where(values.astype(bool), b"T", b"F")).astype("S1")
    else:
        flat = values.astype(dtype.newbyteorder("="))
        if null is not None and (flat[~bad] == null).any():
            raise ValueError(f"{field.name}: {null} stands for null in a file")
        flat = np.where(bad, null if null is not None else np.nan, flat)
    repeat = int(np.prod(sizes, dtype=np.int64))
    null_there = null if null is not None and (bad.any() or len(flat) < n * repeat) else None
    if not sizes:
        return f"1{letter}", form, flat, null_there, sizes
    cells = np.full(n * repeat, b"" if letter == "L" else null if null is not None else np.nan, "S1" if letter == "L" else dtype)
    cells[places] = flat
    return f"{repeat}{letter}", (form, (repeat,)), cells.reshape(n, repeat), null_there, sizes


#: What is written for an undefined pixel, by the type of pixels.
_UNDEFINED = {"i2": -(1 << 15), "i4": -(1 << 31), "i8": -(1 << 63), "f4": np.nan, "f8": np.nan}


class ImageWriter(DataSourceArrowWriter):
    """Sorted pixels (file, plane, y, x, value) as images, each as a stream: a task holds a batch and ``READ_BYTES``, whatever the image's size.

    Rows of a file have to be in one task, sorted as ``write_images`` does. Pixels without a row are undefined.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.output = Output(options["path"], overwrite)
        self.width, self.height, self.planes = _shape(options["shape"])
        self.per_file = int(options["planes_per_file"])
        self.pixels = options["pixels"]
        self.kind = np.dtype(f">{self.pixels}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        with contextlib.ExitStack() as open_file:
            file, at = None, 0
            stream = None
            for batch in iterator:
                columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "plane", "y", "x", "value")}
                bounds = [0, *(np.flatnonzero(np.diff(columns["file"])) + 1).tolist(), batch.num_rows]
                for low, high in itertools.pairwise(bounds):
                    if low == high:
                        continue
                    run = {c: v[low:high] for c, v in columns.items()}
                    if run["file"][0] != file:
                        if stream is not None:
                            self._end(stream, file, at)
                            open_file.pop_all().close()
                        file, at = int(run["file"][0]), 0
                        name, stream = open_file.enter_context(self.output.create(".fits"))
                        names.append(name)
                        stream.write(fits.encode(self._header(file)))
                    at = self._pixels(stream, file, at, run)
            if stream is not None:
                self._end(stream, file, at)
        return Written(names)

    def _held(self, file: int) -> int:
        """Planes of a file."""
        return min(self.per_file, self.planes - file * self.per_file)

    def _header(self, file: int) -> dict[str, object]:
        whole = self.kind.kind == "i"
        first = file * self.per_file + 1
        return {"BITPIX": 8 * self.kind.itemsize * (1 if whole else -1), "NAXIS": 3, "NAXIS1": self.width, "NAXIS2": self.height, "NAXIS3": self._held(file), "CRPIX3": 1, "CRVAL3": first, "CDELT3": 1} | ({"BLANK": _UNDEFINED[self.pixels]} if whole else {})

    def _pixels(self, stream, file: int, at: int, run: dict[str, np.ndarray]) -> int:
        """Writes up to the run's last pixel, and returns the place behind it."""
        x, y, plane = (np.asarray(run[c], np.int64) for c in ("x", "y", "plane"))
        wrong = (x < 1) | (x > self.width) | (y < 1) | (y > self.height) | (plane < 1) | (plane > self.planes)
        if wrong.any():
            raise ValueError(f"a pixel at {x[wrong][0]}, {y[wrong][0]}, {plane[wrong][0]} of {self.width}, {self.height}, {self.planes}")
        places = ((plane - 1 - file * self.per_file) * self.height + y - 1) * self.width + x - 1
        if (np.diff(places) < 0).any() or places[0] < at - 1:
            raise ValueError("pixels aren't sorted")
        new = np.concatenate(([places[0] >= at], np.diff(places) > 0))  # of several values for a pixel the first counts
        places, values = places[new], np.asarray(run["value"], float)[new]
        if not len(places):
            return at
        if self.kind.kind == "i":
            bounds, given = np.iinfo(self.kind), np.round(values[~np.isnan(values)])
            if ((given <= bounds.min) | (given > bounds.max)).any():
                raise ValueError(f"pixels beyond those of {self.pixels}, of which the smallest is undefined")
            values = np.where(np.isnan(values), _UNDEFINED[self.pixels], np.round(values))
        end = int(places[-1]) + 1
        for low in range(at, end, READ_BYTES // self.kind.itemsize):
            high = min(end, low + READ_BYTES // self.kind.itemsize)
            own = slice(*np.searchsorted(places, (low, high)))
            stretch = np.full(high - low, _UNDEFINED[self.pixels], self.kind)
            stretch[places[own] - low] = values[own]
            stream.write(stretch.tobytes())
        return end

    def _end(self, stream, file: int, at: int) -> None:
        """The rest of the image, and what fills its last block."""
        size = self._held(file) * self.height * self.width
        step = READ_BYTES // self.kind.itemsize
        for low in range(at, size, step):
            stream.write(np.full(min(step, size - low), _UNDEFINED[self.pixels], self.kind).tobytes())
        stream.write(bytes(-size * self.kind.itemsize % fits.BLOCK))

    def commit(self, messages: list[Written | None]) -> None:
        self.output.commit([name for m in messages if m for name in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        self.output.abort()


def _shape(text: str) -> tuple[int, int, int]:
    width, height, planes = (int(n) for n in text.split(","))
    return width, height, planes


def write_images(pixels: DataFrame, path: str, width: int, height: int, planes: int = 1, kind: str = "f4", max_bytes: int = MAX_BYTES, overwrite: bool = False) -> None:
    """Pixels (plane, y, x from 1, value) as images of whole planes and about ``max_bytes`` at most, at least a plane each.

    ``kind`` is ``i2 i4 i8 f4`` or ``f8``; whole numbers are rounded. CRVAL3 of a file is its first plane. Pixels without a row or
    with a null or NaN are undefined; of several values for one pixel the largest counts; planes without any row have no
    file where none of that file's has one. A place beyond the shape, a null one, or a number that the type can't hold
    fails the job, which then leaves nothing behind. Rows are shuffled once, by file.
    """
    if kind not in _UNDEFINED or min(width, height, planes) < 1:
        raise ValueError(f"no image of {width}, {height}, {planes} pixels of {kind}")
    per_file = max(1, min(planes, max_bytes // (width * height * int(kind[1]))))
    places = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("plane", "y", "x")]
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value")
    rows = pixels.select(*places, value).withColumn("file", F.floor((F.col("plane") - 1) / per_file).cast("long")).repartition("file")
    ordered = rows.sortWithinPartitions("file", "plane", "y", "x", F.desc_nulls_last("value"))
    writer = ordered.write.format("fits_image").options(shape=f"{width},{height},{planes}", planes_per_file=per_file, pixels=kind)
    writer.mode("overwrite" if overwrite else "append").save(path)


class FitsImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return fits.PIXEL_SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options, overwrite)


class RawImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_image"

    def schema(self) -> str:
        return fits.PIXEL_SCHEMA

    def reader(self, schema: StructType) -> RawImageReader:
        return RawImageReader(self.options)


class FitsHeader(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_header"

    def schema(self) -> str:
        return fits.HEADER_SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options)


class FitsTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        """That of the first file which holds such a table, by its headers."""
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None
        for path, _ in files_of(self.options["path"]):
            try:
                with Ranges(self.options["path"], path) as file:
                    columns = fits.table_columns(fits.choose(fits.scan(file), self.options.get("hdu") or "table"))
            except _ERRORS:
                continue
            if wanted is not None:
                by_name = {c.name.lower(): c for c in columns}
                columns = [by_name[w.lower()] for w in wanted]
            return self._with_own(fits.table_schema(columns))
        return self._with_own(fits.table_schema([]))

    def _with_own(self, schema: str) -> str:
        """``schema`` with the columns that options ask for."""
        for option, column in (("raw", f"`{fits.RAW}` binary"), ("file", f"`{fits.FILE}` string")):
            if str(self.options.get(option, "")).lower() == "true":
                schema = schema.replace(f"`{fits.PROBLEM}`", f"{column}, `{fits.PROBLEM}`")
        return schema

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (FitsImage, FitsTable, FitsHeader, RawImage):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _raw_pixels(values: list, unit: fits.Unit) -> bytes:
    """Pixels as an image stores them: scaled back, nulls as BLANK or NaN, whole numbers rounded."""
    kind = np.dtype(fits.PIXELS[int(unit.get("BITPIX"))])
    own = np.array([np.nan if v is None else v for v in values], float)
    raw = (own - float(unit.get("BZERO", 0.0))) / float(unit.get("BSCALE", 1.0))
    if kind.kind in "iu":
        blank = unit.get("BLANK")
        if np.isnan(own).any() and blank is None:
            raise ValueError("nulls in an image of whole numbers without BLANK")
        bounds = np.iinfo(kind)
        raw = np.where(np.isnan(own), 0 if blank is None else blank, np.round(raw))
        if ((raw < bounds.min) | (raw > bounds.max)).any():
            raise ValueError("pixels beyond the image's numbers")
    return raw.astype(kind).tobytes()


def rewrite_planes(spark: SparkSession, planes: DataFrame, hdu: int | str = "image") -> DataFrame:
    """``path, planes, problem``: files whose planes are replaced by those of ``planes`` (path, plane from 1, values line after line).

    Each file is copied by one task, a piece at a time, with its new planes in place (as many as it is given, which are at most
    all of its own), and takes the old one's place by a rename when all tasks are done. A file that can't be
    changed so is left as it is and says why; nothing changes if a task fails. Of several rows for one plane the
    first by its values counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, given in zip(frame["path"], frame["given"], strict=True):
                new, name, problem = {}, None, None
                for g in sorted(given, key=lambda g: (g["plane"], str(g["values"])), reverse=True):
                    new[g["plane"]] = list(g["values"])
                try:
                    output = Output(path.rpartition("/")[0], False)
                    with Ranges(path, path) as file, output.create("") as (name, stream):
                        unit = fits.choose(fits.scan(file), hdu)
                        width, height = fits.image_shape(unit)
                        size, count = width * height * abs(int(unit.get("BITPIX"))) // 8, int(np.prod(unit.axes[2:], dtype=np.int64))
                        if wrong := [k for k, v in new.items() if not 1 <= k <= count or len(v) != width * height]:
                            raise ValueError(f"no planes {wrong} of {width} by {height} pixels")
                        at = 0
                        for k in sorted(new):
                            for place in range(at, unit.start + (k - 1) * size, READ_BYTES):
                                stream.write(file.at(place, min(READ_BYTES, unit.start + (k - 1) * size - place)))
                            stream.write(_raw_pixels(new[k], unit))
                            at = unit.start + k * size
                        end = file.seek(0, 2)
                        for place in range(at, end, READ_BYTES):
                            stream.write(file.at(place, min(READ_BYTES, end - place)))
                except _ERRORS as e:
                    problem = str(e)
                    output.abort()
                yield pd.DataFrame({"path": [path], "planes": [len(new)], "temporary": [None if problem else f"{output.temporary}/{name}"], "problem": [problem]})

    given = planes.groupBy("path").agg(F.collect_list(F.struct("plane", "values")).alias("given"))
    done = given.mapInPandas(run, "path string, planes int, temporary string, problem string").collect()  # a row for each file
    for r in done:
        if r.temporary:
            system, place = place_of(r.path)
            system.move(r.temporary, place)
            system.delete_dir(r.temporary.rpartition("/")[0])
    return spark.createDataFrame([(r.path, r.planes, r.problem) for r in done], "path string, planes int, problem string")
