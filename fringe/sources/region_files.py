"""Regions from text files and from region tables of FITS files, as the tables that ``regions.in_region`` takes.

A text has shapes such as ``circle(10, 20, 5)``, several on a line if need be, excluded by ``-`` in front; what
follows ``#`` is a comment. An excluded shape takes away from all before it; shapes that are excluded before any is
included take away from everything. Places are pixels, or sky positions (decimal degrees, or hours and degrees
with colons) after ``fk4``, ``fk5``, ``icrs``, ``# format: degree`` or ``# format: hms``, in front of a shape with a
semicolon or on a line of their own, until ``image``, ``physical`` or another format. Sizes may end in ``"``, ``'`` or
``d``. Sky positions and such sizes become pixels by a ``Projection``; angles then turn with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringe.functions.sky import Projection
from fringe.operators.ordered import last_values, number_rows
from fringe.session import checkpointed

#: For each shape the fewest and most numbers it has in a file, how many of them are places, which are angles, and which only say into how many parts it is drawn.
_FORMS = {
    "circle": (3, 3, 2, (), ()), "annulus": (4, 4, 2, (), ()), "ellipse": (4, 5, 2, (4,), ()), "elliptannulus": (6, 8, 2, (6, 7), ()), "box": (4, 5, 2, (4,), ()),
    "boxannulus": (6, 8, 2, (6, 7), ()), "rectangle": (4, 5, 4, (4,), ()), "diamond": (4, 5, 2, (4,), ()), "sector": (4, 4, 2, (2, 3), ()), "point": (2, 2, 2, (), ()), "line": (4, 4, 4, (), ()),
    "panda": (8, 8, 2, (2, 3), (4, 7)), "epanda": (10, 11, 2, (2, 3, 10), (4, 9)), "bpanda": (10, 11, 2, (2, 3, 10), (4, 9)),
}
_OTHER_NAMES = {"rotbox": "box", "rotrectangle": "rectangle", "rotdiamond": "diamond", "rhombus": "diamond", "rotrhombus": "diamond", "pie": "sector"}
#: Shapes that more numbers make hollow.
_HOLLOW = {"box": "boxannulus", "ellipse": "elliptannulus"}
_SKY_SYSTEMS = ("fk4", "fk5", "icrs")
_ITEM = re.compile(r"\s*(?:(image|physical|linear|fk4|fk5|icrs);)?\s*([+-]?)\s*([a-z]+)\s*\(([^(]*)", re.IGNORECASE)
_SYSTEM = re.compile(r"\s*(image|physical|fk4|fk5|icrs)\b[^(]*", re.IGNORECASE)
_FORMAT = re.compile(r"#\s*format:\s*(?:(pixel)|(degree|hhmmss|hms))?", re.IGNORECASE)
_SEXAGESIMAL = re.compile(r"\s*([+-]?)(\d+):(\d+)(?::(\d+\.?\d*))?\s*")
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([\"'d]?)\s*")
_DEGREES = {'"': 1 / 3600, "'": 1 / 60, "d": 1.0}
PLACE, PIXELS, DEGREES, ANGLE = range(4)

#: Texts whose starts (three numbers each) go to every task.
BROADCAST_TEXTS = 10_000
_PARSED = "path string, line long, item int, sky boolean, shape string, include boolean, numbers array<double>, kinds array<int>, problem string"


def _number(text: str, place: int) -> tuple[float, str]:
    """A number and what ends it; with colons in degrees, the first of a pair from hours."""
    if found := _SEXAGESIMAL.fullmatch(text):
        degrees = int(found[2]) + int(found[3]) / 60 + float(found[4] or 0) / 3600
        return (-degrees if found[1] == "-" else degrees) * (1 if place % 2 else 15), ""
    if not (found := _NUMBER.fullmatch(text)):
        raise ValueError("no number")
    return float(found[1]), found[2]


def _shape(name: str, texts: list[str]) -> tuple[str, list[float], list[int]]:
    """A shape's name, numbers (each that it may have) and their kinds."""
    name = _OTHER_NAMES.get(name, name)
    name = _HOLLOW.get(name, name) if len(texts) >= 6 else name
    if name != "polygon" and name not in _FORMS:
        raise ValueError("no such shape")
    low, high, places, angles, left_out = _FORMS.get(name, (6, len(texts), len(texts), (), ()))
    if not low <= len(texts) <= high or places % 2:
        raise ValueError("wrong count of numbers")
    numbers, kinds = [], []
    for i, text in enumerate(texts):
        value, unit = _number(text, i)
        kinds.append(PLACE if i < places else ANGLE if i in angles else DEGREES if unit else PIXELS)
        numbers.append(value * _DEGREES[unit] if kinds[-1] == DEGREES else value)
    # An angle that is left out is none, or the first one of the shape.
    for _ in range(len(numbers), 1 + max(angles, default=-1)):
        numbers.append(numbers[6] if name in _HOLLOW.values() and len(numbers) == 7 else 0.0)
        kinds.append(ANGLE)
    kept = [i for i in range(len(numbers)) if i not in left_out]
    return name, [numbers[i] for i in kept], [kinds[i] for i in kept]


def _items(value: str) -> Iterator[tuple]:
    """What a line says: the columns of ``_PARSED`` from ``sky`` on; a null ``shape`` without a problem is a format alone."""
    if found := _FORMAT.match(value):
        yield bool(found[2]) if found[1] or found[2] else None, None, None, None, None, None if found[1] or found[2] else f"no such format: {value.strip()}"
        return
    if value[:1] == "#" or value[:4].lower() == "glob":
        return
    *closed, rest = value.split("#")[0].split(")")
    for text, whole in [*((t, True) for t in closed), (rest, False)]:
        if not whole and not text.strip():
            continue
        if not whole and (found := _SYSTEM.fullmatch(text)):
            yield found[1].lower() in _SKY_SYSTEMS, None, None, None, None, None
            continue
        sky = None
        try:
            if not whole or not (found := _ITEM.fullmatch(text)):
                raise ValueError("no shape")
            system, sign, name, inner = found.groups()
            if ":" in inner:
                sky = True
            elif system:
                sky = system.lower() in _SKY_SYSTEMS
            elif "d" in inner:
                sky = True
            yield sky, *(lambda s: (s[0], sign != "-", s[1], s[2], None))(_shape(name.lower(), inner.split(",")))
        except ValueError as problem:
            yield sky, None, None, None, None, f"{problem}: {text.strip()}"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = [(path, line, i, *item) for path, line, value in zip(frame["path"], frame["line"], frame["value"], strict=True) for i, item in enumerate(_items(value or ""))]
        yield pd.DataFrame(out, columns=["path", "line", "item", "sky", "shape", "include", "numbers", "kinds", "problem"])


def _pixel(projection: Projection, ra: Column, dec: Column) -> Column:
    return F.array(*projection.to_pixel(ra, dec))


def _in_pixels(projection: Projection) -> Column:
    """``numbers`` of a shape on the sky as pixels."""
    numbers, kinds = F.col("numbers"), F.col("kinds")
    at = lambda i: F.get(numbers, i.cast("int"))
    places = F.size(F.filter(kinds, lambda k: k == PLACE))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(places / 2).cast("int") - 1), lambda k: _pixel(projection, at(2 * k), at(2 * k + 1)))
    ra, dec = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    first = _pixel(projection, ra, dec)

    def other(i: Column) -> Column:
        # Pixels are taken to be square: a size is as long as on the meridian, towards the equator.
        end = _pixel(projection, ra, F.when(dec < 0, dec + at(i)).otherwise(dec - at(i)))
        kind = F.get(kinds, i)
        return F.when(kind == DEGREES, F.hypot(end[0] - first[0], end[1] - first[1])).when(kind == ANGLE, at(i) + projection.rotation).otherwise(at(i))

    rest = F.when(F.size(numbers) > places, F.transform(F.sequence(places, F.size(numbers) - 1), other)).otherwise(F.array().cast("array<double>"))
    return F.concat(F.flatten(pairs), rest)


def shapes_of_lines(lines: DataFrame, projection: Projection | None = None) -> DataFrame:
    """``path, n, shape, parameters, include, component, problem`` of lines of text (path, line, value).

    ``n`` numbers the shapes of all files in their order, with gaps; each path has components of its own, so what
    is read together is united. What can't be read is a row with a problem and no shape, which ``in_region``
    refuses. Blank lines, null values and lines that begin with ``glob`` say nothing; lines of one number are
    taken in the order of a hash. Lines may be spread over any tasks: the format in force is carried from range to range.
    """
    parsed = lines.select("path", F.col("line").cast("long").alias("line"), "value").mapInPandas(_parse, _PARSED)
    numbered = number_rows(parsed, ["path", "line", "item"], "n")
    # The last format so far counts, within its file.
    marked = numbered.withColumn("sky", F.when(F.col("sky").isNotNull(), F.struct("path", "sky")))
    known = last_values(marked, ["sky"], "n").withColumn("sky", F.coalesce((F.col("sky.path") == F.col("path")) & F.col("sky.sky"), F.lit(False)))
    shapes = known.where("shape is not null or problem is not null")
    parameters = F.when(F.col("sky"), _in_pixels(projection)).otherwise(F.col("numbers")) if projection else F.col("numbers")
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("sky") & F.lit(projection is None), "sky positions without a projection")
        .when(~F.col("sky") & F.array_contains("kinds", DEGREES), "a size in degrees among pixels")
        .when(F.exists("parameters", lambda v: v.isNull()), "not in the projection")
    )
    starts = shapes.groupBy("path").agg(F.min("n").alias("first"), F.min(F.when(F.col("include"), F.col("n"))).alias("first_include"))
    component = 2 * F.col("first") + F.coalesce(F.col("n") >= F.col("first_include"), F.lit(False)).cast("long")
    # A text may hold nearly all shapes: the starts of few texts are broadcast. Those of many are joined by plain shuffles of written tables, whose large texts Spark splits.
    shapes, starts = checkpointed(shapes.withColumn("parameters", parameters).withColumn("problem", problem)), checkpointed(starts)
    few = starts.count() <= BROADCAST_TEXTS
    made = shapes.join(F.broadcast(starts) if few else starts, "path").withColumn("component", component)
    good = F.col("problem").isNull()
    return made.select("path", F.col("n").cast("long").alias("n"), F.when(good, F.col("shape")).alias("shape"), F.when(good, F.col("parameters")).alias("parameters"), "include", F.col("component").cast("long").alias("component"), "problem")


def read_regions(spark: SparkSession, path: str, projection: Projection | None = None) -> DataFrame:
    """The shapes of the text files at ``path`` (see ``shapes_of_lines``). A file is read by one task, as its lines have an order; regions of very many shapes are better kept as tables."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\n")).alias("line", "value"))
    return shapes_of_lines(whole, projection)


def shapes_of_table(rows: DataFrame, order: str = "_row") -> DataFrame:
    """A region table's rows (X, Y, SHAPE, R, ROTANG and perhaps COMPONENT, numbers or arrays, names in any case) as ``n, shape, parameters, include, component``.

    A polygon ends at its first null or where it is back at its first point. A leading ``!`` excludes. Of a sector or
    pie the angles count, and its two radii make it a panda. Without a component it is 1. Missing numbers are null, so that the shape holds nothing.
    """
    types = {f.name.lower(): (f.name, f.dataType.typeName()) for f in rows.schema}
    if lacking := [c for c in ("x", "y", "shape", "r", "rotang") if c not in types]:
        raise ValueError(f"no columns {lacking}")
    array = lambda c: (F.col(types[c][0]) if types[c][1] == "array" else F.array(F.col(types[c][0]))).cast("array<double>")
    name = F.lower(F.trim(types["shape"][0]))
    base = F.regexp_replace(F.ltrim(name, F.lit("!")), "^rot(?=box|rectangle|diamond|rhombus)", "")
    base = F.when(base == "pie", "sector").when(base == "rhombus", "diamond").otherwise(base)
    component = F.coalesce(F.col(types["component"][0]).cast("long"), F.lit(1)) if "component" in types else F.lit(1).cast("long")
    given = rows.select(F.col(order).cast("long").alias("n"), base.alias("shape"), (~name.startswith("!")).alias("include"), component.alias("component"), array("x").alias("x"), array("y").alias("y"), array("r").alias("r"), array("rotang").alias("angle"))
    piece = (F.col("shape") == "sector") & F.get("r", F.lit(1)).isNotNull() & (F.get("r", F.lit(1)) > 0)
    given = given.withColumn("shape", F.when(piece, "panda").otherwise(F.col("shape")))
    points = F.arrays_zip("x", "y")
    index = F.sequence(F.lit(0), F.size(points) - 1)
    ends = F.filter(index, lambda i: F.get(points, i)["x"].isNull() | F.get(points, i)["y"].isNull() | ((i > 0) & (F.get(points, i) == F.get(points, F.lit(0)))))
    corners = F.flatten(F.transform(F.when(F.size(ends) > 0, F.slice(points, 1, F.get(ends, F.lit(0)))).otherwise(points), lambda p: F.array(p["x"], p["y"])))
    take = lambda c, k: F.array(*[F.get(F.col(c), F.lit(i)) for i in range(k)])
    place = F.array(F.get("x", F.lit(0)), F.get("y", F.lit(0)))
    parameters = F.when(F.col("shape") == "polygon", corners).when(F.col("shape") == "rectangle", F.array(*[F.get(c, F.lit(i)) for i in (0, 1) for c in ("x", "y")]))
    for shape, radii, angles in (("circle", 1, 0), ("annulus", 2, 0), ("box", 2, 1), ("diamond", 2, 1), ("ellipse", 2, 1), ("boxannulus", 4, 2), ("elliptannulus", 4, 2), ("sector", 0, 2)):
        parameters = parameters.when(F.col("shape") == shape, F.concat(place, *[take(c, k) for c, k in (("r", radii), ("angle", angles)) if k]))
    parameters = parameters.when(F.col("shape") == "panda", F.concat(place, take("angle", 2), take("r", 2))).otherwise(place)
    return given.select("n", "shape", parameters.alias("parameters"), "include", "component")
