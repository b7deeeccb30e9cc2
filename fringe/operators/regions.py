"""Spatial regions: shapes, included or excluded, in components.

A few shapes make one boolean column (``inside``). A table of shapes, of any size, is joined with the
points by cells (``in_region``). All shapes hold their border. Angles are degrees, counter-clockwise.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.session import checkpointed, fresh


Number = float | Column


def _col(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _squared(value: Number) -> Column:
    return value * value if isinstance(value, Column) else F.lit(float(value) ** 2)


def _turned(x: Column, y: Column, xc: Number, yc: Number, angle: Number) -> tuple[Column, Column]:
    """Coordinates along the axes of a shape at (xc, yc) that is turned by ``angle``."""
    c, s = (F.cos(F.radians(angle)), F.sin(F.radians(angle))) if isinstance(angle, Column) else (math.cos(math.radians(angle)), math.sin(math.radians(angle)))
    dx, dy = x - _col(xc), y - _col(yc)
    return dx * c + dy * s, dy * c - dx * s


def circle(x: Column, y: Column, xc: Number, yc: Number, r: Number) -> Column:
    dx, dy = x - _col(xc), y - _col(yc)
    return dx * dx + dy * dy <= _squared(r)


def annulus(x: Column, y: Column, xc: Number, yc: Number, inner: Number, outer: Number) -> Column:
    dx, dy = x - _col(xc), y - _col(yc)
    d = dx * dx + dy * dy
    return (d >= _squared(inner)) & (d <= _squared(outer))


def _ellipse_size(x: Column, y: Column, xc: Number, yc: Number, a: Number, b: Number, angle: Number) -> Column:
    p, q = _turned(x, y, xc, yc, angle)
    return (p / a) * (p / a) + (q / b) * (q / b)


def ellipse(x: Column, y: Column, xc: Number, yc: Number, a: Number, b: Number, angle: Number = 0.0) -> Column:
    return _ellipse_size(x, y, xc, yc, a, b, angle) <= 1


def elliptannulus(x: Column, y: Column, xc: Number, yc: Number, a_in: Number, b_in: Number, a_out: Number, b_out: Number, angle: Number = 0.0, angle_out: Number | None = None) -> Column:
    return (_ellipse_size(x, y, xc, yc, a_in, b_in, angle) >= 1) & ellipse(x, y, xc, yc, a_out, b_out, angle if angle_out is None else angle_out)


def box(x: Column, y: Column, xc: Number, yc: Number, width: Number, height: Number, angle: Number = 0.0) -> Column:
    p, q = _turned(x, y, xc, yc, angle)
    return (F.abs(p) <= width / 2) & (F.abs(q) <= height / 2)


def boxannulus(x: Column, y: Column, xc: Number, yc: Number, w_in: Number, h_in: Number, w_out: Number, h_out: Number, angle: Number = 0.0, angle_out: Number | None = None) -> Column:
    return box(x, y, xc, yc, w_out, h_out, angle if angle_out is None else angle_out) & ~box(x, y, xc, yc, w_in, h_in, angle)


def rectangle(x: Column, y: Column, x1: Number, y1: Number, x2: Number, y2: Number, angle: Number = 0.0) -> Column:
    """By two opposite corners, turned around its middle."""
    size = lambda d: F.abs(d) if isinstance(d, Column) else abs(d)
    return box(x, y, (x1 + x2) / 2, (y1 + y2) / 2, size(x2 - x1), size(y2 - y1), angle)


def diamond(x: Column, y: Column, xc: Number, yc: Number, width: Number, height: Number, angle: Number = 0.0) -> Column:
    p, q = _turned(x, y, xc, yc, angle)
    return F.abs(2 * p / width) + F.abs(2 * q / height) <= 1


def _between_angles(x: Column, y: Column, xc: Number, yc: Number, first: Number, last: Number) -> Column:
    turn = F.pmod(F.degrees(F.atan2(y - _col(yc), x - _col(xc))), F.lit(360.0))
    if isinstance(first, Column):
        first, last = F.pmod(first, F.lit(360.0)), F.pmod(last, F.lit(360.0))
        return F.when(first <= last, (turn >= first) & (turn <= last)).otherwise((turn >= first) | (turn <= last))
    first, last = first % 360, last % 360
    return (turn >= first) & (turn <= last) if first <= last else (turn >= first) | (turn <= last)


def sector(x: Column, y: Column, xc: Number, yc: Number, first: Number, last: Number) -> Column:
    return _between_angles(x, y, xc, yc, first, last)


def point(x: Column, y: Column, xc: Number, yc: Number) -> Column:
    """The unit pixel around a point."""
    return (x > xc - 0.5) & (x < xc + 0.5) & (y > yc - 0.5) & (y < yc + 0.5)


def line(x: Column, y: Column, x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    """Within half a pixel of the line between two points."""
    if isinstance(x1, Column):
        length, angle = F.hypot(x2 - x1, y2 - y1), F.degrees(F.atan2(y2 - y1, x2 - x1))
    else:
        length, angle = math.hypot(x2 - x1, y2 - y1), math.degrees(math.atan2(y2 - y1, x2 - x1))
    p, q = _turned(x, y, x1, y1, angle)
    return (p >= -0.5) & (p <= length + 0.5) & (F.abs(q) < 0.5)


def polygon(x: Column, y: Column, *corners: float) -> Column:
    """By x, y, x, y ...; inside if a ray crosses its edges an odd number of times. Its bounding box is tested first."""
    xs, ys = [float(c) for c in corners[::2]], [float(c) for c in corners[1::2]]
    crossings = F.lit(0)
    for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
        if y1 == y2:
            continue
        spans = (y >= min(y1, y2)) & (y < max(y1, y2))
        crossings = crossings + F.when(spans & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    bounds = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return F.when(bounds, crossings % 2 == 1).otherwise(False)


def _every_second(corners: Column, first: int) -> Column:
    return F.filter(corners, lambda _, i: i % 2 == first)


def _polygon_of(x: Column, y: Column, corners: Column) -> Column:
    """``polygon`` with its corners in an array column."""
    at = lambda i: F.get(corners, F.pmod(i, F.size(corners)))

    def crossing(k: Column) -> Column:
        x1, y1, x2, y2 = (at(2 * k + i) for i in range(4))
        spans = (y1 != y2) & (y >= F.least(y1, y2)) & (y < F.greatest(y1, y2))
        return F.when(spans & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)

    crossings = F.aggregate(F.sequence(F.lit(0), F.expr("0") + (F.size(corners) / 2).cast("int") - 1), F.lit(0), lambda n, k: n + crossing(k))
    xs, ys = _every_second(corners, 0), _every_second(corners, 1)
    bounds = x.between(F.array_min(xs), F.array_max(xs)) & y.between(F.array_min(ys), F.array_max(ys))
    return F.when((F.size(corners) >= 2) & bounds, crossings % 2 == 1).otherwise(False)


def panda(x: Column, y: Column, xc: Number, yc: Number, first: Number, last: Number, inner: Number, outer: Number) -> Column:
    """A piece of an annulus."""
    return annulus(x, y, xc, yc, inner, outer) & _between_angles(x, y, xc, yc, first, last)


def epanda(x: Column, y: Column, xc: Number, yc: Number, first: Number, last: Number, a_in: Number, b_in: Number, a_out: Number, b_out: Number, angle: Number = 0.0) -> Column:
    """A piece of an elliptic annulus; its angles count from its own axis."""
    p, q = _turned(x, y, xc, yc, angle)
    return elliptannulus(x, y, xc, yc, a_in, b_in, a_out, b_out, angle) & _between_angles(p, q, 0, 0, first, last)


def bpanda(x: Column, y: Column, xc: Number, yc: Number, first: Number, last: Number, w_in: Number, h_in: Number, w_out: Number, h_out: Number, angle: Number = 0.0) -> Column:
    """A piece of a box annulus; its angles count from its own axis."""
    p, q = _turned(x, y, xc, yc, angle)
    return boxannulus(x, y, xc, yc, w_in, h_in, w_out, h_out, angle) & _between_angles(p, q, 0, 0, first, last)


SHAPES = {
    "circle": circle, "annulus": annulus, "ellipse": ellipse, "elliptannulus": elliptannulus, "box": box, "rotbox": box, "boxannulus": boxannulus, "rectangle": rectangle,
    "diamond": diamond, "rhombus": diamond, "sector": sector, "pie": sector, "point": point, "line": line, "polygon": polygon, "panda": panda, "epanda": epanda, "bpanda": bpanda,
}


@dataclass(frozen=True)
class Shape:
    """A shape by name and parameters; an excluded one takes away from the shapes before it in its component."""

    name: str
    parameters: Sequence[float] = field(default_factory=tuple)
    include: bool = True
    component: int = 1


def inside(x: Column, y: Column, shapes: Sequence[Shape]) -> Column:
    """Whether a point lies in the region; false where a coordinate is null.

    Components are united. Within one, shapes apply in order; one that begins with an exclusion begins with everything.
    """
    united = F.lit(False)
    for number in sorted({s.component for s in shapes}):
        own = [s for s in shapes if s.component == number]
        held = F.lit(not own[0].include)
        for s in own:
            hit = F.coalesce(SHAPES[s.name](x, y, *s.parameters), F.lit(False))
            held = held | hit if s.include else held & ~hit
        united = united | held
    return F.coalesce(united & x.isNotNull() & y.isNotNull(), F.lit(False))


# A region table: n, shape, parameters (array), include, component.

#: Cells along the larger side of a shape.
CELLS = 4
#: Levels of cell sizes below the region's own size: what is smaller yet takes cells of the last.
LEVELS = 40
#: How far cells and bounds are widened against rounding, as a share of the coordinates.
MARGIN = 1e-9
#: For each shape its kind of bounds, and the places of its middle's or corners' and its size's parameters.
_CONVEX = ("circle", "ellipse", "box", "rotbox", "rectangle", "diamond", "rhombus")
_ROUND = {"circle": (2, 2), "annulus": (3, 3), "ellipse": (2, 3), "elliptannulus": (4, 5), "panda": (5, 5), "epanda": (6, 7)}
_BOXED = {"box": (2, 3), "rotbox": (2, 3), "boxannulus": (4, 5), "diamond": (2, 3), "rhombus": (2, 3), "bpanda": (6, 7)}
_CORNERED = ("rectangle", "line")
_ENDLESS = ("sector", "pie")


def hit_by(x: Column, y: Column, shape: Column, parameters: Column, only: Collection[str] = ()) -> Column:
    """Whether a point lies in the shape of its row (one of ``only``, if given, which makes the test shorter); false for a null and for missing parameters."""

    def p(i: int, default: Column | None = None) -> Column:
        value = F.get(parameters, F.lit(i))
        return value if default is None else F.coalesce(value, default)

    zero = F.lit(0.0)
    turned_twice = (p(6, zero), F.coalesce(p(7), p(6), zero))
    tests = {
        ("circle",): circle(x, y, p(0), p(1), p(2)),
        ("annulus",): annulus(x, y, p(0), p(1), p(2), p(3)),
        ("ellipse",): ellipse(x, y, p(0), p(1), p(2), p(3), p(4, zero)),
        ("elliptannulus",): elliptannulus(x, y, p(0), p(1), p(2), p(3), p(4), p(5), *turned_twice),
        ("box", "rotbox"): box(x, y, p(0), p(1), p(2), p(3), p(4, zero)),
        ("boxannulus",): boxannulus(x, y, p(0), p(1), p(2), p(3), p(4), p(5), *turned_twice),
        ("rectangle",): rectangle(x, y, p(0), p(1), p(2), p(3), p(4, zero)),
        ("diamond", "rhombus"): diamond(x, y, p(0), p(1), p(2), p(3), p(4, zero)),
        ("sector", "pie"): sector(x, y, p(0), p(1), p(2), p(3)),
        ("point",): point(x, y, p(0), p(1)),
        ("line",): line(x, y, p(0), p(1), p(2), p(3)),
        ("polygon",): _polygon_of(x, y, parameters),
        ("panda",): panda(x, y, p(0), p(1), p(2), p(3), p(4), p(5)),
        ("epanda",): epanda(x, y, p(0), p(1), p(2), p(3), p(4), p(5), p(6), p(7), p(8, zero)),
        ("bpanda",): bpanda(x, y, p(0), p(1), p(2), p(3), p(4), p(5), p(6), p(7), p(8, zero)),
    }
    out = F.when(F.lit(False), False)
    for names, test in tests.items():
        if not only or set(names) & set(only):
            out = out.when(shape.isin(*names), test)
    return F.coalesce(out, F.lit(False))


def _half_size(shape: Column, parameters: Column) -> Column:
    """How far a shape reaches from its middle at most; null for one that isn't described by its middle."""
    p = lambda i: F.get(parameters, F.lit(i))
    half = None
    for name, (a, b) in {**_ROUND, **_BOXED}.items():
        size = F.hypot(p(a), p(b)) / 2 if name in _BOXED else F.greatest(F.abs(p(a)), F.abs(p(b)))
        half = F.when(shape == name, size) if half is None else half.when(shape == name, size)
    return half.when(shape == "point", 0.5)


def _reach(shape: Column, parameters: Column, half: Column, world: tuple[float, float, float, float]) -> list[Column]:
    """Low and high x and y of a shape; of one without end those of the points."""
    p = lambda i: F.get(parameters, F.lit(i))
    x, y = p(0), p(1)
    xs, ys = _every_second(parameters, 0), _every_second(parameters, 1)
    # A rectangle may be turned around its middle, and a line is half a pixel wide and longer at each end.
    pad = F.hypot(p(2) - x, p(3) - y) / 2 + 1

    def bounds(at: Column, other: Column, points: Column, low: float, high: float) -> tuple[Column, Column]:
        middle = (at + other) / 2
        case = lambda ends, cornered, edge, sign: F.when(shape.isin(*_ENDLESS), edge).when(shape == "polygon", ends).when(shape.isin(*_CORNERED), cornered).otherwise(at + sign * half)
        return case(F.array_min(points), middle - pad, F.lit(low), -1), case(F.array_max(points), middle + pad, F.lit(high), 1)

    return [*bounds(x, p(2), xs, *world[:2]), *bounds(y, p(3), ys, *world[2:])]


def _shapes_of(table: DataFrame) -> DataFrame:
    """A region table as n, shape (lower case), parameters, include, component and ``opens`` (its component begins with an exclusion, and so with everything)."""
    name = F.lower(F.trim("shape"))
    rows = table.select(
        F.col("n").cast("long").alias("n"), F.ltrim(name, F.lit("!")).alias("shape"), F.col("parameters").cast("array<double>").alias("parameters"),
        (F.coalesce(F.col("include").cast("boolean"), F.lit(True)) & ~name.startswith("!")).alias("include"), F.coalesce(F.col("component").cast("long"), F.lit(1)).alias("component"),
    )
    first = rows.groupBy("component").agg(F.min(F.struct("n", "include")).alias("first")).select("component", (~F.col("first.include")).alias("opens"))
    return rows.join(first, "component")


def _cells_of(shapes: DataFrame, world: tuple[float, float, float, float], names: Collection[str]) -> DataFrame:
    """``shapes`` in the cells that they touch, with ``whole``: the shape holds all of the cell.

    A cell is 2^level wide, and a shape takes the level at which it is some ``CELLS`` cells wide. In a cell that a
    shape holds wholly, the shapes before it in its component say nothing any more and drop out.
    """
    # What drops out does so where cells are made: a filter would be pushed down with all that it refers to written out.
    sized = shapes.withColumn("half", _half_size(F.col("shape"), F.col("parameters")))
    low_x, high_x, low_y, high_y = _reach(F.col("shape"), F.col("parameters"), F.col("half"), world)
    placed = sized.withColumns({"low_x": low_x, "high_x": high_x, "low_y": low_y, "high_y": high_y})
    farthest = F.greatest(*[F.abs(F.col(c)) for c in ("low_x", "high_x", "low_y", "high_y")])
    placed = placed.withColumn("margin", farthest * MARGIN + 1e-300)
    # What reaches beyond all points is cut there.
    for axis, (low, high) in zip("xy", (world[:2], world[2:]), strict=True):
        placed = placed.withColumns({f"low_{axis}": F.greatest(F.col(f"low_{axis}") - F.col("margin"), F.lit(low)), f"high_{axis}": F.least(F.col(f"high_{axis}") + F.col("margin"), F.lit(high))})
    top = math.ceil(math.log2(max(world[1] - world[0], world[3] - world[2], *map(abs, world), 1e-290)))
    level = F.ceil(F.log2(F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) / CELLS))
    placed = placed.withColumn("level", F.greatest(F.coalesce(level, F.lit(top - LEVELS)), F.lit(top - LEVELS)).cast("int")).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    for axis in "xy":
        cells = F.sequence(F.floor(F.col(f"low_{axis}") / F.col("size")), F.floor(F.col(f"high_{axis}") / F.col("size")))
        placed = placed.withColumn(f"cell_{axis}", F.explode(F.when((F.col(f"low_{axis}") <= F.col(f"high_{axis}")) & ~F.isnan("margin"), cells)))
    wide = F.col("margin") + F.col("size") * MARGIN
    corners = [[(F.col(f"cell_{axis}") + end) * F.col("size") + (2 * end - 1) * wide for end in (0, 1)] for axis in "xy"]
    convex = [n for n in _CONVEX if n in names]
    all_in = F.lit(bool(convex))
    for cx in corners[0] if convex else ():
        for cy in corners[1]:
            all_in = all_in & hit_by(cx, cy, F.col("shape"), F.col("parameters"), convex)
    placed = placed.withColumn("whole", F.col("shape").isin(*_CONVEX) & all_in)
    keys = ["level", "cell_x", "cell_y", "component"]
    last = placed.where("whole").groupBy(*keys).agg(F.max("n").alias("last_whole"))
    kept = placed.join(last, keys, "left").where("last_whole is null or n >= last_whole")
    return kept.select("level", "cell_x", "cell_y", "n", "shape", "parameters", "include", "component", "opens", "whole")


def in_region(points: DataFrame, table: DataFrame, x: Column, y: Column) -> DataFrame:
    """The rows of ``points`` that lie in the region of ``table`` (n, shape, parameters, include, component): as ``inside`` says, for any number of shapes.

    A shape's name is taken in any case, and with a leading ``!`` it is excluded; a null component is the first, a
    null ``include`` includes; of shapes of one number an exclusion comes last; one with missing parameters holds
    nothing. Points with a null coordinate are not in the region; a region without shapes holds none.

    Each shape is cut into cells of a size that suits it, and the places of the points are looked up in their cells
    of every size in use: an equi-join, after which only points in a shape's edge cells are tested. For each
    place and component the last shape that holds it decides.
    """
    shapes = _shapes_of(table)
    names = {r.shape for r in shapes.select("shape").distinct().limit(len(SHAPES) + 1).collect()}
    if unknown := names - set(SHAPES):
        raise ValueError(f"no shapes {sorted(map(str, unknown))}")
    px, py = fresh(points.columns, "place_x", "place_y")
    placed = points.withColumns({px: x.cast("double"), py: y.cast("double")})
    places = placed.select(F.col(px).alias("x"), F.col(py).alias("y")).where("x is not null and y is not null").distinct()
    extent = places.where("abs(x) < 1e300 and abs(y) < 1e300").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    open_components = shapes.where("opens").select("component").distinct().count()
    if extent[0] is None:
        return placed.where(F.col(px).isNotNull() & F.col(py).isNotNull() & F.lit(open_components > 0)).drop(px, py)
    cells = checkpointed(_cells_of(shapes, tuple(extent), names))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # at most LEVELS and a few
    size = F.pow(F.lit(2.0), F.col("level"))
    looked_up = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"cell_x": F.floor(F.col("x") / size), "cell_y": F.floor(F.col("y") / size)})
    met = looked_up.join(cells, ["level", "cell_x", "cell_y"]).where(F.col("whole") | hit_by(F.col("x"), F.col("y"), F.col("shape"), F.col("parameters"), names))
    last = met.groupBy("x", "y", "component", "opens").agg(F.max(F.struct("n", ~F.col("include"))).alias("last"))
    verdict = last.groupBy("x", "y").agg(F.max(~F.col("last.col2")).alias("held"), F.sum(F.col("opens").cast("int")).alias("opened"))
    inside_ = F.col("held") | (F.col("opened") < open_components)
    # Where nothing has hit a place it is in the region only if a component begins with everything.
    decided = verdict.where(~inside_ if open_components else inside_).select(F.col("x").alias("verdict_x"), F.col("y").alias("verdict_y"))
    how = "left_anti" if open_components else "left_semi"
    return placed.where(F.col(px).isNotNull() & F.col(py).isNotNull()).join(decided, (F.col(px) == F.col("verdict_x")) & (F.col(py) == F.col("verdict_y")), how).drop(px, py)
