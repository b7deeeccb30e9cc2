import random

import pytest
from pyspark.sql import functions as F

from fringe.operators import regions

TABLE = "n int, shape string, parameters array<double>, include boolean, component int"
PARAMETERS = {
    "circle": lambda r: (r(), r(), r(1, 9)),
    "annulus": lambda r: (r(), r(), r(1, 5), r(5, 12)),
    "ellipse": lambda r: (r(), r(), r(1, 9), r(1, 9), r(0, 180)),
    "elliptannulus": lambda r: (r(), r(), r(1, 3), r(1, 3), r(4, 9), r(4, 9), r(0, 180), r(0, 180)),
    "box": lambda r: (r(), r(), r(1, 20), r(1, 20), r(0, 180)),
    "rotbox": lambda r: (r(), r(), r(1, 20), r(1, 20)),
    "boxannulus": lambda r: (r(), r(), r(1, 5), r(1, 5), r(6, 20), r(6, 20), r(0, 90)),
    "rectangle": lambda r: (r(), r(), r(), r(), r(0, 180)),
    "diamond": lambda r: (r(), r(), r(2, 20), r(2, 20), r(0, 90)),
    "sector": lambda r: (r(), r(), r(0, 360), r(0, 360)),
    "point": lambda r: (r(), r()),
    "line": lambda r: (r(), r(), r(), r()),
    "polygon": lambda r: tuple(r() for _ in range(2 * int(r(3, 8)))),
    "panda": lambda r: (r(), r(), r(0, 360), r(0, 360), r(0, 3), r(4, 12)),
    "epanda": lambda r: (r(), r(), r(0, 360), r(0, 360), r(1, 2), r(1, 2), r(4, 12), r(4, 12), r(0, 90)),
    "bpanda": lambda r: (r(), r(), r(0, 360), r(0, 360), r(1, 2), r(1, 2), r(6, 20), r(6, 20), r(0, 90)),
}


def shapes_of(seed, count, exclude_first=False):
    rng = random.Random(seed)
    r = lambda a=-30, b=30: round(rng.uniform(a, b), 2)
    out = []
    for n in range(count):
        name = rng.choice(sorted(PARAMETERS))
        out.append(regions.Shape(name, PARAMETERS[name](r), rng.random() < 0.6, rng.randrange(1, 4)))
    if exclude_first:
        out[0] = regions.Shape("circle", (0.0, 0.0, 20.0), False, out[0].component)
    return out


def table(spark, shapes):
    rows = [(n, ("!" if not s.include and n % 2 else "") + s.name.upper(), list(map(float, s.parameters)), s.include or bool(n % 2), s.component) for n, s in enumerate(shapes)]
    return spark.createDataFrame(rows, TABLE).repartition(3)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-45, 45), rng.uniform(-45, 45), 0.0) for i in range(1500)]
    rows += [(2000 + i, float(i % 21 - 10), float(i // 21 - 10), 0.0) for i in range(441)]
    rows += [(3000, None, 1.0, 0.0), (3001, 1.0, None, 0.0), (3002, 1e6, -1e6, 0.0), (3003, rows[0][1], rows[0][2], 0.0)]
    return spark.createDataFrame(rows, "id int, x double, y double, place_x double").cache()


def test_every_shape_as_its_predicate(spark, points):
    """Parameters in columns and as numbers are the same shape."""
    rng = random.Random(9)
    r = lambda a=-30, b=30: round(rng.uniform(a, b), 2)
    shapes = [regions.Shape(name, PARAMETERS[name](r)) for name in sorted(PARAMETERS) for _ in range(4)]
    x, y = F.col("x"), F.col("y")
    both = [(regions.hit_by(x, y, F.lit(s.name), F.array(*map(F.lit, map(float, s.parameters)))), F.coalesce(regions.SHAPES[s.name](x, y, *s.parameters), F.lit(False))) for s in shapes]
    out = points.select(*[F.sum((a != b).cast("int")).alias(f"differ_{i}") for i, (a, b) in enumerate(both)], *[F.sum(b.cast("int")).alias(f"hit_{i}") for i, (_, b) in enumerate(both)]).first()
    assert not any(out[: len(shapes)]) and sum(n > 0 for n in out[len(shapes) :]) > len(shapes) // 2


@pytest.mark.parametrize(("seed", "count", "exclude_first"), [(1, 40, False), (2, 12, True), (3, 40, True)])
def test_order_and_components(spark, points, seed, count, exclude_first):
    shapes = shapes_of(seed, count, exclude_first)
    got = regions.in_region(points, table(spark, shapes), F.col("x"), F.col("y"))
    want = points.where(regions.inside(F.col("x"), F.col("y"), shapes))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_edges(spark, points):
    """Integer corners lie on cell borders; nothing, unknown and lacking shapes."""
    shapes = [regions.Shape("rectangle", (-4, -4, 4, 4)), regions.Shape("box", (0, 0, 2, 2), False), regions.Shape("circle", (8, 0, 0)), regions.Shape("diamond", (-8, 0, 2, 2))]
    got = regions.in_region(points, table(spark, shapes), F.col("x"), F.col("y"))
    want = points.where(regions.inside(F.col("x"), F.col("y"), shapes))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    none = spark.createDataFrame([], TABLE)
    assert regions.in_region(points, none, F.col("x"), F.col("y")).count() == 0
    assert regions.in_region(points.limit(0), table(spark, shapes), F.col("x"), F.col("y")).count() == 0
    lacking = spark.createDataFrame([(1, "circle", [1.0], True, 1), (2, "box", None, True, 1)], TABLE)
    assert regions.in_region(points, lacking, F.col("x"), F.col("y")).count() == 0
    with pytest.raises(ValueError, match="no shapes"):
        regions.in_region(points, spark.createDataFrame([(1, "blob", [1.0], True, 1)], TABLE), F.col("x"), F.col("y"))


def test_a_hundred_thousand_shapes(spark):
    """Beyond what one predicate holds; a point is in the region if its nearest grid circle includes it."""
    shapes = spark.range(100_000).selectExpr("cast(id as int) as n", "'circle' as shape", "array(cast(id % 400 as double), cast(id div 400 as double), 0.25d) as parameters", "id % 3 <> 0 as include", "1 as component")
    points = spark.range(20_000).selectExpr("id", "(id * 7919 % 400) + 0.1 * (id % 5) as x", "(id * 104729 % 250) + 0.1 * (id % 3) as y")
    near = "round(x) + 400 * round(y)"
    want = points.where(f"pow(x - round(x), 2) + pow(y - round(y), 2) <= 0.0625 and ({near}) % 3 <> 0 and round(x) < 400 and round(y) < 250")
    got = regions.in_region(points, shapes.where("n > 0"), F.col("x"), F.col("y"))
    assert got.count() == want.count() > 5_000 and got.join(want, "id", "left_anti").count() == 0
