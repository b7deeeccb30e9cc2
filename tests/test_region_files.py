import math

import pytest
from pyspark.sql import functions as F

from fringe.functions.sky import Projection
from fringe.operators import regions
from fringe.sources import region_files

TEXT = """# Region file format
global color=green font="helvetica 10 normal"
circle(10, 20, 5) # color=red
-circle(10,20,2) + box( 1 ,2,3,4.5e0,30)

image;rotbox(1,2,3,4) Ellipse(5,6,7,8)
ellipse(0,0,1,2,3,4) box(0,0,1,2,3,4,15)
physical; polygon(0,0, 4,0, 4,4)
panda(1,2,10,80,1,3,4,1)
epanda(1,2,10,80,1,3,4,5,6,1,25)
bpanda(1,2,10,80,1,3,4,5,6,1)
"""


def read(spark, *texts, projection=None):
    lines = [(f"f{k}", i, line) for k, text in enumerate(texts) for i, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "path string, line int, value string").repartition(3)
    return region_files.shapes_of_lines(df, projection)


def listed(df):
    return [(r.shape, list(r.parameters) if r.parameters is not None else None, r.include) for r in df.orderBy("n").collect()]


def test_shapes_of_a_text(spark):
    df = read(spark, TEXT)
    assert df.where("problem is not null").count() == 0
    assert listed(df) == [
        ("circle", [10, 20, 5], True), ("circle", [10, 20, 2], False), ("box", [1, 2, 3, 4.5, 30], True), ("box", [1, 2, 3, 4, 0], True), ("ellipse", [5, 6, 7, 8, 0], True),
        ("elliptannulus", [0, 0, 1, 2, 3, 4, 0, 0], True), ("boxannulus", [0, 0, 1, 2, 3, 4, 15, 15], True), ("polygon", [0, 0, 4, 0, 4, 4], True), ("panda", [1, 2, 10, 80, 3, 4], True),
        ("epanda", [1, 2, 10, 80, 3, 4, 5, 6, 25], True), ("bpanda", [1, 2, 10, 80, 3, 4, 5, 6, 0], True),
    ]
    assert len({r.component for r in df.collect()}) == 1


def test_files_on_disk_and_points(spark, tmp_path):
    """An exclusion takes from all before it; a file that begins with one begins with everything."""
    (tmp_path / "a.reg").write_text("circle(0,0,5)\ncircle(6,0,5)\n-circle(3,0,2)\r\ncircle(3,0,1)\n")
    (tmp_path / "b.reg").write_text("-box(0,0,100,100)\n-circle(60,0,5)\ncircle(40,0,1)")
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(-20, 140) for y in range(-12, 13)], "x double, y double")
    got = {(r.x, r.y) for r in regions.in_region(points, region_files.read_regions(spark, str(tmp_path)), F.col("x"), F.col("y")).collect()}
    hit = lambda x, y, cx, r: (x - cx) ** 2 + y**2 <= r * r
    want = set()
    for x, y in ((r.x, r.y) for r in points.collect()):
        first = (hit(x, y, 0, 5) or hit(x, y, 6, 5)) and not hit(x, y, 3, 2) or hit(x, y, 3, 1)
        second = not (abs(x) <= 50 and abs(y) <= 50) and not hit(x, y, 60, 5) or hit(x, y, 40, 1)
        if first or second:
            want.add((x, y))
    assert got == want


def test_sky_positions(spark):
    p = Projection(150.0, -20.0, 50.0, 60.0, -0.01, 0.01, 30.0, "TAN")
    text = 'fk5\ncircle(150.1,-20.2,36")\nbox(10:00:24,-20:12:00,3\',0.05d,10)\nimage;circle(1,2,3)\ncircle(4,5,6)\n# format: hms\npie(150,-20,10,20)\nline(150,-20,150.1,-20)'
    rows = read(spark, text, "circle(7,8,9)", projection=p).orderBy("n").collect()
    assert [r.problem for r in rows] == [None] * 7
    one = spark.range(1)
    x, y = one.select(*p.to_pixel(F.lit(150.1), F.lit(-20.2))).first()
    assert rows[0].parameters[:2] == pytest.approx([x, y]) and rows[0].parameters[2] == pytest.approx(1.0, rel=1e-3)
    assert rows[1].parameters[:2] == pytest.approx([x, y]) and rows[1].parameters[2:] == pytest.approx([5.0, 5.0, 40.0], rel=1e-3)
    assert [list(r.parameters) for r in rows[2:4]] == [[1, 2, 3], [4, 5, 6]]
    assert rows[4].shape == "sector" and list(rows[4].parameters) == pytest.approx([50, 60, 40, 50])
    assert list(rows[5].parameters[:2]) == pytest.approx([50, 60])
    # A format doesn't reach into the next file.
    assert list(rows[6].parameters) == [7, 8, 9]


def test_what_is_no_region(spark):
    bad = ["circle(1,2)", "circle(1,2,3", "blob(1,2)", "circle(1,x,3)", "circle", "fk5;circle(1,2,3)", 'image;circle(1,2,3")', "# format: parsec", "polygon(1,2,3,4,5,6,7)", "box((1,2,3,4)", "image circle(1,2,3)"]
    df = read(spark, *bad)
    rows = df.collect()
    assert len(rows) == len(bad) and all(r.problem and r.shape is None for r in rows)
    with pytest.raises(ValueError):
        regions.in_region(spark.range(3), df, F.col("id"), F.col("id"))
    empty = read(spark, "", "# nothing\n\n")
    assert empty.count() == 0
    points = spark.range(3)
    assert regions.in_region(points, empty, F.col("id"), F.col("id")).count() == 0
    assert read(spark, "fk4;circle(1,2,3)", projection=Projection(180.0, 90.0)).where("problem like 'not in the projection%' or shape = 'circle'").count() == 1


def test_region_tables(spark):
    nan = math.nan
    rows = [
        (1, [1.0, None], [2.0, None], "CIRCLE", [3.0, 0.0], [0.0, 0.0], 1), (2, [1.0, None], [2.0, None], "!ROTBOX", [3.0, 4.0], [30.0, 0.0], 1),
        (3, [0.0, 4.0, 4.0, 0.0, 9.0], [0.0, 0.0, 4.0, 0.0, 9.0], "POLYGON", [], [], 2), (4, [0.0, 4.0, 4.0, None], [0.0, 0.0, 4.0, None], "Polygon", [], [], None),
        (5, [1.0, 3.0], [2.0, 4.0], "RECTANGLE", None, None, 2), (6, [1.0], [2.0], "PIE", [0.0, 0.0], [10.0, 20.0], 2), (7, [1.0], [2.0], "PIE", [3.0, 4.0], [10.0, 20.0], 2),
        (8, [1.0], [2.0], "POINT", None, None, 2), (9, [1.0], [2.0], "BOXANNULUS", [1.0, 2.0, 3.0, 4.0], [5.0, 6.0], 2), (10, [1.0], [2.0], "CIRCLE", None, None, 2),
    ]
    df = spark.createDataFrame(rows, "_row long, X array<double>, y array<double>, SHAPE string, R array<double>, ROTANG array<double>, COMPONENT int")
    got = [(r.shape, list(r.parameters), r.include, r.component) for r in region_files.shapes_of_table(df).orderBy("n").collect()]
    assert got == [
        ("circle", [1, 2, 3], True, 1), ("box", [1, 2, 3, 4, 30], False, 1), ("polygon", [0, 0, 4, 0, 4, 4], True, 2), ("polygon", [0, 0, 4, 0, 4, 4], True, 1), ("rectangle", [1, 2, 3, 4], True, 2),
        ("sector", [1, 2, 10, 20], True, 2), ("panda", [1, 2, 10, 20, 3, 4], True, 2), ("point", [1, 2], True, 2), ("boxannulus", [1, 2, 1, 2, 3, 4, 5, 6], True, 2), ("circle", [1, 2, None], True, 2),
    ]
    assert regions.in_region(spark.range(5), region_files.shapes_of_table(df), F.col("id"), F.lit(nan)).count() >= 0
    scalar = spark.createDataFrame([(1, 1.0, 2.0, "circle", 3.0, 0.0)], "_row int, x double, y double, shape string, r double, rotang double")
    assert list(region_files.shapes_of_table(scalar).first().parameters) == [1, 2, 3]
    with pytest.raises(ValueError):
        region_files.shapes_of_table(spark.range(1))


def test_shapes_of_one_text_are_not_gathered(spark):
    lines = spark.range(2000).select(F.lit("one").alias("path"), F.col("id").alias("line"), F.format_string("circle(%d, 2, 3)", "id").alias("value"))
    shapes = region_files.shapes_of_lines(lines)
    assert shapes.count() == 2000
    plan = shapes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
