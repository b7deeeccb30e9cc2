import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringe.functions import bits, nulls, sky, strings, vectors
from fringe.operators import checksum, groups, headers, histogram, images, intervals, ordered, regions, rows


def test_ordered_over_ranges(spark):
    values = [(i * 7 % 101, None if i % 9 == 0 else i) for i in range(101)]
    df = spark.createDataFrame(values, "k int, x int")
    plain = [x for _, x in sorted(values)]
    acc = [r.accum for r in ordered.accumulate(df, F.col("x"), "k").orderBy("k").collect()]
    assert acc == np.cumsum([x or 0 for x in plain]).tolist()
    diff = [r.seqdiff for r in ordered.sequence_difference(df, F.col("x"), "k").orderBy("k").collect()]
    assert diff == [None if a is None or b is None else b - a for a, b in zip([0, *plain], plain, strict=False)]
    assert [r.row for r in ordered.number_rows(df, "k").orderBy("k").collect()] == list(range(1, 102))
    off = [r.shifted for r in ordered.row_offset(df, "x", -2, "k").orderBy("k").collect()]
    assert off == [None, None, *plain[:-2]]
    assert ordered.accumulate(df.limit(0), F.col("x"), "k").count() == 0


def test_ordered_with_ties_and_clashing_names(spark):
    rows_ = [(k % 3, k, f"p{k}", 1) for k in range(40)] + [(None, 99, "n", 1)]
    df = spark.createDataFrame(rows_, "k int, x int, part string, tie int")
    runs = [ordered.number_rows(df, "k").select("k", "x", "part", "tie", "row").collect() for df in (df, df.repartition(3))]
    assert sorted(runs[0], key=str) == sorted(runs[1], key=str) and sorted(r.row for r in runs[0]) == list(range(1, 42))
    assert [r.k for r in sorted(runs[0], key=lambda r: r.row)] == [None] + [0] * 14 + [1] * 13 + [2] * 13
    again = ordered.accumulate(df, F.col("x"), ["k", "x"], "x")  # an alias that replaces a column
    assert again.columns == ["k", "part", "tie", "x"] and max(r.x for r in again.collect()) == sum(r[1] for r in rows_)


def test_running_sum_over_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, None, 2.0]), (2, []), (3, None), (4, [5.0])], "k int, v array<double>")
    got = [r.accum for r in ordered.accumulate_vectors(df, F.col("v"), "k").orderBy("k").collect()]
    assert got == [[1.0, 1.0, 3.0], [], None, [8.0]]


def test_integer_division_is_exact(spark):
    cases = [(2**53 + 1, 1), (-(2**53) - 1, 1), (7, -2), (-7, 2), (5, 0), (-(2**63), -1), (2**63 - 1, -1), (None, 3)]
    got = [r[0] for r in spark.createDataFrame(cases, "a long, b long").select(nulls.int_div(F.col("a"), F.col("b"))).collect()]
    assert got == [2**53 + 1, -(2**53) - 1, -3, -3, None, None, -(2**63) + 1, None]


def test_deeply_nested_groups(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 0)], "group_id long, member_id long")
    assert groups.reachable(edges, checkpoint_every=3).count() == 13 * 13


def test_intervals_keep_columns_of_their_own_names(spark):
    df = spark.createDataFrame([(1.0, 2, 3), (5.0, 2, 3)], "row_time double, row_bucket int, gti_bucket int")
    spans = spark.createDataFrame([(0.0, 2.0)], "start double, stop double")
    got = intervals.in_intervals(df, spans, F.col("row_time"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1.0, 2, 3)]


def test_intervals_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    gti = [(float(a), float(a + d)) for a, d in zip(rng.uniform(0, 100, 30), rng.uniform(0, 4, 30), strict=True)] + [(5.0, 5.0), (9.0, 8.0), (None, 1.0), (50.0, 60.0), (60.0, 61.0)]
    times = [*rng.uniform(-5, 110, 500).tolist(), 5.0, 60.0, 61.0, None, gti[0][0], gti[0][1]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double")
    g = spark.createDataFrame(gti, "start double, stop double")
    inside = [i for i, t in enumerate(times) if t is not None and any(a is not None and a <= t <= b for a, b in gti)]
    assert sorted(r.i for r in intervals.in_intervals(df, g, F.col("t")).collect()) == inside
    assert sorted(r.i for r in intervals.in_intervals(df, g, F.col("t"), inside=False).collect()) == [i for i in range(len(times)) if i not in inside]
    assert intervals.in_intervals(df, g.limit(0), F.col("t")).count() == 0
    merged = sorted((r.start, r.stop) for r in intervals.merge_intervals(g).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:], strict=False))


@pytest.mark.parametrize(
    ("name", "p", "inside", "outside"),
    [
        ("circle", (0, 0, 2), [(2, 0), (0, 0)], [(2, 0.1)]), ("annulus", (0, 0, 1, 2), [(1, 0), (0, 2)], [(0, 0), (2, 2)]), ("ellipse", (0, 0, 4, 1, 90), [(0, 4), (1, 0)], [(4, 0)]),
        ("elliptannulus", (0, 0, 2, 1, 4, 2), [(3, 0)], [(0, 0), (5, 0)]), ("box", (0, 0, 4, 2, 90), [(1, 2)], [(2, 1.5)]), ("boxannulus", (0, 0, 2, 2, 4, 4), [(1.5, 0)], [(0, 0), (3, 0)]),
        ("rectangle", (0, 0, 4, 2), [(0, 0), (4, 2)], [(5, 1)]), ("diamond", (0, 0, 4, 4), [(1, 1), (2, 0)], [(1.5, 1.5)]), ("sector", (0, 0, 350, 20), [(1, 0), (1, 0.3)], [(0, 1)]),
        ("point", (1, 1), [(1.2, 0.8)], [(1.6, 1)]), ("line", (0, 0, 10, 0), [(5, 0.4)], [(5, 0.6), (12, 0)]), ("polygon", (0, 0, 4, 0, 4, 4, 2, 1, 0, 4), [(3.5, 2), (2, 0.5)], [(2, 3), (5, 1)]),
        ("panda", (0, 0, 0, 90, 1, 2), [(1, 1)], [(-1, 1), (0.1, 0.1)]), ("epanda", (0, 0, 0, 90, 1, 1, 4, 2), [(3, 0.5)], [(-3, 0.5)]), ("bpanda", (0, 0, 0, 90, 1, 1, 4, 4), [(1.5, 1.5)], [(-1.5, 1.5), (0.2, 0.2)]),
    ],
)
def test_region_shapes(spark, name, p, inside, outside):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in inside + outside] + [(None, 1.0)], "x double, y double")
    got = [r.i for r in df.select(regions.inside(df.x, df.y, [regions.Shape(name, p)]).alias("i")).collect()]
    assert got == [True] * len(inside) + [False] * (len(outside) + 1)


def test_region_signs_and_components(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.5, 0.0), (9.0, 0.0), (50.0, 50.0)], "x double, y double")
    has = lambda *s: [r.i for r in df.select(regions.inside(df.x, df.y, s).alias("i")).collect()]
    S = regions.Shape
    assert has(S("circle", (0, 0, 2)), S("circle", (0, 0, 1), False)) == [False, True, False, False]
    assert has(S("circle", (0, 0, 2), False)) == [False, False, True, True]
    assert has(S("circle", (0, 0, 1)), S("circle", (9, 0, 1), component=2)) == [True, False, True, False]


def test_histogram_rules(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.5, 0.0), (3, 1.0, 4.0), (None, 0.2, 1.0), (4, 2.0, 5.0)], "i int, x double, w double")
    H = histogram.Axis
    count = lambda axes, **o: {tuple(r[f"bin_{k + 1}"] for k in range(len(axes))): r.total for r in histogram.histogram(df, axes, **o).collect()}
    assert count([H("i", 1, 3, 1, integer=True)]) == {(0,): 2, (2,): 1}
    assert count([H("x", 0, 2, 0.5)]) == {(0,): 2, (1,): 1, (2,): 1}
    assert count([H("x", None, None, 0.5)]) == {(0,): 2, (1,): 1, (2,): 1, (4,): 1}
    assert count([H("x", 0, 2, 1), H("i", 1, 4, 1, integer=True)], weight=F.col("w"), where=F.col("w") > 0) == {(0, 0): 2.0, (1, 2): 4.0}
    assert count([H("x", 0, 2, 1, single=True)], weight=F.col("w"), reciprocal=True) == {(0,): 1.5, (1,): 0.25}
    with pytest.raises(ValueError):
        histogram.histogram(df, [])


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(i, i * 1.5, None if i == 3 else i) for i in range(1, 7)], "row int, Col1 double, COL_2 int")
    assert rows.row_ranges("-2, 4, 6-") == [(1, 2), (4, 4), (6, 2**62)]
    for bad in ("3-1", "5, 4", "x", "0"):
        with pytest.raises(ValueError):
            rows.row_ranges(bad)
    assert [r.row for r in rows.delete_rows(df, "row", rows.row_ranges("-2, 4")).collect()] == [3, 5, 6]
    assert [r.good for r in rows.flag_rows(df, F.col("COL_2") > 2).orderBy("row").collect()] == [False, False, False, True, True, True]
    assert rows.first_row(df, F.col("COL_2") > 100, "row").count() == 0
    assert rows.keep_columns(df, "col#").columns == ["Col1"] and rows.drop_columns(df, "c*").columns == ["row"]
    assert [r.new for r in rows.calculate(df, "new", F.lit(1), "row", [(2, 3)]).orderBy("row").collect()] == [None, 1, 1, None, None, None]
    assert rows.result_type(df, F.col("row") / 2) == "double"
    wide = rows.housekeeping(spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (3, "a", 2.0), (4, "c", 0.0)], "t int, p string, v double"), "t", "p", "v", ["a", "b"])
    assert [tuple(r) for r in wide.orderBy("t").collect()] == [(1, 1.0, None), (2, 1.0, 5.0), (3, 2.0, 5.0)]


def test_null_rules(spark):
    df = spark.createDataFrame([(-2.5, 0, 7), (2.5, 2, -7), (None, 3, 7), (0.25, None, 7)], "x double, z int, n int")
    one = lambda c: [r.c for r in df.select(c.alias("c")).collect()]
    assert one(nulls.round_half_up(df.x)) == [-2.0, 3.0, None, 0.0] and one(nulls.round_half_away(df.x)) == [-3.0, 3.0, None, 0.0]
    assert one(nulls.int_div(df.n, df.z)) == [None, -3, 2, None] and one(nulls.int_mod(df.n, df.z)) == [None, -1, 1, None]
    assert one(nulls.arcsin(df.x))[:2] == [None, None] and one(nulls.sqrt(df.x))[0] is None and one(nulls.log(df.x))[0] is None
    assert one(nulls.if_else(df.x > 0, F.lit("y"), F.lit("n"))) == ["n", "y", None, "y"] and one(nulls.least_of(df.x, df.z.cast("double"))) == [-2.5, 2.0, 3.0, 0.25]
    assert one(nulls.to_int(df.x)) == [-2, 2, None, 0] and one(nulls.int_power(df.z, F.lit(2))) == [0, 4, 9, None]
    draws = one(nulls.poisson(F.lit(40.0), df.n))
    assert all(10 < d < 90 for d in draws) and one(nulls.poisson(df.x, df.n))[0] is None


def test_vectors_strings_bits(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 2.0], "abc", 10), ([None], "", 0), ([], None, 5), (None, "cab", None), ([5.0], "c", 1)], "v array<double>, s string, b long")
    one = lambda c: [r.c for r in df.select(c.alias("c")).collect()]
    assert one(vectors.total(df.v)) == [6.0, None, None, None, 5.0] and one(vectors.stddev(df.v)) == [1.0, None, None, None, 0.0]
    assert one(vectors.median(df.v)) == [2.0, None, None, None, 5.0] and one(vectors.n_valid(df.v)) == [3, 0, 0, None, 1] and one(vectors.average(df.v))[0] == 2.0
    assert one(vectors.element(df.v, 4)) == [2.0, None, None, None, None] and one(vectors.element(df.v, 2, 2, dims=(2, 2)))[0] == 2.0 and one(vectors.element(df.v, 3, 1, dims=(2, 2)))[0] is None
    assert one(vectors.resize(df.v, 2)) == [[3.0, None], [None, None], [None, None], None, [5.0, None]]
    assert one(strings.str_mid(df.s, 2, 5)) == ["bc", "", None, "ab", ""] and one(strings.str_mid(df.s, 0, 1)) == [None] * 5 and one(strings.str_find(df.s, "c")) == [3, None, None, 1, 1]
    assert one(bits.equal(df.b, "1x10")) == [True, False, False, None, False] and one(bits.inverse(df.b, 4)) == [5, 15, 10, None, 14] and one(bits.count_ones(df.b)) == [2, 0, 2, None, 1]


def test_sky(spark):
    df = spark.createDataFrame([(0.0, 90.0, 10.0, -90.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 90.0, 0.0)], "a double, b double, c double, d double")
    assert [round(r.s, 9) for r in df.select(sky.angular_separation(df.a, df.b, df.c, df.d).alias("s")).collect()] == [180.0, 0.0, 90.0]
    for kind in sky.PROJECTIONS:
        p = sky.Projection(30.0, 50.0, kind=kind)
        ra, dec = p.to_sky(F.lit(0.0), F.lit(0.0))
        row = df.limit(1).select(ra.alias("ra"), dec.alias("dec")).first()
        assert abs(row.ra - 30) < 1e-9 and abs(row.dec - p.dec) < 1e-9, kind
    far = sky.Projection(0.0, 90.0, kind="SIN").to_sky(F.lit(80.0), F.lit(80.0))
    assert df.limit(1).select(far[0].alias("x")).first().x is None
    with pytest.raises(ValueError):
        sky.Projection(0, 0, kind="XYZ")
    head = {"CRVAL1": 10.0, "CRVAL2": 20.0, "CRPIX1": 5.0, "CRPIX2": 6.0, "CDELT1": -0.1, "CDELT2": 0.2, "CROTA2": 30.0, "CTYPE1": "RA---SIN"}
    assert sky.Projection.from_header(head) == sky.Projection(10.0, 20.0, 5.0, 6.0, -0.1, 0.2, 30.0, "SIN")
    cd = sky.Projection.from_header({"CD1_1": -0.1, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.1})
    assert (cd.x_step, cd.y_step, cd.kind) == (-0.1, 0.1, "CAR") and abs(math.cos(math.radians(cd.rotation)) - 1) < 1e-9


def test_images(spark):
    px = spark.createDataFrame([(y, x, float(y * 10 + x) if (y, x) != (2, 2) else None) for y in range(1, 4) for x in range(1, 8)], "y int, x int, value double")
    cut = images.section(px, y=images.Span(2, 3), x=images.Span(1, 7, 3, flip=True))
    assert {(r.y, r.x): r.value for r in cut.collect()} == {(1, 3): 21.0, (1, 2): 24.0, (1, 1): 27.0, (2, 3): 31.0, (2, 2): 34.0, (2, 1): 37.0}
    s = images.statistics(px).first()
    assert (s.n_good, s.low, s.high) == (20, 11.0, 37.0) and s.noise3 >= 0
    twice = images.combine({"a": px, "b": px}, ["y", "x"], F.col("a") + F.col("b"))
    assert twice.where("value is not null").count() == 20
    stored = px.select("value", images.restore(images.quantize(F.col("value"), 0.5, 1.0, F.lit(0.3)), 0.5, 1.0, F.lit(0.3)).alias("r")).where("value is not null").collect()
    assert all(abs(r.value - r.r) <= 0.25 for r in stored)
    assert {r.x: r.value for r in images.project(px.where("y = 1"), "x").collect()}[7] == 17.0


def test_groups(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 10), (3, 11), (1, 10)], "group_id int, member_id int")
    got = {(r.group_id, r.member_id): r.depth for r in groups.reachable(e).collect()}
    assert got[1, 11] == 3 and got[1, 1] == 3 and got[1, 10] == 1 and len(got) == 15
    assert {r.group_id: r.n_members for r in groups.count_members(e).collect()} == {1: 2, 2: 1, 3: 2}
    assert {(r.group_id, r.member_id) for r in groups.compact(e, 1).where("group_id = 1").collect()} == {(1, 10), (1, 11)}
    assert groups.remove_group(e, 2).count() == 4 and groups.remove_group(e, 1, recursive=True).count() == 0
    assert groups.merge(e, 3, 1).where("group_id = 1").count() == 4 and groups.copy_group(e, 3, 9).where("group_id = 9").count() == 2
    assert groups.remove_member(groups.add_member(e, 5, 6), 5, 6).count() == 5
    tables = spark.createDataFrame([(i,) for i in (1, 2, 3, 10)], "table_id int")
    assert [r.member_id for r in groups.broken_links(e, tables).collect()] == [11]
    assert groups.reachable(e.limit(0)).count() == 0


def test_headers(spark):
    h = spark.createDataFrame([(1, "NAXIS1", "5", ""), (2, "OBJECT", "'x'", "name"), (3, "TFORM2", "'1D'", "")], "pos int, key string, value string, comment string")
    c = spark.createDataFrame([("OBJECT", "'y'", None), ("NEW", "3", "n")], "key string, value string, comment string")
    assert [tuple(r) for r in headers.upsert(h, c).orderBy("pos").collect()] == [(1, "NAXIS1", "5", ""), (2, "OBJECT", "'y'", "name"), (3, "TFORM2", "'1D'", ""), (4, "NEW", "3", "n")]
    assert [r.key for r in headers.find(h, "naxis#").collect()] == ["NAXIS1"] and headers.delete(h, "OBJECT").count() == 2 and headers.rename(h, "OBJECT", "TARGET").where("key = 'TARGET'").count() == 1
    kinds = spark.createDataFrame([("T",), ("'a'",), ("1",), ("1.5D3",), ("(1, 2)",), ("",)], "v string")
    assert [r.t for r in kinds.select(headers.value_type(kinds.v).alias("t")).collect()] == ["L", "C", "I", "F", "X", None]
    times = spark.createDataFrame([("2001-02-03T04:05:06",), ("2001-02-03",), ("03/02/99",), ("x",)], "t string")
    assert [r.t for r in times.select(headers.parse_time(times.t).cast("string").alias("t")).collect()] == ["2001-02-03 04:05:06", "2001-02-03 00:00:00", "1999-02-03 00:00:00", None]


def test_checksum(spark):
    data = [bytes([255] * 8), b"abcde", b"", b"\x00\x00\x00\x01"]
    total = 0
    for d in data:
        d = d + b"\0" * (-len(d) % 4)
        total += sum(int.from_bytes(d[i : i + 4], "big") for i in range(0, len(d), 4))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    df = spark.createDataFrame([(d,) for d in data], "data binary")
    assert checksum.checksum(df).first().checksum == total and checksum.checksum(df.limit(0)).first().checksum == 0
    assert datetime.date(2000, 1, 1)
