"""Checksum algebra, masked bits, member lookup, chunk work, linear world coordinates, headers of many files."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringe.functions import masked_bits as mb
from fringe.functions import sky
from fringe.operators import checksum, groups, headers, ordered


def plain_sum(data):
    data += b"\0" * (-len(data) % 4)
    total = int(np.frombuffer(data, ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def test_checksums_of_parts_and_updates(spark):
    rng = random.Random(1)
    whole = bytes(rng.randrange(256) for _ in range(5_000))
    cuts = sorted({0, 5_000, *(rng.randrange(5_000) for _ in range(30))})
    parts = [(1, a, whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    df = spark.createDataFrame([*parts, (2, 0, b"\xff" * 8), (3, 0, None)], "k int, place long, data binary")
    sums = checksum.checksum(df, keys=["k"], place="place")
    got = {r.k: r.checksum for r in sums.collect()}
    assert got[1] == plain_sum(whole) and got[2] == 0xFFFFFFFF and got[3] == 0
    changes, after = [], bytearray(whole)
    for at, old in rng.sample([(a, d) for _, a, d in parts], 8):
        new = bytes(rng.randrange(256) for _ in old)
        after[at : at + len(old)] = new
        changes.append((1, at, old, new))
    added = b"more bytes"
    changes.append((1, 5_000, None, added))
    new_sums = checksum.updated(sums, spark.createDataFrame([*changes, (4, 2, None, b"ab")], "k int, place long, old binary, new binary"), ["k"])
    got = {r.k: r.checksum for r in new_sums.collect()}
    assert got[1] % 0xFFFFFFFF == plain_sum(bytes(after) + added) % 0xFFFFFFFF and got[2] == 0xFFFFFFFF and got[4] == plain_sum(b"\0\0ab")


def test_checksum_texts_and_verification(spark):
    values = [0, 1, 0xFFFFFFFF, 868229149, 0x3A405B60, *range(1 << 20, 1 << 32, 98_765_431)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    v = F.col("v")
    rows = df.select("v", checksum.to_text(v).alias("c"), checksum.to_text(v, False).alias("p")).withColumns({"c2": checksum.from_text(F.col("c")), "p2": checksum.from_text(F.col("p"), False), "bad": checksum.from_text(F.lit("short"))}).collect()
    assert all(r.c2 % 0xFFFFFFFF == r.v % 0xFFFFFFFF == r.p2 % 0xFFFFFFFF and r.c.isalnum() and len(r.c) == 16 and r.bad is None for r in rows)
    # A text put where sixteen zeros were, at a place that is a whole word but for the quote before it.
    body = b"header '" + b"0" * 16 + b"' and what follows it" + bytes(range(200))
    assert len(b"header ") % 4 == 3
    total = plain_sum(body)
    text = df.limit(1).select(checksum.to_text(F.lit(total)).alias("t")).first().t.encode()
    signed = body.replace(b"0" * 16, text[1:] + text[:1])
    blocks = [("good", 0, signed), ("flipped", 0, signed[:100] + bytes([signed[100] ^ 4]) + signed[101:]), ("cut", 0, signed[:50]), ("cut", 50, signed[50:])]
    ok = {r.k: r.ok for r in checksum.verified(spark.createDataFrame(blocks, "k string, place long, data binary"), ["k"]).collect()}
    assert ok == {"good": True, "flipped": False, "cut": True}


def plain_bits(op, a, b):
    n = max(len(a), len(b))
    a, b = a.lower().rjust(n, "0"), b.lower().rjust(n, "0")
    pairs = list(zip(a, b, strict=True))
    if op == "both":
        return "".join("x" if "x" in p else "1" if p == ("1", "1") else "0" for p in pairs)
    if op == "either":
        return "".join("1" if "1" in p else "0" if "0" in p else "x" for p in pairs)
    known = [p for p in pairs if "x" not in p]
    x, y = (int("".join(p[i] for p in known) or "0", 2) for i in (0, 1))
    return {"equal": all(p[0] == p[1] for p in known), "less": x < y, "less_or_equal": x <= y}[op]


def test_masked_bits(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("01xX") for _ in range(n))
    pairs = [(word(n), word(m)) for n in (0, 1, 7, 59, 60, 61, 64, 130) for m in (0, 3, 60, 64, 121) for _ in range(2)] + [(w, w.replace("x", "0").replace("X", "1")) for w in map(word, (20, 64, 90))]
    df = spark.createDataFrame([*pairs, (None, "01"), ("012", "1")], "a string, b string")
    a, b = mb.parse(F.col("a")), mb.parse(F.col("b"))
    parsed = df.withColumns({"p": a, "q": b})
    a, b = F.col("p"), F.col("q")
    rows = parsed.select(
        "a", "b", a.alias("again"), mb.both(a, b).alias("both"), mb.either(a, b).alias("either"), mb.inverse(a).alias("inverse"), mb.join(a, b).alias("join"),
        mb.equal(a, b).alias("equal"), mb.less(a, b).alias("less"), mb.less_or_equal(a, b).alias("less_or_equal"), mb.count_ones(a).alias("ones"),
    ).collect()
    for r in rows[:-2]:
        low = r.a.lower()
        assert r.again == low and r.inverse == low.translate(str.maketrans("01", "10")) and r.join == low + r.b.lower() and r.ones == low.count("1")
        assert all(r[op] == plain_bits(op, r.a, r.b) for op in ("both", "either", "equal", "less", "less_or_equal")), (r.a, r.b)
    assert all(value is None for r in rows[-2:] for value in r[2:])


def test_members_by_reference(spark):
    tables = [
        (1, "/data/a.fits", "BINTABLE", "EVENTS", 1, 2), (2, "/data/a.fits", "BINTABLE", "EVENTS", 1, 5), (3, "/data/a.fits", "IMAGE", "EVENTS", 1, 3), (4, "/data/sub/b.fits", "BINTABLE", "GTI", None, 1),
        (5, "/data/c.fits", "IMAGE", "", None, 0), (6, "http://host/d.fits", "BINTABLE", "gti", 2, 7),
    ]
    members = [
        ("exact", None, "bintable", "events", 1, 5), ("moved", "", "BINTABLE", "EVENTS", None, 9), ("other type", None, "IMAGE", "EVENTS", 1, 3), ("relative", "sub/../sub/./b.fits", "BINTABLE", "GTI", 1, 4),
        ("by place", "c.fits", None, None, None, 0), ("wrong type", "c.fits", "BINTABLE", None, None, 0), ("url", "http://host/d.fits", "BINTABLE", "GTI", 2, 1), ("missing", "e.fits", "BINTABLE", "GTI", 1, 1),
        ("again", None, "IMAGE", "EVENTS", 1, 8),
    ]
    t = spark.createDataFrame(tables, "table_id int, location string, type string, name string, version int, position int")
    m = spark.createDataFrame([(x[0], "/data/a.fits", *x[1:]) for x in members], "what string, group_location string, member_location string, type string, name string, version int, position int")
    got = {r.what: (r.table_id, r.matched_by) for r in groups.find_members(m, t).collect()}
    assert got == {
        "exact": (2, "name"), "moved": (1, "name"), "other type": (3, "name"), "relative": (4, "name"), "by place": (5, "position"), "wrong type": (None, None), "url": (6, "name"), "missing": (None, None), "again": (None, None),
    }
    assert groups.find_members(m.limit(0), t).count() == 0 and groups.find_members(m, t.limit(0)).where("table_id is not null").count() == 0


@pytest.mark.parametrize("chunk_rows", [7, 50, 5_000])
def test_chunks_with_state_and_stop(spark, chunk_rows):
    """A running sum by chunks that stops in the chunk in which it passes a bound."""
    df = spark.range(1_000).selectExpr("id", "id * 7 % 100 as v").repartition(5)
    sums = ordered.Carried(0, lambda chunk: int(chunk["v"].sum()), lambda a, b: a + b)

    def work(chunk, first, total, before):
        assert total == 1_000 and chunk["id"].iloc[0] == first
        upto = before + chunk["v"].cumsum()
        return pd.DataFrame({"id": chunk["id"], "upto": upto, "first": first}), bool(upto.iloc[-1] > 20_000)

    got = ordered.work_in_chunks(df, "id", work, "id long, upto long, first long", chunk_rows, sums).toPandas().sort_values("id")
    whole = np.cumsum(np.arange(1_000) * 7 % 100)
    # Chunks begin anew in each range, so the last one is where the first chunk end beyond the bound lies.
    assert got["upto"].tolist() == whole[: len(got)].tolist() and got["id"].tolist() == list(range(len(got)))
    assert got["upto"].iloc[-1] > 20_000 or len(got) == 1_000
    assert (got.groupby("first")["upto"].max().iloc[:-1] <= 20_000).all()


def test_chunks_without_state(spark):
    out = ordered.work_in_chunks(spark.range(100), "id", lambda c, first, total, state: (pd.DataFrame({"n": [len(c)]}), False), "n long", 30)
    assert out.groupBy().sum("n").first()[0] == 100
    assert ordered.work_in_chunks(spark.range(0), "id", lambda c, *_: (c, False), "id long").count() == 0


def test_skewed_matrices_and_poles(spark):
    points = spark.createDataFrame([(float(x), float(y)) for x in range(-20, 21, 5) for y in range(-20, 21, 5)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    for kind in sky.PROJECTIONS:
        p = sky.Projection(30.0, 0.0 if kind == "AIT" else 50.0, 1.0, 2.0, kind=kind, matrix=(0.1, 0.03, -0.02, 0.12), pole=150.0 if kind in sky.ABOUT_A_POINT else 180.0)
        ra, dec = p.to_sky(x, y)
        back = points.select("x", "y", *[c.alias(n) for c, n in zip(p.to_pixel(ra, dec), "uv", strict=True)])
        assert back.select(F.max(F.abs(F.col("u") - x)), F.max(F.abs(F.col("v") - y)), F.count("u")).first()[2] == 81
        assert all(abs(r.u - r.x) < 1e-6 and abs(r.v - r.y) < 1e-6 for r in back.collect())
    plain = sky.Projection(30.0, 50.0, 1.0, 2.0, -0.1, 0.2, 25.0)
    c, s = math.cos(math.radians(25)), math.sin(math.radians(25))
    same = sky.Projection.from_header({"CRVAL1": 30, "CRVAL2": 50, "CRPIX1": 1, "CRPIX2": 2, "CTYPE1": "RA---TAN", "CD1_1": -0.1 * c, "CD1_2": -0.2 * s, "CD2_1": -0.1 * s, "CD2_2": 0.2 * c})
    pc = sky.Projection.from_header({"CRVAL1": 30, "CRVAL2": 50, "CRPIX1": 1, "CRPIX2": 2, "CTYPE1": "RA---TAN", "CDELT1": -0.1, "CDELT2": 0.2, "PC1_1": c, "PC1_2": 2 * s, "PC2_1": -s / 2, "PC2_2": c})
    table = {"TTYPE3": "X", "TTYPE7": "y", "TCRVL3": 30, "TCRVL7": 50, "TCRPX3": 1, "TCRPX7": 2, "TCDLT3": -0.1, "TCDLT7": 0.2, "TCROT7": 25.0, "TCTYP3": "RA---TAN"}
    events = sky.Projection.from_table_header(table, "x", "Y")
    turned = sky.Projection.from_header({"CRVAL1": 50, "CRVAL2": 30, "CRPIX1": 2, "CRPIX2": 1, "CTYPE1": "DEC--TAN", "CTYPE2": "RA---TAN", "CDELT1": 0.2, "CDELT2": -0.1})
    assert (turned.ra, turned.dec, turned.x_pixel, turned.x_step) == (30, 50, 1, -0.1)
    want = points.select(*plain.to_sky(x, y)).collect()
    for other in (same, events):
        assert np.allclose(points.select(*other.to_sky(x, y)).collect(), want)
    assert pc.matrix is not None and np.allclose(pc.matrix, (-0.1 * c, -0.2 * s, -0.1 * s, 0.2 * c))
    # A pole at 180 + t turns the map by -t.
    pole = sky.Projection(30.0, 50.0, 0.0, 0.0, 0.1, 0.1, 0.0, "SIN", pole=205.0)
    assert np.allclose(points.select(*pole.to_sky(x, y)).collect(), points.select(*sky.Projection(30.0, 50.0, 0.0, 0.0, 0.1, 0.1, -25.0, "SIN").to_sky(x, y)).collect())
    with pytest.raises(ValueError):
        sky.Projection(0.0, 0.0, kind="CAR", pole=90.0)
    with pytest.raises(ValueError):
        sky.Projection.from_table_header(table, "x", "z")


def test_headers_of_many_files(spark):
    rows = [(f, 0, 1, "SIMPLE", "T", "") for f in "ab"] + [("a", 0, 2, "COMMENT", "", "one"), ("a", 0, 3, "COMMENT", "", "two"), ("b", 0, 2, "OBJECT", "'x'", ""), ("a", 1, 1, "XTENSION", "'IMAGE'", "")]
    h = spark.createDataFrame(rows, "path string, hdu int, pos int, key string, value string, comment string")
    c = spark.createDataFrame([("a", 0, "COMMENT", None, "new"), ("a", 0, "OBJECT", "'y'", ""), ("b", 0, "OBJECT", "'z'", "")], "path string, hdu int, key string, value string, comment string")
    got = sorted(tuple(r) for r in headers.upsert(h, c).collect())
    assert got == [
        ("a", 0, 1, "SIMPLE", "T", ""), ("a", 0, 2, "COMMENT", "", "new"), ("a", 0, 3, "COMMENT", "", "two"), ("a", 0, 4, "OBJECT", "'y'", ""), ("a", 1, 1, "XTENSION", "'IMAGE'", ""), ("b", 0, 1, "SIMPLE", "T", ""),
        ("b", 0, 2, "OBJECT", "'z'", ""),
    ]
    with pytest.raises(ValueError, match="need columns"):
        headers.upsert(h, c.drop("hdu"))


def test_orders_over_maps_and_filled_values(spark):
    df = spark.range(50).selectExpr("id", "map('a', id) as m", "case when id % 9 = 4 then id end as v", "array(id, null, id * 2) as w")
    assert ordered.number_rows(df, "id").where("row = id + 1").count() == 50
    filled = ordered.last_values(df.drop("m"), ["v"], "id").orderBy("id").collect()
    assert [r.v for r in filled] == [None if i < 4 else (i - 4) // 9 * 9 + 4 for i in range(50)]
    sums = ordered.accumulate_vectors(df.where("id < 3"), F.col("w"), "id").orderBy("id").collect()
    assert [r.accum for r in sums] == [[0.0, 0.0, 0.0], [1.0, 1.0, 3.0], [5.0, 5.0, 9.0]]
