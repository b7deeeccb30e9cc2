import numpy as np
import pytest
from pyspark.sql import functions as F

from fringe.operators import headers
from fringe.sources import fits, fits_source


@pytest.fixture(scope="module")
def spark(spark):
    fits_source.register(spark)
    return spark


def test_cells_with_dimensions(spark, tmp_path):
    """Numbers in the order of TDIM, strings along its first dimension; a TDIM that doesn't fit says nothing."""
    n = 5
    cube = np.arange(n * 24, dtype=">i4").reshape(n, 24)
    names = np.array([f"{k}a".ljust(3) + f"{k}bb".ljust(3) for k in range(n)], "S6")
    (tmp_path / "a.fits").write_bytes(fits.encode_table({"cube": cube, "names": names, "flat": cube[:, :4], "one": cube[:, 0]}, {"TDIM1": "(4,3,2)", "TDIM2": "(3,2)", "TDIM3": "(3,2)", "TDIM4": "(1)", "TNULL1": 25}))
    df = spark.read.format("fits_table").load(str(tmp_path))
    assert dict(df.dtypes) == {"_row": "bigint", "cube": "array<array<array<int>>>", "names": "array<string>", "flat": "array<int>", "one": "int", "_problem": "string"}
    for r in df.collect():
        want = cube[r._row - 1].reshape(2, 3, 4).tolist()
        assert r.cube == [[[None if v == 25 else v for v in line] for line in plane] for plane in want]
        assert r.names == [f"{r._row - 1}a", f"{r._row - 1}bb"] and r.flat == cube[r._row - 1, :4].tolist() and r._problem is None
    assert fits.read_table(spark, str(tmp_path)).drop("_row").collect() == df.drop("_row").collect()


def test_nested_arrays_round_trip(spark, tmp_path):
    """Shorter arrays are filled up with nulls on each level; null and empty arrays come back as nulls alone."""
    rows = [(1, [[1.5, 2.0], [3.0]], [1]), (2, [[4.0, None, 6.0]], []), (3, None, None), (4, [None, []], [2, None, 4])]
    spark.createDataFrame(rows, "k int, a array<array<double>>, b array<long>").coalesce(1).write.format("fits_table").mode("append").save(str(tmp_path / "t"))
    df = spark.read.format("fits_table").load(str(tmp_path / "t"))
    got = {r.k: (r.a, r.b) for r in df.collect()}
    none = [None] * 3
    assert got == {1: ([[1.5, 2.0, None], [3.0, None, None]], [1, None, None]), 2: ([[4.0, None, 6.0], none], none), 3: ([none, none], none), 4: ([none, none], [2, None, 4])}
    spark.createDataFrame([], "a array<array<int>>").coalesce(1).write.format("fits_table").mode("append").save(str(tmp_path / "empty"))
    assert spark.read.format("fits_table").load(str(tmp_path / "empty")).count() == 0


def test_bytes_and_file_of_rows(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.fits").write_bytes(fits.encode_table({"x": np.arange(3, dtype=">i2"), "s": np.array(["u", "vw", name], "S2")}))
    df = spark.read.format("fits_table").options(raw="true", file="true", columns="x").load(str(tmp_path))
    assert df.columns == ["_row", "x", "_raw", "_file", "_problem"]
    got = {(r._file.rsplit("/", 1)[1], r._row): (r.x, bytes(r._raw)) for r in df.collect()}
    assert got["b.fits", 3] == (2, b"\x00\x02b\x00") and got["a.fits", 2] == (1, b"\x00\x01vw") and len(got) == 6
    assert spark.read.format("fits_table").option("raw", "true").load(str(tmp_path / "none")).columns == ["_row", "_raw", "_problem"]


def test_headers_cost_their_blocks(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.encode({"BITPIX": 8, "NAXIS": 0, "OBJECT": "it's"}) + fits.encode_image(np.zeros((200, 300), ">f4"), {"EXTNAME": "SKY"}, primary=False))
    (tmp_path / "b.fits").write_bytes(b"")
    df = spark.read.format("fits_header").load(str(tmp_path))
    names = {r.path.rsplit("/", 1)[1] for r in df.select("path").distinct().collect()}
    assert names == {"a.fits"} and df.where("key = 'EXTNAME'").first().hdu == 1
    same = fits.read_headers(spark, str(tmp_path)).drop("path")
    assert sorted(df.drop("path").collect()) == sorted(same.collect())
    reader = fits_source.HeaderReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 2


def test_what_is_missing_of_the_data_is_said(spark, tmp_path):
    """A file that ends too soon is reported by the range that meets its end, and what lies before is read."""
    image = fits.encode_image(np.arange(200 * 100, dtype=">i4").reshape(200, 100))
    (tmp_path / "image.fits").write_bytes(image[: fits.BLOCK + 120 * 400])
    df = spark.read.format("fits_image").option("split_bytes", 20_000).load(str(tmp_path)).cache()
    assert df.where("problem is not null").count() >= 1 and df.where("problem is null and y <= 40").count() == 4000
    table = fits.encode_table({"x": np.arange(5000, dtype=">i8")})
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "table.fits").write_bytes(table[:25_000])
    rows = spark.read.format("fits_table").option("split_bytes", 10_000).load(str(tmp_path / "t")).cache()
    assert rows.where("_problem is not null").count() >= 1 and rows.where("x < 100").count() == 100


@pytest.mark.parametrize("pixels", ["u1", "<i2", ">i2", "u2", ">u2", "i4", ">f4", "<f8"])
def test_images_without_a_header(spark, tmp_path, pixels):
    values = np.arange(3 * 4 * 5).reshape(3, 4, 5).astype(np.dtype(pixels if pixels[0] in "<>" else f"<{pixels}"))
    if values.dtype.kind == "f":
        values[0, 0, 0] = np.nan
    if values.dtype == np.dtype("u2"):
        values[0, 0, 1] = 65535
    (tmp_path / "x.dat").write_bytes(b"head" * 3 + values.tobytes() + b"tail")
    options = {"pixels": pixels, "shape": "5, 4, 3", "offset": 12, "split_bytes": 50}
    got = {(r.plane, r.y, r.x): r.value for r in spark.read.format("raw_image").options(**options).load(str(tmp_path)).collect()}
    assert len(got) == 60 and all(got[p + 1, y + 1, x + 1] == (None if np.isnan(float(v)) else float(v)) for (p, y, x), v in np.ndenumerate(values))
    part = spark.read.format("raw_image").options(**options, section="2:4:2,3,*").load(str(tmp_path)).where("plane > 1")
    assert sorted((r.plane, r.y, r.x) for r in part.collect()) == [(p, 3, x) for p in (2, 3) for x in (2, 4)]


def test_raw_images_that_cannot_be(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(bytes(10))
    rows = spark.read.format("raw_image").options(pixels="i2", shape="4,2").load(str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].problem
    for options in ({"pixels": "i3", "shape": "4"}, {"pixels": "i2"}, {"pixels": "i2", "shape": "0,4"}):
        with pytest.raises(Exception, match="no (pixels|shape)"):
            spark.read.format("raw_image").options(**options).load(str(tmp_path)).collect()


def test_values_of_cards(spark):
    df = spark.createDataFrame([("'it''s  '",), ("T",), ("1.5D3",), ("42",), ("",), ("(1,2)",)], "value string")
    v = F.col("value")
    got = df.select(*[headers.typed_value(v, k).alias(k) for k in ("string", "boolean", "long", "double")]).collect()
    assert [tuple(r) for r in got] == [("it's", None, None, None), ("T", True, None, None), ("1.5D3", None, None, 1500.0), ("42", None, 42, 42.0), (None, None, None, None), ("(1,2)", None, None, None)]
    texts = spark.createDataFrame([("it's", True, 3, None)], "s string, b boolean, n long, d double")
    made = texts.select(*[headers.card_value(F.col(c), k) for c, k in (("s", "string"), ("b", "boolean"), ("n", "long"), ("d", "double"))]).first()
    assert list(made) == ["'it''s   '", "T", "3", ""]
    with pytest.raises(ValueError):
        headers.typed_value(v, "date")


def test_keywords_in_rows_and_from_rows(spark):
    """The first card counts, in any case; files without the key, rows without a file and clashing names."""
    header = spark.createDataFrame(
        [("a", 0, 1, "GAIN", "2.0", ""), ("a", 1, 1, "gain", "3.0", ""), ("a", 1, 2, "NAME", "'n'", ""), ("b", 1, 1, "GAIN", "'x'", "c"), ("c", 1, 4, "GAIN", "9", ""), ("c", 1, 5, "GAIN", "8", "")],
        "path string, hdu int, pos int, key string, value string, comment string",
    )
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30), ("d", 4, 40), (None, 5, 50)], "_file string, path int, gain int")
    got = headers.with_keywords(rows, header, {"gain": ("Gain", "double"), "label": ("NAME", "string")}).orderBy("path").collect()
    assert [(r.path, r.gain, r.label) for r in got] == [(1, 2.0, "n"), (2, 2.0, "n"), (3, None, None), (4, None, None), (5, None, None)]
    assert headers.with_keywords(rows.limit(0), header, {"gain": ("GAIN", "double")}).count() == 0

    done = headers.calculate_keywords(header, rows, {"gain": (F.sum("gain"), "long"), "NEW": (F.max("path").cast("string"), "string")})
    cards = {(r.path, r.hdu, r.pos): (r.key, r.value, r.comment) for r in done.collect()}
    assert cards["a", 0, 1] == ("GAIN", "2.0", "") and cards["c", 1, 4] == ("GAIN", "9", "") and cards["c", 1, 5] == ("GAIN", "8", "")
    assert cards["b", 1, 1] == ("GAIN", "30", "") and cards["b", 1, 2] == ("NEW", "'3       '", "")
    assert ("NEW", "'2       '", "") in [v for k, v in cards.items() if k[:2] == ("a", 1)]


@pytest.mark.parametrize("kind", ["f4", "i2", "i8"])
def test_images_written_as_streams(spark, tmp_path, kind, monkeypatch):
    """Gaps, nulls, repeated pixels, planes without rows, and files that share a task."""
    width, height, planes = 40, 30, 9
    rng = np.random.default_rng(3)
    cells = {(int(p), int(y), int(x)): float(v) for p, y, x, v in zip(rng.choice([1, 2, 3, 6, 9], 3000), rng.integers(1, height + 1, 3000), rng.integers(1, width + 1, 3000), rng.integers(-99, 99, 3000), strict=True)}
    rows = [(*k, v) for k, v in cells.items()] + [(*k, v - 5) for k, v in list(cells.items())[:50]] + [(3, 1, 1, None), (3, 1, 2, float("nan"))]
    cells[3, 1, 1], cells[3, 1, 2] = cells.get((3, 1, 1)), cells.get((3, 1, 2))
    df = spark.createDataFrame(rows, "plane int, y int, x int, value double").repartition(5)
    path = str(tmp_path / "cube")
    fits_source.write_images(df, path, width, height, planes, kind, max_bytes=2 * width * height * int(kind[1]))
    cards = spark.read.format("fits_header").load(path)
    assert sorted((r.key, r.value) for r in cards.where("key in ('NAXIS3', 'CRVAL3')").collect()) == [("CRVAL3", "1"), ("CRVAL3", "3"), ("CRVAL3", "5"), ("CRVAL3", "9"), ("NAXIS3", "1")] + [("NAXIS3", "2")] * 3
    read = headers.with_keywords(spark.read.format("fits_image").load(path), cards, {"first": ("CRVAL3", "long")}, file="path").where("problem is null")
    got = {(r.plane + r.first - 1, r.y, r.x): r.value for r in read.collect()}
    assert got == {(p, y, x): cells.get((p, y, x)) for p in (1, 2, 3, 4, 5, 6, 9) for y in range(1, height + 1) for x in range(1, width + 1)}
    assert all(len(data) % fits.BLOCK == 0 for data in (f.read_bytes() for f in (tmp_path / "cube").glob("*.fits")))


def test_images_in_small_stretches(tmp_path, monkeypatch):
    """A writer that holds little at a time writes the same bytes."""
    import pyarrow as pa

    places = sorted(np.random.default_rng(1).choice(2000, 300, replace=False).tolist())
    cells = pa.table({"file": [0] * 300, "plane": [1 + i // 1000 for i in places], "y": [1 + i % 1000 // 50 for i in places], "x": [1 + i % 50 for i in places], "value": [float(i) for i in places]})
    out = []
    for stretch, rows in ((8 << 20, 300), (64, 7)):
        monkeypatch.setattr(fits_source, "READ_BYTES", stretch)
        writer = fits_source.ImageWriter({"path": str(tmp_path / str(stretch)), "shape": "50,20,2", "planes_per_file": "2", "pixels": "f4"}, False)
        writer.commit([writer.write(iter(cells.to_batches(max_chunksize=rows)))])
        (file,) = (tmp_path / str(stretch)).glob("*.fits")
        out.append(file.read_bytes())
    assert out[0] == out[1] and len(out[0]) == 2880 + 8640
    (unit,) = fits.units(out[0])
    pixels = np.frombuffer(unit.data, ">f4")
    assert [i for i in range(2000) if not np.isnan(pixels[i])] == places


def test_images_that_cannot_be_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, 2.0), (1, 3, 1, 4.0)], "plane int, y int, x int, value double")
    for args in ((1, 2, 1, "f4"), (5, 5, 1, "u1"), (0, 5, 1, "f4")):
        with pytest.raises(Exception):
            fits_source.write_images(df, str(tmp_path / "no"), *args)
    with pytest.raises(Exception, match="beyond"):
        fits_source.write_images(df.withColumn("value", F.col("value") * 1e6), str(tmp_path / "no"), 5, 5, 1, "i2")
    assert not list((tmp_path / "no").rglob("*.fits"))
    fits_source.write_images(df.limit(0), str(tmp_path / "empty"), 5, 5)
    assert spark.read.format("fits_image").load(str(tmp_path / "empty")).count() == 0
    fits_source.write_images(df, str(tmp_path / "yes"), 5, 5)
    fits_source.write_images(df.where("y = 1"), str(tmp_path / "yes"), 5, 5, overwrite=True)
    assert spark.read.format("fits_image").load(str(tmp_path / "yes")).where("value is not null").count() == 1
