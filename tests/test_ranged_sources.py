import gzip
import struct

import numpy as np
import pyarrow as pa
import pytest

from fringe.sources import container, container_source, fits, fits_source
from fringe.sources.store import Ranges


@pytest.fixture(scope="module")
def spark(spark):
    fits_source.register(spark)
    container_source.register(spark)
    return spark


@pytest.fixture(scope="module")
def cube(tmp_path_factory):
    """A folder with a cube of 40 planes of 100 lines of 60 pixels behind an empty unit, and the cube."""
    values = np.arange(40 * 100 * 60, dtype=">i4").reshape(40, 100, 60)
    folder = tmp_path_factory.mktemp("cube")
    (folder / "a.fits").write_bytes(fits.encode({"BITPIX": 8, "NAXIS": 0}) + fits.encode_image(values, {"EXTNAME": "SKY", "EXTVER": 2, "BLANK": 7, "BSCALE": 0.5, "BZERO": 1.0}, primary=False))
    return folder, values


def pixels(df):
    return sorted((r.plane, r.y, r.x, r.value) for r in df.collect())


def expected(values, planes, ys, xs):
    return sorted((int(p) + 1, int(y) + 1, int(x) + 1, None if values[p, y, x] == 7 else float(values[p, y, x]) * 0.5 + 1) for p in planes for y in ys for x in xs)


def test_image_by_ranges(spark, cube):
    folder, values = cube
    df = spark.read.format("fits_image").option("split_bytes", 100_000).load(str(folder))
    assert df.rdd.getNumPartitions() > 5
    assert pixels(df) == expected(values, range(40), range(100), range(60))
    part = spark.read.format("fits_image").options(hdu="sky,2", section="3:21:6,10:90:40,2:40:19", split_bytes=50_000).load(str(folder))
    assert pixels(part) == expected(values, range(1, 40, 19), range(9, 90, 40), range(2, 21, 6))
    pushed = spark.read.format("fits_image").option("hdu", 1).load(str(folder)).where("plane = 3 and y > 97 and x <= 2")
    assert pixels(pushed) == expected(values, [2], [97, 98, 99], [0, 1])


def test_a_section_reads_its_own_lines_only(cube):
    folder, values = cube
    path = str(folder / "a.fits")
    whole = fits_source.Piece(path, 0, 1 << 62)
    for section, most in (("*,50:51,20", 2 * 240), ("1:2,*,1", 100 * 240), ("*,1:100:50,*", 80 * 240)):
        reader = fits_source.ImageReader({"path": path, "section": section})
        with Ranges(path, path) as file:
            rows = sum(b.num_rows for b in reader.batches(file, whole))
            headers = 4 * fits.BLOCK
            assert rows and file.bytes_read <= most + headers
    reader = fits_source.ImageReader({"path": path})
    reader.limits.take([fits_source.EqualTo(("plane",), 20)])
    with Ranges(path, path) as file:
        assert sum(b.num_rows for b in reader.batches(file, whole)) == 6000 and file.bytes_read <= 6000 * 4 + headers


def test_files_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB; a section near its end reads a few lines."""
    width, lines = 1 << 20, 800
    head = fits.encode({"BITPIX": -32, "NAXIS": 2, "NAXIS1": width, "NAXIS2": lines})
    path = tmp_path / "large.fits"
    with path.open("wb") as f:
        f.write(head)
        f.seek(len(head) + 4 * (width * 799 + 5))
        f.write(struct.pack(">f", 2.5))
        f.truncate(len(head) + -(-4 * width * lines // fits.BLOCK) * fits.BLOCK)
    assert path.stat().st_size > 3 << 30
    df = spark.read.format("fits_image").options(section="1:10,800", split_bytes=1 << 28).load(str(path))
    assert [(r.x, r.y, r.value) for r in df.where("value > 0").collect()] == [(6, 800, 2.5)] and df.count() == 10


def test_units_by_name_gzip_and_problems(spark, tmp_path, cube):
    small = np.arange(6, dtype=">f4").reshape(2, 3)
    small[0, 1] = np.nan
    image = fits.encode_image(small)
    (tmp_path / "a.fits.gz").write_bytes(gzip.compress(image))
    (tmp_path / "b.fits").write_bytes(image[:2880] + image[2880:2890])
    (tmp_path / "c.fits").write_bytes(b"no such file at all")
    rows = spark.read.format("fits_image").load(str(tmp_path)).collect()
    assert sorted((r.y, r.x, r.value) for r in rows if r.problem is None) == [(1, 1, 0.0), (1, 2, None), (1, 3, 2.0), (2, 1, 3.0), (2, 2, 4.0), (2, 3, 5.0)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.problem) == ["b.fits", "c.fits"]
    gone = fits.read_image(spark, str(cube[0]), "NOSUCH").collect()
    assert len(gone) == 1 and "no unit" in gone[0].problem
    assert fits.read_image(spark, str(cube[0]), "image").count() == cube[1].size
    assert spark.read.format("fits_image").load(str(tmp_path / "nothing")).count() == 0


def table_frame(spark):
    return spark.createDataFrame(
        [(i, i * 0.5 if i % 7 else None, f"s{i}" if i % 3 else None, i % 2 == 0 if i % 5 else None, [float(i)] * (i % 4), None if i % 11 == 0 else i) for i in range(1000)],
        "id long, d double, s string, b boolean, v array<double>, n int",
    )


def test_table_sink_and_ranges(spark, tmp_path):
    path, df = str(tmp_path / "t"), table_frame(spark)
    df.repartition(3).write.format("fits_table").option("max_bytes", 6_000).mode("append").save(path)
    assert len(list((tmp_path / "t").glob("*.fits"))) > 6 and not list((tmp_path / "t").glob("_*"))
    back = spark.read.format("fits_table").option("split_bytes", 3_000).load(path)
    assert dict(back.dtypes) == {"_row": "bigint", "id": "bigint", "d": "double", "s": "string", "b": "boolean", "v": "array<double>", "n": "int", "_problem": "string"}
    got = {r.id: r for r in back.collect()}
    for r in df.collect():
        g = got[r.id]
        assert (g.d, g.s, g.b, g.n) == (r.d, r.s or "", r.b, r.n) and [x for x in g.v if x is not None] == r.v
    assert len(got) == 1000
    one = spark.read.format("fits_table").options(columns="n,ID", rows="2-3,5").load(path)
    assert one.columns == ["_row", "n", "id", "_problem"] and {r._row for r in one.collect()} == {2, 3, 5}
    assert {r._row for r in back.where("_row between 4 and 6").collect()} == {4, 5, 6}
    df.limit(5).write.format("fits_table").mode("overwrite").save(path)
    assert spark.read.format("fits_table").load(path).count() == 5 == fits.read_table(spark, path).count()


def test_rows_read_and_other_columns(spark, tmp_path):
    table = fits.encode_table({"a": np.arange(10_000, dtype=np.int32), "b": np.ones((10_000, 3))})
    path = tmp_path / "a.fits"
    path.write_bytes(table)
    (tmp_path / "b.fits").write_bytes(fits.encode_table({"a": np.arange(3.0)}))
    df = spark.read.format("fits_table").load(str(tmp_path))
    assert df.where("_problem is null").count() == 10_000 and [r._problem is not None for r in df.where("a is null").collect()] == [True]
    reader = fits_source.TableReader({"path": str(path), "rows": "9000-9009"}, df.schema)
    with Ranges(str(path), str(path)) as file:
        batches = list(reader.batches(file, fits_source.Piece(str(path), 0, 1 << 62), reader.arrow))
        assert pa.Table.from_batches(batches)["a"].to_pylist() == list(range(8999, 9009)) and file.bytes_read <= 4 * fits.BLOCK + 10 * 28
    ascii_head = {"XTENSION": "TABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 20, "NAXIS2": 3, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 3, "TTYPE1": "n", "TFORM1": "I5", "TBCOL1": 1, "TTYPE2": "f", "TFORM2": "E9.2", "TBCOL2": 6, "TTYPE3": "s", "TFORM3": "A6", "TBCOL3": 15, "TNULL1": "-"}
    text = b"   12  1.5D+01 ab   " b"    -          cd   " b"   -3    2.5  e f   "
    (tmp_path / "t.txt").write_bytes(fits.encode({"BITPIX": 8, "NAXIS": 0}) + fits.encode(ascii_head, text, primary=False))
    rows = spark.read.format("fits_table").load(str(tmp_path / "t.txt")).orderBy("_row").collect()
    assert [(r.n, r.f, r.s) for r in rows] == [(12, 15.0, " ab"), (None, None, " cd"), (-3, 2.5, "e f")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).selectExpr("cast(case when id = 99 then -9223372036854775808 else id end as long) as a")
    with pytest.raises(Exception, match="stands for null"):
        bad.repartition(4).write.format("fits_table").mode("append").save(str(tmp_path / "x"))
    assert not list(tmp_path.rglob("*.fits"))


def test_chunks(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(60).selectExpr("cast(1 as int) as group_id", "cast(id % 3 as int) as tag_id", "cast(id as int) as user_index", f"{container.CHAR} as data_type", "cast(repeat(cast(id as string), 100) as binary) as payload")
    df.repartition(2).write.format("container").options(max_bytes=2_000, name="TEST").mode("append").save(path)
    files = sorted((tmp_path / "c").glob("*.bin"))
    assert len(files) > 4 and all(f.stat().st_size <= 2_000 for f in files) and container.header(files[0].read_bytes())["name"] == "TEST"
    back = spark.read.format("container").option("split_bytes", 300).load(path)
    assert back.where("crc_ok").count() == 60 == container.read_container(spark, path).where("crc_ok").count()
    assert {(r.user_index, bytes(r.payload)) for r in back.where("tag_id = 2").collect()} == {(i, str(i).encode() * 100) for i in range(2, 60, 3)}
    assert spark.read.format("container").option("payload", "false").load(path).where("payload is null and size > 0").count() == 60
    raw = files[0].read_bytes()
    (tmp_path / "bad.bin").write_bytes(raw[:-1])
    (tmp_path / "flip.bin").write_bytes(raw[:100] + bytes([raw[100] ^ 1]) + raw[101:])
    assert spark.read.format("container").load(str(tmp_path / "bad.bin")).where("problem is not null").count() == 1
    assert spark.read.format("container").load(str(tmp_path / "flip.bin")).where("not crc_ok").count() == 1


def vis_file(path, matrix, single, big_endian=False):
    """Blocks of 10 times, of 33 in all: the last holds 3, and its payloads are as long as the others'."""
    amp = container.COMPLEX | (container.MATRIX if matrix else 0) | (container.SINGLE if single else container.DOUBLE)
    kind = np.dtype("<c8" if single else "<c16")
    stations, times, pols = 4, 33, 4 if matrix else 1
    baselines = stations * (stations - 1) // 2
    ints = lambda *v: np.array(v, "<i4").tobytes()
    chunks = [(11, tag, 0, container.INT, ints(v)) for tag, v in ((5, amp), (6, container.DOUBLE), (7, 10), (8, times), (10, 1), (11, stations))]
    want = []
    for block in range(4):
        n = min(10, times - 10 * block)
        i = np.arange(10 * baselines) + 1000 * block
        u, v, w = (i + x for x in (0.11, 0.22, 0.33))
        a = (np.arange(10 * baselines * pols) + 0.111 + 1j * (np.arange(10 * baselines * pols) + 0.222)).astype(kind)
        chunks.append((12, 1, block, container.INT, ints(10 * block, 0, n, 1, baselines, stations)))
        chunks += [(12, 3, block, amp, a.tobytes()), *((12, t, block, container.DOUBLE, x.astype("<f8").tobytes()) for t, x in ((4, u), (5, v), (6, w)))]
        for k in range(n * baselines * pols):
            s = k // pols
            want.append((block, 10 * block + s // baselines, 0, s % baselines, k % pols, u[s], v[s], w[s], float(a[k].real), float(a[k].imag)))
    path.write_bytes(container.encode(chunks, big_endian=big_endian))
    return sorted(want)


@pytest.mark.parametrize(("matrix", "single", "big_endian"), [(False, False, False), (True, False, False), (True, True, True)])
def test_visibility_blocks(spark, tmp_path, monkeypatch, matrix, single, big_endian):
    want = vis_file(tmp_path / "a.vis", matrix, single, big_endian)
    df = spark.read.format("visibility_blocks").option("split_bytes", 1_000).load(str(tmp_path / "a.vis"))
    got = sorted(tuple(r)[1:-1] for r in df.collect())
    assert got == want and df.where("problem is not null").count() == 0
    monkeypatch.setattr(container_source, "PIECE_BYTES", 200)
    reader = container_source.SampleReader({"path": str(tmp_path / "a.vis")})
    rows = [r for piece in fits_source.pieces(str(tmp_path / "a.vis"), 777) for b in reader.read(piece) for r in b.to_pylist()]
    assert sorted(tuple(r.values())[1:-1] for r in rows) == want


def test_visibility_problems(spark, tmp_path):
    data = container.encode([(11, 5, 0, container.INT, struct.pack("<i", container.DOUBLE | container.COMPLEX)), (11, 6, 0, container.INT, struct.pack("<i", container.DOUBLE)), (12, 1, 0, container.INT, np.array([0, 0, 5, 1, 3, 3], "<i4").tobytes()), (12, 3, 0, container.DOUBLE | container.COMPLEX, bytes(16))])
    (tmp_path / "short.vis").write_bytes(data)
    (tmp_path / "none.vis").write_bytes(b"junk")
    rows = spark.read.format("visibility_blocks").load(str(tmp_path)).collect()
    assert len(rows) == 2 and all(r.problem for r in rows)


def test_planes_are_rewritten_in_place(spark, tmp_path):
    values = np.arange(5 * 4 * 3, dtype=">i2").reshape(5, 4, 3)
    for name in ("a", "b"):
        (tmp_path / f"{name}.fits").write_bytes(fits.encode_image(values, {"BLANK": -9, "BSCALE": 2.0}) + fits.encode_image(np.ones((2, 2), ">f4"), primary=False))
    before = (tmp_path / "b.fits").read_bytes()
    a, b = (str(tmp_path / f"{name}.fits") for name in "ab")
    rows = [(a, 2, [2.0 * i for i in range(12)]), (a, 5, [None] * 12), (b, 1, [1.0] * 12), (b, 6, [1.0] * 12), (str(tmp_path / "none.fits"), 1, [1.0])]
    out = {r.path: r.problem for r in fits_source.rewrite_planes(spark, spark.createDataFrame(rows, "path string, plane int, values array<double>")).collect()}
    assert out[a] is None and "no planes [6]" in out[b] and out[str(tmp_path / "none.fits")] and (tmp_path / "b.fits").read_bytes() == before
    want = values.astype(float) * 2
    want[1], want[4] = np.arange(12).reshape(4, 3) * 2, np.nan
    got = {(r.plane, r.y, r.x): r.value for r in fits.read_image(spark, a).collect()}
    assert all(got[p + 1, y + 1, x + 1] == (None if np.isnan(want[p, y, x]) else want[p, y, x]) for p in range(5) for y in range(4) for x in range(3))
    assert fits.read_image(spark, a, 1).count() == 4 and sorted(x.name for x in tmp_path.iterdir()) == ["a.fits", "b.fits"]
