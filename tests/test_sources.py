import struct

import numpy as np
import pytest

from fringe.sources import container, fits


def test_crc32c_known_value():
    assert container.crc32c(b"123456789") == 0xE3069283
    assert container.crc32c(b"6789", container.crc32c(b"12345")) == 0xE3069283
    table = container._crc_table().tolist()
    for size in (8191, 8192, 20_000, 54_321):
        data = np.random.default_rng(size).bytes(size)
        state = 0xFFFFFFFF
        for byte in data:
            state = table[(state ^ byte) & 255] ^ (state >> 8)
        assert container.crc32c(data) == state ^ 0xFFFFFFFF == container.crc32c(data[777:], container.crc32c(data[:777]))


def test_container_round_trip(spark, tmp_path):
    ints, doubles = np.arange(17, dtype="<i4") * 10, np.arange(22, dtype="<f8") + 1000
    vis = (np.arange(6) + 1j * np.arange(6)).astype("<c16")
    chunks = [
        (0, 0, 12345, container.INT, struct.pack("<i", 65)), (1, 10, 987654321, container.DOUBLE, doubles.tobytes()), (2, 20, 1, container.INT, ints.tobytes()),
        ("group", "tag", 3, container.CHAR, b"text"), (12, 3, 0, container.DOUBLE | container.COMPLEX, vis.tobytes()),
    ]
    data = container.encode(chunks)
    (tmp_path / "a.bin").write_bytes(data)
    index = container.read_container(spark, str(tmp_path / "a.bin")).cache()
    assert index.count() == 5 and all(r.crc_ok for r in index.collect())
    assert container.find(index, 255, 0, 0).isEmpty() and container.find(index, 2, 20, 1, container.DOUBLE).isEmpty()
    row = container.find(index, 2, 20, 1, container.INT).select(container.values(index.payload, container.INT).alias("v")).first()
    assert row.v == ints.tolist()
    row = container.find(index, 12, 3, 0).select(container.values(index.payload, container.DOUBLE | container.COMPLEX).alias("v")).first()
    assert row.v == [float(x) for i in range(6) for x in (i, i)]
    assert bytes(container.find(index, "group", "tag", 3).first().payload) == b"text"
    (tmp_path / "b.bin").write_bytes(data[:100] + bytes([data[100] ^ 1]) + data[101:])
    assert sorted(r.crc_ok for r in container.read_container(spark, str(tmp_path / "b.bin")).collect()).count(False) == 1


def test_fits_image_cube_and_header(spark, tmp_path):
    cube = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    (tmp_path / "i.fits").write_bytes(fits.encode_image(cube, {"BLANK": 5, "BSCALE": 0.5, "BZERO": 1.0, "OBJECT": "it's"}) + fits.encode_image(np.ones((2, 2), ">f4"), primary=False))
    rows = fits.read_image(spark, str(tmp_path / "i.fits")).collect()
    got = {(r.plane, r.y, r.x): r.value for r in rows}
    assert got[1, 1, 1] == 1.0 and got[1, 2, 2] is None and got[2, 3, 4] == 23 * 0.5 + 1 and len(got) == 24
    assert fits.read_image(spark, str(tmp_path / "i.fits"), 1).count() == 4
    cards = {(r.hdu, r.key): r.value for r in fits.read_headers(spark, str(tmp_path / "i.fits")).collect()}
    assert cards[0, "OBJECT"].startswith("'it''s") and cards[1, "NAXIS"] == "2"


def test_fits_binary_table(spark, tmp_path):
    kind = np.dtype([("t", ">f8"), ("n", ">i2"), ("u", ">i2"), ("v", ">f4", 3), ("s", "S5"), ("f", "S1"), ("b", ">u1", 2), ("p", ">i4", 2), ("c", ">c8")])
    rows = np.zeros(3, kind)
    rows["t"], rows["n"], rows["u"], rows["v"] = [1.5, np.nan, 3], [1, -99, 3], [-32768, 0, 1], np.arange(9).reshape(3, 3)
    rows["s"], rows["f"], rows["b"], rows["p"], rows["c"] = [b"ab", b"", b"hello"], [b"T", b"F", b"\0"], [[255, 0], [1, 128], [0, 0]], [[2, 0], [0, 8], [1, 8]], [1 + 2j, 0, 3]
    heap = np.array([10, 20, 30], ">i4").tobytes()
    names = [("t", "1D"), ("n", "1I"), ("u", "1I"), ("v", "3E"), ("s", "5A"), ("f", "L"), ("b", "10X"), ("p", "1PJ(2)"), ("c", "1C")]
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": kind.itemsize, "NAXIS2": 3, "PCOUNT": len(heap), "GCOUNT": 1, "TFIELDS": len(names)}
    for i, (name, form) in enumerate(names, 1):
        head |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    head |= {"TNULL2": -99, "TZERO3": 32768}
    (tmp_path / "t.fits").write_bytes(fits.encode({"BITPIX": 8, "NAXIS": 0}) + fits.encode(head, rows.tobytes() + heap, primary=False))
    df = fits.read_table(spark, str(tmp_path / "t.fits"))
    assert dict(df.dtypes) == {"_row": "bigint", "t": "double", "n": "smallint", "u": "bigint", "v": "array<float>", "s": "string", "f": "boolean", "b": "string", "p": "array<int>", "c": "struct<re:double,im:double>", "_problem": "string"}
    got = df.orderBy("_row").collect()
    assert [r.t for r in got] == [1.5, None, 3.0] and [r.n for r in got] == [1, None, 3] and [r.u for r in got] == [0, 32768, 32769]
    assert got[1].v == [3.0, 4.0, 5.0] and [r.s for r in got] == ["ab", "", "hello"] and [r.f for r in got] == [True, False, None]
    assert got[0].b == "1111111100" and [r.p for r in got] == [[10, 20], [], [30]] and got[0].c.im == 2.0


@pytest.mark.parametrize("content", [b"", b"no file at all"])
def test_other_bytes_have_no_units(content):
    assert list(fits.units(content)) == []


def test_damaged_and_big_endian_containers(spark):
    numbers = np.arange(5, dtype="<f8")
    chunks = [(1, 2, 0, container.DOUBLE, numbers.tobytes()), (1, 3, 0, container.CHAR, b"text")]
    good, swapped = container.encode(chunks), container.encode(chunks, big_endian=True)
    files = [("good", good), ("swapped", swapped), ("cut", good[:-3]), ("junk", good + b"x" * 40), ("short", b"abc"), ("empty", b""), ("null", None)]
    rows = container.chunks_of(spark.createDataFrame(files, "path string, content binary")).collect()
    of = lambda name: [(bytes(r.payload) if r.payload is not None else None, r.crc_ok, r.problem is None) for r in rows if r.path == name]
    whole = [(numbers.tobytes(), True, True), (b"text", True, True)]
    assert of("good") == of("swapped") == whole and of("cut")[1][1:] == (False, False)
    assert of("junk") == [*whole, (None, None, False)] and [x[2] for x in of("short")] == [False] and of("empty") == of("null") == []
    assert container.header(good)["version"] == container.VERSION and swapped != good
