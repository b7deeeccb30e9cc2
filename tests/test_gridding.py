import numpy as np
import pytest
from pyspark.sql import functions as F

from fringe.operators import gridding
from fringe.streaming import blocks

GRID = gridding.Grid(size=64, cell=0.5 / 64, oversample=4, w_scale=0.25, planes=3)


def half_away(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def setup(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    s = np.column_stack([rng.uniform(-70, 70, (n, 2)), rng.uniform(-40, 40, n), rng.normal(size=(n, 2)), rng.uniform(0.5, 2, n)])
    s[:4, 2] = 0
    s[4, :2] = (0.0, 1.0)
    s[5, :2] = (5.0, -3.0)
    reach = 4 * 4 + 3
    kernel = [(w, y, x, float(np.exp(-(x * x + y * y) / 40)), 0.1 * w) for w in range(3) for y in range(reach) for x in range(reach)]
    support = [(w, w + 1) for w in range(3)]
    samples = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(s)], "block int, uu double, vv double, ww double, re double, im double, weight double")
    return s, samples, spark.createDataFrame(kernel, "w int, y int, x int, re double, im double"), spark.createDataFrame(support, "w int, support int")


def brute(s, g=GRID):
    out, hits, norm, skipped = np.zeros((g.size, g.size), complex), np.zeros((g.size, g.size), int), 0.0, 0
    for uu, vv, ww, re, im, weight in s:
        pu, pv = -uu * g.scale, vv * g.scale
        gu, gv = int(half_away(pu)) + g.size // 2, int(half_away(pv)) + g.size // 2
        ou, ov = int(half_away((half_away(pu) - pu) * g.oversample)), int(half_away((half_away(pv) - pv) * g.oversample))
        w = min(int(half_away(np.sqrt(abs(ww * g.w_scale)))), g.planes - 1)
        sup = w + 1
        if gu + sup >= g.size or gu - sup < 0 or gv + sup >= g.size or gv - sup < 0:
            skipped += 1
            continue
        for j in range(-sup, sup + 1):
            for k in range(-sup, sup + 1):
                y, x = abs(ov + j * g.oversample), abs(ou + k * g.oversample)
                c = np.exp(-(x * x + y * y) / 40) + 0.1j * w * (-1 if ww > 0 else 1)
                out[gv + j, gu + k] += weight * (re + 1j * im) * c
                hits[gv + j, gu + k] += 1
                norm += weight * c.real
    return out, hits, norm, skipped


def dense(df, g=GRID):
    rows = df.toPandas()
    out, hits = np.zeros((g.size, g.size), complex), np.zeros((g.size, g.size), int)
    out[rows.v, rows.u] = rows.re + 1j * rows.im
    hits[rows.v, rows.u] = rows.hits
    return out, hits


@pytest.mark.parametrize("engine", ["join", "partial"])
def test_grid_equals_loops(spark, engine, monkeypatch):
    s, samples, kernel, support = setup(spark)
    want, want_hits, norm, skipped = brute(s)
    got, hits = dense(gridding.grid_samples(samples, kernel, support, GRID, engine))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and (hits == want_hits).all()
    assert np.isclose(gridding.norm(samples, kernel, support, GRID).first().norm, norm, rtol=1e-9)
    located = gridding.with_support(gridding.locate(samples, GRID), support, GRID)
    assert gridding.skipped(located, GRID).first().num_skipped == skipped
    assert sum(r.num_skipped for r in gridding.skipped(located, GRID, ("block",)).collect()) == skipped
    assert {(r.v, r.u): r.hits for r in gridding.hit_intensity(located, GRID).collect()} == {(v, u): want_hits[v, u] for v, u in zip(*np.nonzero(want_hits), strict=True)}
    monkeypatch.setattr(gridding, "WINDOW_CELLS", 1)
    sparse, _ = dense(gridding.grid_samples(samples, kernel, support, GRID, "partial"))
    assert np.allclose(sparse, want, rtol=1e-9, atol=1e-12)


def test_linear_conjugate_and_split(spark):
    s, samples, kernel, support = setup(spark, 120, 2)
    grid = lambda df: dense(gridding.grid_samples(df, kernel, support, GRID))[0]
    whole = grid(samples)
    assert np.allclose(grid(samples.where("block = 0")) + grid(samples.where("block > 0")), whole)
    assert np.allclose(grid(samples.withColumns({"re": F.col("re") * 3, "im": F.col("im") * 3})), 3 * whole)
    assert np.allclose(grid(samples.withColumns({"ww": -F.col("ww"), "im": -F.col("im")}).where("ww <> 0")), np.conj(grid(samples.where("ww <> 0"))))
    assert gridding.compare_grids(gridding.grid_samples(samples, kernel, support, GRID), gridding.grid_samples(samples, kernel, support, GRID, "join")).isEmpty()
    assert not gridding.compare_grids(gridding.grid_samples(samples, kernel, support, GRID), gridding.grid_samples(samples.limit(50), kernel, support, GRID)).isEmpty()


def test_uniform_weights(spark):
    s, samples, _, _ = setup(spark)
    cells = np.column_stack([half_away(-s[:, 0] * GRID.scale) + 32, half_away(s[:, 1] * GRID.scale) + 32]).astype(int)
    on = ((cells >= 0) & (cells < 64)).all(1)
    density = {}
    for c, w in zip(map(tuple, cells[on]), s[on, 5], strict=True):
        density[c] = density.get(c, 0) + w
    got = sorted(((r.uu, r.weight_out) for r in gridding.weights_uniform(samples, GRID).collect()), key=lambda r: r[0])
    want = sorted(((u, w / density[c] if o else None) for u, w, c, o in zip(s[:, 0], s[:, 5], map(tuple, cells), on, strict=True)), key=lambda r: r[0])
    assert all(a == b or np.isclose(a, b) for (_, a), (_, b) in zip(got, want, strict=True))


def test_tiles_box_and_image(spark):
    s, samples, kernel, support = setup(spark)
    located = gridding.with_support(gridding.locate(samples, GRID), support, GRID)
    box = gridding.bounding_box(located, GRID).first()
    u0, v0, n_u, n_v = gridding.tile_box((box.u_min, box.v_min, box.u_max, box.v_max), 8, 4, GRID)
    assert u0 <= box.u_min and v0 <= box.v_min and u0 + 8 * n_u > box.u_max and v0 + 4 * n_v > box.v_max
    tiled = gridding.tiles(located, GRID, 8, 4, u0, v0)
    want = {}
    for r in located.where(gridding.inside(GRID)).collect():
        for pu in range((r.gu - r.support - u0) // 8, (r.gu + r.support - u0) // 8 + 1):
            for pv in range((r.gv - r.support - v0) // 4, (r.gv + r.support - v0) // 4 + 1):
                want[pu, pv] = want.get((pu, pv), 0) + 1
    assert {(r.pu, r.pv): r.n for r in gridding.tile_counts(tiled).collect()} == want
    assert gridding.bucket_by_tile(tiled).count() == sum(want.values())
    cells = gridding.grid_samples(samples, kernel, support, GRID)
    got, table = gridding.dirty_image(cells, GRID).toPandas(), cells.toPandas()
    image, dense = np.zeros((64, 64)), np.zeros((64, 64), complex)
    image[got["y"], got["x"]], dense[table["v"], table["u"]] = got["value"], table["re"] + 1j * table["im"]
    assert len(got) == 64 * 64 and np.allclose(image, np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(dense))).real)


def test_nulls_and_empty(spark):
    _, samples, kernel, support = setup(spark, 20)
    holes = samples.withColumn("re", F.when(F.col("block") > 0, F.col("re")))
    assert np.allclose(dense(gridding.grid_samples(holes, kernel, support, GRID))[0], dense(gridding.grid_samples(samples.where("block > 0"), kernel, support, GRID))[0])
    assert gridding.grid_samples(samples.limit(0), kernel, support, GRID).isEmpty()


def test_streaming_blocks_equal_batch(spark, tmp_path):
    s, samples, kernel, support = setup(spark)
    for b in range(3):
        samples.where(f"block = {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = blocks.read_blocks(spark, str(tmp_path / "in"), files_per_batch=1)
    grid, skipped = blocks.streaming_grid(stream, kernel, support, GRID), blocks.streaming_skipped(stream, support, GRID)
    assert blocks.latest(spark, str(tmp_path / "grid"), grid.schema, ["v", "u"]).isEmpty()
    blocks.run_to_files(grid, str(tmp_path / "grid"), ["v", "u"]).awaitTermination()
    assert np.allclose(dense(blocks.latest(spark, str(tmp_path / "grid"), grid.schema, ["v", "u"]))[0], brute(s)[0])
    blocks.run_to_files(skipped, str(tmp_path / "skipped"), ["block"]).awaitTermination()
    assert sum(r.num_skipped for r in blocks.latest(spark, str(tmp_path / "skipped"), skipped.schema, ["block"]).collect()) == brute(s)[3]
    # A later start goes on where the progress ended.
    samples.where("block = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    blocks.run_to_files(grid, str(tmp_path / "grid"), ["v", "u"]).awaitTermination()
    more = blocks.latest(spark, str(tmp_path / "grid"), grid.schema, ["v", "u"]).agg(F.sum("hits")).first()[0]
    first = blocks.streaming_grid(samples.where("block = 0"), kernel, support, GRID).agg(F.sum("hits")).first()[0]
    assert more == gridding.grid_samples(samples, kernel, support, GRID).agg(F.sum("hits")).first()[0] + first


def test_late_rows_are_dropped_once_their_window_is_final(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1), ("2024-01-01 05:00:00", 1)], [("2024-01-01 00:20:00", 1), ("2024-01-01 04:30:00", 1)], [("2024-01-01 05:10:00", 2)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, bin int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = blocks.windowed_histogram(stream.select("ts", F.col("bin").alias("b")), "ts", "1 hour", "1 hour", F.col("b"))
    flat = counts.select(F.col("window.start").alias("start"), "bin", "n")
    for part in rows:  # each file arrives after the one before it has been processed
        spark.createDataFrame(part, "ts string, bin int").select(F.col("ts").cast("timestamp"), "bin").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        blocks.run_to_files(flat, str(tmp_path / "out"), ["start", "bin"]).awaitTermination()
    got = {(r.start.hour, r.bin): r.n for r in blocks.latest(spark, str(tmp_path / "out"), flat.schema, ["start", "bin"]).collect()}
    assert got == {(0, 1): 1, (5, 1): 1, (4, 1): 1, (5, 2): 1}


def test_alike_samples_are_gridded_once_and_count_each_time(spark):
    _, samples, kernel, support = setup(spark, 60)
    many = samples.crossJoin(spark.range(7)).drop("id")
    located = gridding.with_support(gridding.locate(many, GRID), support, GRID)
    fitting = located.where(gridding.inside(GRID)).count()
    alike = gridding.alike(located, GRID)
    assert alike.count() * 7 == fitting and alike.agg(F.sum("times")).first()[0] == fitting
    whole = lambda df: sorted(map(tuple, df.collect()))
    one = whole(gridding.grid_samples(samples, kernel, support, GRID, unit=1e-6))
    for engine in ("join", "partial"):
        got = whole(gridding.grid_samples(many, kernel, support, GRID, engine, 1e-6))
        assert got == [(v, u, 7 * re, 7 * im, 7 * hits) for v, u, re, im, hits in one]


@pytest.mark.parametrize("cells", [0, 100_000])
def test_large_kernels_join_by_cell(spark, monkeypatch, cells):
    _, samples, kernel, support = setup(spark, 60)
    want = sorted(map(tuple, gridding.grid_samples(samples, kernel, support, GRID, "join", 1e-6).collect()))
    monkeypatch.setattr(gridding, "BROADCAST_CELLS", cells)
    assert sorted(map(tuple, gridding.grid_samples(samples, kernel, support, GRID, "join", 1e-6).collect())) == want


def test_baselines_of_many_blocks_are_all_pairs_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(gridding, "BLOCK_STATIONS", 7)
    ids = [*range(60), 5, 5, None]
    found = gridding.baselines(spark.createDataFrame([(i,) for i in ids], "station long").coalesce(1))
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a in ids[:-1] for b in ids[:-1] if a < b)
    full = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert full > 4  # one file of stations is no longer one task
    assert gridding.baselines(spark.createDataFrame([(None,)], "station long")).count() == 0
