"""W-projection gridding of visibility samples onto a sparse table of cells.

A sample (uu, vv, ww, re, im, weight) falls on a grid cell, picks a convolution kernel by |w|, and adds
its weighted value times the kernel to every cell of the kernel's footprint. The grid is a table
(v, u, re, im) with a row for each cell that was touched.

Two engines give the same sums, of samples that are first counted where they are alike. ``join`` joins them with
the kernel's footprints and explodes these, all inside Spark's JVM. ``partial`` adds footprints into a small dense window for each batch of
samples in numpy and leaves Spark to sum the windows' cells: far fewer rows are shuffled, which decides
for supports of tens of cells, where a sample has thousands of contributions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringe.functions.nulls import SPEED_OF_LIGHT
from fringe.session import checkpointed, spread

#: Kernel cells up to which the kernel goes to every task; a larger one is joined by shuffle.
BROADCAST_CELLS = 4_000_000
#: Cells of a batch's dense window in the ``partial`` engine; wider batches are summed cell by cell.
WINDOW_CELLS = 4_000_000
#: Stations of a block, and pairs of blocks for each task, in making all pairs. Spark holds the rows that a pair of blocks makes (26 MB or so) at once.
BLOCK_STATIONS, BLOCK_PAIRS = 512, 256
#: Contributions that are computed at a time.
CHUNK = 200_000


@dataclass(frozen=True)
class Grid:
    """Geometry: cells per side, cell size in radians, kernel oversampling, scale of w and number of w planes."""

    size: int
    cell: float
    oversample: int
    w_scale: float
    planes: int

    @property
    def scale(self) -> float:
        return self.size * self.cell


def to_wavelengths(samples: DataFrame, frequency: float, *columns: str) -> DataFrame:
    """Lengths in metres as multiples of the wavelength at ``frequency`` (Hz)."""
    factor = frequency / SPEED_OF_LIGHT
    return samples.withColumns({c: F.col(c) * F.lit(factor) for c in columns or ("uu", "vv", "ww")})


def cell_u(grid: Grid) -> Column:
    return (F.round(-F.col("uu") * F.lit(grid.scale)) + F.lit(grid.size // 2)).cast("int")


def cell_v(grid: Grid) -> Column:
    return (F.round(F.col("vv") * F.lit(grid.scale)) + F.lit(grid.size // 2)).cast("int")


def plane(grid: Grid) -> Column:
    """Kernel plane of |w|, the last one for all beyond."""
    return F.least(F.round(F.sqrt(F.abs(F.col("ww") * F.lit(grid.w_scale)))).cast("int"), F.lit(grid.planes - 1))


def locate(samples: DataFrame, grid: Grid) -> DataFrame:
    """``samples`` with gu, gv (cell), off_u, off_v (place within it, in oversampled steps), w (plane) and sign (of the kernel's imaginary part)."""
    u, v = -F.col("uu") * F.lit(grid.scale), F.col("vv") * F.lit(grid.scale)
    offset = lambda p: F.round((F.round(p) - p) * F.lit(grid.oversample)).cast("int")
    return samples.withColumns(
        {"gu": cell_u(grid), "gv": cell_v(grid), "off_u": offset(u), "off_v": offset(v), "w": plane(grid), "sign": F.when(F.col("ww") > 0, -1).otherwise(1)}
    )


def with_support(located: DataFrame, support: DataFrame, grid: Grid) -> DataFrame:
    """``located`` with ``support``, the half width of its kernel plane; ``support`` has one row for each of the grid's planes, which bounds the broadcast."""
    return located.join(F.broadcast(support.where(F.col("w") < grid.planes).dropDuplicates(["w"])), "w")


def inside(grid: Grid) -> Column:
    """Whether the whole footprint lies on the grid."""
    s = F.col("support")
    return (F.col("gu") + s < grid.size) & (F.col("gu") - s >= 0) & (F.col("gv") + s < grid.size) & (F.col("gv") - s >= 0)


def skipped(supported: DataFrame, grid: Grid, by: tuple[str, ...] = ()) -> DataFrame:
    """How many samples have no place on the grid: in all, or for each value of ``by``."""
    return supported.groupBy(*by).agg(F.sum(F.when(inside(grid), 0).otherwise(1)).alias("num_skipped"), F.count("*").alias("num_samples"))


def on_grid(samples: DataFrame, grid: Grid) -> DataFrame:
    """Samples whose own cell lies on the grid, with gu and gv."""
    placed = samples.withColumns({"gu": cell_u(grid), "gv": cell_v(grid)})
    return placed.where((F.col("gu") >= 0) & (F.col("gu") < grid.size) & (F.col("gv") >= 0) & (F.col("gv") < grid.size))


def weights_density(samples: DataFrame, grid: Grid) -> DataFrame:
    """Sum of weights in each cell: ``gv, gu, density``."""
    return on_grid(samples, grid).groupBy("gv", "gu").agg(F.sum("weight").alias("density"))


def weights_uniform(samples: DataFrame, grid: Grid) -> DataFrame:
    """Each sample's weight divided by its cell's density, as ``weight_out``; 0 in an empty cell, null off the grid.

    The density is an aggregate joined back, so that a crowded cell is summed before the shuffle and
    its samples can be split by AQE; a window would gather them in one task.
    """
    placed = samples.withColumns({"gu": cell_u(grid), "gv": cell_v(grid)})
    density = weights_density(samples, grid)
    met = placed.join(density, ["gv", "gu"], "left")
    return met.withColumn("weight_out", F.when(F.col("density").isNull(), None).when(F.col("density") != 0, F.col("weight") / F.col("density")).otherwise(0.0)).drop("density")


def zip_complex(real: DataFrame, imaginary: DataFrame) -> DataFrame:
    """One kernel table ``w, y, x, re, im`` from two of ``w, y, x, value``."""
    return real.withColumnRenamed("value", "re").join(imaginary.withColumnRenamed("value", "im"), ["w", "y", "x"])


def compact_kernel(kernel: DataFrame, support: DataFrame, oversample: int) -> DataFrame:
    """The kernel cells that a plane's support can reach."""
    reach = F.col("support") * oversample + oversample // 2
    planes = support.groupBy("w").agg(F.max("support").alias("support"))
    return kernel.join(planes, "w").where((F.col("y") <= reach) & (F.col("x") <= reach)).drop("support")


def mirror_differences(kernel: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``w, y, x, error`` of kernel cells that differ from their mirror on the diagonal; a kernel that holds one quadrant is to be the same in both directions."""
    other = kernel.select("w", F.col("y").alias("x"), F.col("x").alias("y"), F.col("re").alias("o_re"), F.col("im").alias("o_im"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    error = F.greatest(F.abs(zero("re") - zero("o_re")), F.abs(zero("im") - zero("o_im")))
    return kernel.join(other, ["w", "y", "x"], "full").select("w", "y", "x", error.alias("error")).where(F.col("error") > tolerance)


def footprints(supported: DataFrame, grid: Grid) -> DataFrame:
    """A row for each sample and cell of its footprint: v, u, and ky, kx in the kernel's first quadrant."""
    span = F.sequence(-F.col("support"), F.col("support"))
    rows = supported.where(inside(grid)).withColumn("j", F.explode(span)).withColumn("k", F.explode(span))
    return rows.withColumns(
        {
            "v": F.col("gv") + F.col("j"),
            "u": F.col("gu") + F.col("k"),
            "ky": F.abs(F.col("off_v") + F.col("j") * grid.oversample),
            "kx": F.abs(F.col("off_u") + F.col("k") * grid.oversample),
        }
    )


def contributions(supported: DataFrame, kernel: DataFrame, grid: Grid) -> DataFrame:
    """Footprint rows with what each adds: ``add_re``, ``add_im``, ``add_norm``."""
    cells = kernel.select("w", F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("re").alias("c_re"), F.col("im").alias("c_im"))
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    met = footprints(supported, grid).join(cells, ["w", "ky", "kx"])
    v_re, v_im, c_im = F.col("weight") * F.col("re"), F.col("weight") * F.col("im"), F.col("c_im") * F.col("sign")
    return met.withColumns({"add_re": v_re * F.col("c_re") - v_im * c_im, "add_im": v_im * F.col("c_re") + v_re * c_im, "add_norm": F.col("weight") * F.col("c_re")})


def alike(supported: DataFrame, grid: Grid) -> DataFrame:
    """Samples with a place on the grid; those that add the same to the same cells are one row, ``times`` says how many.

    Sums are made before the shuffle; the rows are then dealt anew, as each costs far more than its bytes tell.
    """
    keys = ["gu", "gv", "off_u", "off_v", "w", "sign", "support", "re", "im", "weight"]
    rows = supported.where(inside(grid)).groupBy(*keys).agg(F.count("*").alias("times"))
    return rows.repartition(2 * supported.sparkSession.sparkContext.defaultParallelism)


def kernel_footprints(kernel: DataFrame, support: DataFrame, grid: Grid) -> DataFrame | None:
    """The whole footprint of each plane and place within a cell, ``w, off_v, off_u, cells`` (j, k, c_re, c_im); None if all together exceed ``BROADCAST_CELLS``."""
    if kernel.count() > BROADCAST_CELLS // 8:
        return None
    reach = grid.oversample // 2 + 1
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    places = support.where(F.col("w") < grid.planes).dropDuplicates(["w"]).withColumn("off_v", F.explode(offsets)).withColumn("off_u", F.explode(offsets))
    span = F.sequence(-F.col("support"), F.col("support"))
    rows = places.withColumn("j", F.explode(span)).withColumn("k", F.explode(span))
    rows = rows.withColumns({"ky": F.abs(F.col("off_v") + F.col("j") * grid.oversample), "kx": F.abs(F.col("off_u") + F.col("k") * grid.oversample)})
    met = rows.join(kernel.select("w", F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("re").alias("c_re"), F.col("im").alias("c_im")), ["w", "ky", "kx"])
    out = met.groupBy("w", "off_v", "off_u").agg(F.collect_list(F.struct("j", "k", "c_re", "c_im")).alias("cells"))
    out = checkpointed(out)
    return out if (out.agg(F.sum(F.size("cells"))).first()[0] or 0) <= BROADCAST_CELLS else None


def _joined_grid(supported: DataFrame, kernel: DataFrame, support: DataFrame, grid: Grid, unit: float | None) -> DataFrame:
    """The ``join`` engine: a join for each sample with its footprint, or, of a large kernel, for each cell with its kernel cell."""
    samples = alike(supported, grid)
    whole = kernel_footprints(kernel, support, grid)
    if whole is None:
        rows = contributions(samples, kernel, grid)
    else:
        met = samples.join(F.broadcast(whole), ["w", "off_v", "off_u"])
        v_re, v_im = F.col("weight") * F.col("re"), F.col("weight") * F.col("im")
        met = met.select("gu", "gv", "sign", "times", v_re.alias("v_re"), v_im.alias("v_im"), F.inline("cells"))
        c_im = F.col("c_im") * F.col("sign")
        rows = met.select(
            (F.col("gv") + F.col("j")).alias("v"), (F.col("gu") + F.col("k")).alias("u"), "times",
            (F.col("v_re") * F.col("c_re") - F.col("v_im") * c_im).alias("add_re"), (F.col("v_im") * F.col("c_re") + F.col("v_re") * c_im).alias("add_im"),
        )
    total = lambda c: F.sum(in_units(F.col(c), unit) * F.col("times"))
    return rows.groupBy("v", "u").agg(total("add_re").alias("re"), total("add_im").alias("im"), F.sum("times").alias("hits"))


def in_units(x: Column, unit: float | None) -> Column:
    """``x`` in whole multiples of ``unit``, so that sums don't depend on their order; unchanged without one."""
    return x if unit is None else F.round(x * F.lit(1 / unit)).cast("long")


def grid_samples(samples: DataFrame, kernel: DataFrame, support: DataFrame, grid: Grid, engine: str = "partial", unit: float | None = None) -> DataFrame:
    """The grid ``v, u, re, im, hits`` of ``samples`` (uu, vv, ww, re, im, weight).

    With ``unit`` contributions are rounded to multiples of it and summed as integers, which gives the
    same result on every run. Samples with a null in any of the six columns, and those whose footprint
    leaves the grid, contribute nothing.
    """
    names = ["uu", "vv", "ww", "re", "im", "weight"]
    supported = with_support(locate(spread(samples.select(*names).dropna()), grid), support, grid)
    if engine == "join":
        return _joined_grid(supported, kernel, support, grid, unit)
    if engine != "partial":
        raise ValueError(f"unknown engine {engine}")
    cells = kernel.select("w", "y", "x", "re", "im").limit(BROADCAST_CELLS + 1).toPandas()
    if len(cells) > BROADCAST_CELLS:
        return grid_samples(samples, kernel, support, grid, "join", unit)
    parts = partial_grids(alike(supported, grid), cells, grid, unit)
    return parts.groupBy("v", "u").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("hits").alias("hits"))


def partial_grids(supported: DataFrame, cells: pd.DataFrame, grid: Grid, unit: float | None = None) -> DataFrame:
    """Cells ``v, u, re, im, hits`` of the partial grids of tasks (or batches), which are still to be summed; also of a stream."""
    kind = "double" if unit is None else "bigint"
    planes = np.zeros((2, *(cells[["w", "y", "x"]].max().fillna(-1).astype(int) + 1)))
    planes[:, cells["w"], cells["y"], cells["x"]] = cells[["re", "im"]].to_numpy().T
    sent = supported.sparkSession.sparkContext.broadcast(planes)  # its size was checked; once to each executor
    times = F.col("times") if "times" in supported.columns else F.lit(1).cast("long").alias("times")
    needed = supported.where(inside(grid)).select("gu", "gv", "off_u", "off_v", "w", "sign", "re", "im", "weight", "support", times)
    return needed.mapInArrow(_partial_grid(sent, grid, unit), f"v int, u int, re {kind}, im {kind}, hits bigint")


def _partial_grid(sent: Broadcast[np.ndarray], grid: Grid, unit: float | None):
    """A function from batches of located samples to partial grids, with the kernel's planes (real and imaginary, w, y, x)."""
    step = grid.oversample

    kind = float if unit is None else np.int64
    # A grid that fits is summed for the whole task and given out once, a larger one batch by batch.
    whole = grid.size**2 <= WINDOW_CELLS

    def cells_of(keys: np.ndarray, columns: int, low_v: int, low_u: int, re: np.ndarray, im: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        v, u = keys // columns + low_v, keys % columns + low_u
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(u.astype(np.int32)), pa.array(re), pa.array(im), pa.array(hits.astype(np.int64))], ["v", "u", "re", "im", "hits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = sent.value
        if whole:
            all_sums, all_hits = np.zeros((2, grid.size, grid.size), kind), np.zeros((grid.size, grid.size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            low_v, low_u = int((c["gv"] - c["support"]).min()), int((c["gu"] - c["support"]).min())
            rows, columns = int((c["gv"] + c["support"]).max()) - low_v + 1, int((c["gu"] + c["support"]).max()) - low_u + 1
            dense = rows * columns <= WINDOW_CELLS
            sums = np.zeros((2, rows * columns), kind) if dense else None
            pieces: list[tuple[np.ndarray, ...]] = []
            v_re, v_im = c["weight"] * c["re"], c["weight"] * c["im"]
            for w in np.unique(c["w"]):
                of = np.flatnonzero(c["w"] == w)
                s = int(c["support"][of[0]])
                reach = np.arange(-s, s + 1)
                # The kernel as each place within a cell sees it: samples of one place share a footprint.
                code = (c["off_v"][of].astype(np.int64) * 4 * step + c["off_u"][of]) * 4 + c["sign"][of]
                _, first, which = np.unique(code, return_index=True, return_inverse=True)
                y, x = (np.abs(c[k][of][first][:, None] + reach * step) for k in ("off_v", "off_u"))
                seen = (y[:, :, None] * planes.shape[-1] + x[:, None, :]).reshape(len(y), -1)
                k_re, k_im = planes[0, w].ravel().take(seen), planes[1, w].ravel().take(seen) * c["sign"][of][first][:, None]
                footprint = (reach[:, None] * columns + reach[None, :]).ravel()
                centre = (c["gv"][of].astype(np.int64) - low_v) * columns + c["gu"][of] - low_u
                for part in np.array_split(np.arange(len(of)), max(1, len(of) * len(footprint) // CHUNK)):
                    at, p = of[part], which[part]
                    f_re, f_im = k_re.take(p, axis=0), k_im.take(p, axis=0)
                    a_re, a_im = v_re[at, None], v_im[at, None]
                    re, im = a_re * f_re, a_im * f_re
                    re -= a_im * f_im
                    im += a_re * f_im
                    cell = (centre[part, None] + footprint).ravel()
                    if unit is not None:
                        for z in (re, im):
                            z *= 1 / unit
                            z += np.copysign(0.5, z)
                            np.trunc(z, out=z)
                    for z in (re, im):
                        z *= c["times"][at, None]
                    if dense:
                        # Rounded contributions are whole numbers: their sums in a batch are exact in double.
                        for total, z in zip(sums, (re, im), strict=True):
                            total += np.bincount(cell, z.ravel(), rows * columns).astype(kind, copy=False)
                    else:
                        keys, inverse = np.unique(cell, return_inverse=True)
                        pieces.append((keys, *(np.bincount(inverse, z.ravel()).astype(kind) for z in (re, im)), np.bincount(inverse, np.repeat(c["times"][at], len(footprint)))))
            if dense:
                # Each footprint is a square: its corners, summed along both axes, count the hits.
                corner = np.zeros((rows + 1, columns + 1), np.int64)
                for v_end, u_end in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    v = c["gv"] - low_v + (c["support"] + 1 if v_end else -c["support"])
                    u = c["gu"] - low_u + (c["support"] + 1 if u_end else -c["support"])
                    np.add.at(corner, (v, u), c["times"] if v_end == u_end else -c["times"])
                hits = corner.cumsum(0).cumsum(1)[:rows, :columns]
                if whole:
                    window = np.s_[low_v : low_v + rows, low_u : low_u + columns]
                    all_hits[window] += hits
                    for total, z in zip(all_sums, sums, strict=True):
                        total[window] += z.reshape(rows, columns)
                    continue
                at = np.flatnonzero(hits)
                pieces = [(at, sums[0, at], sums[1, at], hits.ravel()[at])]
            for keys, re, im, count in pieces:
                yield cells_of(keys, columns, low_v, low_u, re, im, count)
        if whole:
            at = np.flatnonzero(all_hits)
            yield cells_of(at, grid.size, 0, 0, all_sums[0].ravel()[at], all_sums[1].ravel()[at], all_hits.ravel()[at])

    return add


def norm(samples: DataFrame, kernel: DataFrame, support: DataFrame, grid: Grid, unit: float | None = None) -> DataFrame:
    """Sum of weight times the kernel's real part over all footprints, as ``norm``.

    A sample's share depends on plane, offsets and weight only, so samples are first counted by those
    and the footprint is expanded once for each.
    """
    supported = with_support(locate(samples.select("uu", "vv", "ww", "re", "im", "weight").dropna(), grid), support, grid)
    kinds = supported.where(inside(grid)).groupBy("w", "support", "off_u", "off_v", "weight").agg(F.count("*").alias("times"))
    centred = kinds.withColumns({"gu": F.lit(grid.size // 2), "gv": F.lit(grid.size // 2), "re": F.lit(0.0), "im": F.lit(0.0), "sign": F.lit(1)})
    return contributions(centred, kernel, grid).agg(F.sum(in_units(F.col("add_norm"), unit) * F.col("times")).alias("norm"))


def hit_intensity(supported: DataFrame, grid: Grid, centre_only: bool = False) -> DataFrame:
    """How many footprints (or sample cells) touch each cell: ``v, u, hits``."""
    rows = supported.where(inside(grid)).select(F.col("gv").alias("v"), F.col("gu").alias("u")) if centre_only else footprints(supported, grid).select("v", "u")
    return rows.groupBy("v", "u").agg(F.count("*").alias("hits"))


def bounding_box(supported: DataFrame, grid: Grid) -> DataFrame:
    """Corners (inclusive) of what the footprints cover, and the number of samples off the grid."""
    keep, s = inside(grid), F.col("support")
    only = lambda c: F.when(keep, c)
    return supported.agg(
        F.min(only(F.col("gu") - s)).alias("u_min"),
        F.min(only(F.col("gv") - s)).alias("v_min"),
        F.max(only(F.col("gu") + s)).alias("u_max"),
        F.max(only(F.col("gv") + s)).alias("v_max"),
        F.sum(F.when(keep, 0).otherwise(1)).alias("num_skipped"),
    )


def tile_box(box: tuple[int, int, int, int], tile_u: int, tile_v: int, grid: Grid) -> tuple[int, int, int, int]:
    """Corner and number of whole tiles that cover ``box`` (u_min, v_min, u_max, v_max), with the grid's centre in a tile's centre: (u0, v0, n_u, n_v)."""
    u0, v0 = grid.size // 2 - tile_u // 2, grid.size // 2 - tile_v // 2
    u0 -= -(-max(0, u0 - box[0]) // tile_u) * tile_u
    v0 -= -(-max(0, v0 - box[1]) // tile_v) * tile_v
    return u0, v0, max(1, -(-(box[2] + 1 - u0) // tile_u)), max(1, -(-(box[3] + 1 - v0) // tile_v))


def tiles(supported: DataFrame, grid: Grid, tile_u: int = 32, tile_v: int = 16, u0: int = 0, v0: int = 0) -> DataFrame:
    """A row for each sample and tile (pu, pv) that its footprint meets."""
    s = F.col("support")
    first = lambda g, low, t: F.floor((g - s - low) / t)
    last = lambda g, low, t: F.ceil((g + s - low + 1) / t) - 1
    rows = supported.where(inside(grid))
    rows = rows.withColumn("pu", F.explode(F.sequence(first(F.col("gu"), u0, tile_u), last(F.col("gu"), u0, tile_u))))
    return rows.withColumn("pv", F.explode(F.sequence(first(F.col("gv"), v0, tile_v), last(F.col("gv"), v0, tile_v)))).withColumns({"pu": F.col("pu").cast("int"), "pv": F.col("pv").cast("int")})


def tiles_in_box(supported: DataFrame, grid: Grid, box: tuple[int, int, int, int], tile_u: int = 32, tile_v: int = 16) -> DataFrame:
    """As ``tiles``, for the tiles of a ``tile_box`` (u0, v0, n_u, n_v), whose first is (0, 0); a sample whose footprint also lies outside of the box has one more row, in the bucket (-1, -1)."""
    u0, v0, n_u, n_v = box
    met = tiles(supported, grid, tile_u, tile_v, u0, v0)
    within = F.col("pu").between(0, n_u - 1) & F.col("pv").between(0, n_v - 1)
    s = F.col("support")
    beyond = (F.col("gu") - s < u0) | (F.col("gu") + s >= u0 + n_u * tile_u) | (F.col("gv") - s < v0) | (F.col("gv") + s >= v0 + n_v * tile_v)
    rest = supported.where(inside(grid) & beyond).withColumns({"pu": F.lit(-1), "pv": F.lit(-1)})
    return met.where(within).unionByName(rest)


def tile_counts(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("pu", "pv").agg(F.count("*").alias("n"))


def exclusive_offsets(counts: DataFrame, order: list[str], value: str = "n", alias: str = "offset") -> DataFrame:
    """Sum of ``value`` over all rows before each; for tables of counts, a row for each bucket."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(alias, F.coalesce(F.sum(value).over(before), F.lit(0)))


def bucket_by_tile(tiled: DataFrame) -> DataFrame:
    """Samples partitioned and ordered by tile; a crowded tile is spread by a salt that keeps its order free."""
    return tiled.repartition("pu", "pv", F.pmod(F.xxhash64("uu", "vv", "ww"), F.lit(8))).sortWithinPartitions("pu", "pv")


def plane_histogram(located: DataFrame) -> DataFrame:
    """Samples in each plane, and the running total up to it."""
    counts = located.groupBy("w").agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)))


def compare_grids(a: DataFrame, b: DataFrame, tolerance: float = 1e-9, small: float = 0.1) -> DataFrame:
    """Cells in which two grids differ: absolutely where both are below ``small``, else relatively; a missing cell is 0."""
    value = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    met = a.alias("a").join(b.alias("b"), ["v", "u"], "full")
    size = F.sqrt(F.pow(value("a", "re") - value("b", "re"), 2) + F.pow(value("a", "im") - value("b", "im"), 2))
    top = F.greatest(*[F.abs(value(s, c)) for s in "ab" for c in ("re", "im")])
    error = F.when(top < small, size).otherwise(F.try_divide(size, top))
    return met.select("v", "u", error.alias("error")).where(F.col("error") > tolerance)


def baselines(stations: DataFrame, id_col: str = "station") -> DataFrame:
    """All pairs of stations, each once: n(n-1)/2 rows, ``a`` below ``b``; equal stations make none.

    Stations are dealt into blocks of about ``BLOCK_STATIONS`` and written, as they must not be dealt anew; each pair
    of blocks meets in one task, which holds these two blocks only.
    """
    ids = stations.select(F.col(id_col).alias("x")).where("x is not null")
    count = -(-ids.count() // BLOCK_STATIONS)
    if not count:
        return ids.select(F.col("x").alias("a"), F.col("x").alias("b"))
    dealt = ids.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    blocks = checkpointed(dealt.groupBy("block").agg(F.collect_list("x").alias("xs")))
    # A block meets itself and all later ones; tasks are many, since bytes don't tell how many pairs they make.
    tasks = max(2 * stations.sparkSession.sparkContext.defaultParallelism, count * (count + 1) // 2 // BLOCK_PAIRS)
    first = blocks.select(F.col("block").alias("i"), F.col("xs").alias("firsts"), F.explode(F.sequence("block", F.lit(count - 1))).alias("j"))
    second = blocks.select(F.col("block").alias("j"), F.col("xs").alias("seconds"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    met = first.repartition(tasks, "i", "j").join(second.repartition(tasks, "i", "j"), ["i", "j"])
    pairs = met.select("i", "j", F.explode("firsts").alias("x"), "seconds").select("i", "j", "x", F.explode("seconds").alias("y"))
    return pairs.where("x < y or (i < j and x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def dirty_image(grid_cells: DataFrame, grid: Grid) -> DataFrame:
    """``y, x, value``: the image of a grid by inverse Fourier transform, line by line along u and then along v, each line in a task of its own."""
    size = grid.size

    def transformed(line: np.ndarray) -> np.ndarray:
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(line)))

    def along_u(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(size, complex)
        line[cells["u"]] = cells["re"] + 1j * cells["im"]
        line = transformed(line)
        return pd.DataFrame({"v": np.full(size, key[0]), "x": np.arange(size), "re": line.real, "im": line.imag})

    def along_v(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(size, complex)
        line[cells["v"]] = cells["re"] + 1j * cells["im"]
        return pd.DataFrame({"y": np.arange(size), "x": np.full(size, key[0]), "value": transformed(line).real})

    lines = grid_cells.select("v", "u", "re", "im").groupBy("v").applyInPandas(along_u, "v int, x int, re double, im double")
    return lines.groupBy("x").applyInPandas(along_v, "y int, x int, value double")
