"""Images as tables of pixels (y, x, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringe.operators.quantiles import exact_quantile

#: Consistent estimate of a standard deviation from a median absolute difference.
MAD = 1.4826


@dataclass(frozen=True)
class Span:
    """Pixels ``low`` to ``high`` (both included) of an axis in steps; ``flip`` turns the axis round."""

    low: int
    high: int
    step: int = 1
    flip: bool = False

    def keep(self, at: Column) -> Column:
        return at.between(self.low, self.high) & ((at - self.low) % self.step == 0)

    def place(self, at: Column) -> Column:
        """The new place from 1."""
        n = (self.high - self.low) // self.step
        return (F.lit(n) - (at - self.low) / self.step if self.flip else (at - self.low) / self.step).cast("int") + 1


def section(pixels: DataFrame, **axes: Span) -> DataFrame:
    """The part of an image within the spans of the named axes, renumbered."""
    for name, span in axes.items():
        pixels = pixels.where(span.keep(F.col(name)))
    return pixels.withColumns({name: span.place(F.col(name)) for name, span in axes.items()})


def combine(images: Mapping[str, DataFrame], axes: Sequence[str], value: Column) -> DataFrame:
    """``value`` over images of one shape, pixel by pixel; each image's own value is a column of its name."""
    joined = None
    for name, image in images.items():
        own = image.select(*axes, F.col("value").alias(name))
        joined = own if joined is None else joined.join(own, list(axes))
    return joined.select(*axes, value.alias("value"))


def cells_to_pixels(rows: DataFrame, column: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Array cells as pixels, ``width`` to a line: y and x from 1."""
    flat = rows.select(*keys, F.posexplode(column).alias("at", "value"))
    return flat.select(*keys, (F.floor(F.col("at") / width) + 1).cast("int").alias("y"), (F.col("at") % width + 1).cast("int").alias("x"), "value")


def pixels_to_cells(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key the pixels' values as one array, line after line."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return pixels.groupBy(*keys).agg(F.transform(ordered, lambda p: p["value"]).alias("cell"))


#: Differences along a line, as factors of the pixels at these distances.
DIFFERENCES = {
    "noise1": {0: 1, 1: -1},
    "noise2": {0: 1, 2: -1},
    "noise3": {0: 2, -2: -1, 2: -1},
    "noise5": {0: 6, -2: -4, 2: -4, -4: 1, 4: 1},
}


def _noises(pixels: DataFrame, kinds: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, kind, noise`` of each kind, from one pass over the lines."""
    keys = list(keys)
    line = Window.partitionBy(*keys, "y").orderBy("x")
    value = F.col("value")
    differences = []
    for kind in kinds:
        difference = F.lit(0.0)
        for distance, factor in DIFFERENCES[kind].items():
            at = value if distance == 0 else F.lag(value, -distance).over(line) if distance < 0 else F.lead(value, distance).over(line)
            difference = difference + factor * at
        differences.append(F.struct(F.lit(kind).alias("kind"), F.abs(difference).alias("d")))
    each = pixels.where(value.isNotNull()).select(*keys, "y", F.array(*differences).alias("each"))
    good = each.select(*keys, "y", F.explode("each").alias("this")).select(*keys, "y", "this.kind", "this.d")
    lines = exact_quantile(good, [*keys, "kind", "y"], "d", alias="m")
    scale = None
    for kind in kinds:
        own = MAD / sum(f * f for f in DIFFERENCES[kind].values()) ** 0.5
        scale = F.when(F.col("kind") == kind, own) if scale is None else scale.when(F.col("kind") == kind, own)
    return exact_quantile(lines, [*keys, "kind"], "m", alias="m").select(*keys, "kind", (F.col("m") * scale).alias("noise"))


def noise(pixels: DataFrame, kind: str = "noise3", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, noise``: the standard deviation that a line's differences of some order show, as the median over all lines of an image.

    A difference takes away what changes slowly along a line; the median of its absolute values is not
    moved by single bright pixels. Nulls are left out before distances are counted. Images are told apart
    by ``keys``; without, all pixels are one image, which has no row if no line is long enough.
    """
    return _noises(pixels, [kind], keys).select(*keys, "noise")


def statistics(pixels: DataFrame, kinds: Sequence[str] = ("noise3",), keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n_good, low, high, mean, sigma`` of the values that aren't null, and the noise of each kind, null where no line is long enough."""
    keys = list(keys)
    own = [F.count("value").alias("n_good"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma")]
    out = pixels.groupBy(*keys).agg(*own) if keys else pixels.agg(*own).withColumn("one", F.lit(1))
    if not kinds:
        return out.select(*keys, "n_good", "low", "high", "mean", "sigma")
    found = _noises(pixels if keys else pixels.withColumn("one", F.lit(1)), kinds, keys or ["one"])  # one image
    wide = found.groupBy(*(keys or ["one"])).pivot("kind", list(kinds)).agg(F.first("noise"))
    return out.join(wide, keys or ["one"], "left").select(*keys, "n_good", "low", "high", "mean", "sigma", *kinds)


def quantize(value: Column, scale: float, zero: float = 0.0, dither: Column | None = None) -> Column:
    """The whole number that stands for a value; ``dither`` in [0, 1) is added before rounding and taken off again by ``restore``."""
    shift = F.lit(0.0) if dither is None else dither - 0.5
    return F.floor((value - zero) / scale + shift + 0.5).cast("int")


def restore(stored: Column, scale: float, zero: float = 0.0, dither: Column | None = None) -> Column:
    shift = F.lit(0.0) if dither is None else dither - 0.5
    return (stored - shift) * scale + zero


def project(pixels: DataFrame, axis: str) -> DataFrame:
    """Sums along all other axes."""
    return pixels.groupBy(axis).agg(F.sum("value").alias("value"))
