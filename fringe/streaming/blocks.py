"""Gridding and counting over blocks of samples that arrive as files, by Structured Streaming.

A block of visibilities is a set of rows in a watched folder; the grid is the state, a row for each cell,
and each micro-batch adds to it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from fringe.operators.gridding import BROADCAST_CELLS, Grid, contributions, in_units, inside, locate, partial_grids, with_support

SAMPLE_SCHEMA = "block int, uu double, vv double, ww double, re double, im double, weight double"


def read_blocks(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA, files_per_batch: int = 8) -> DataFrame:
    """Sample rows of Parquet files, as they appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def streaming_grid(samples: DataFrame, kernel: DataFrame, support: DataFrame, grid: Grid, unit: float | None = None) -> DataFrame:
    """The grid so far: ``v, u, re, im, hits``, in multiples of ``unit`` if given. Output mode update gives the cells that a batch changed, complete gives all.

    Samples of a batch are dealt to all cores, gridded by the ``partial`` engine there, and only touched cells reach the
    state. With a kernel that is too large for it footprints are joined.
    """
    names = ["uu", "vv", "ww", "re", "im", "weight"]
    dealt = samples.select(*names).dropna().repartition(2 * samples.sparkSession.sparkContext.defaultParallelism)
    located = with_support(locate(dealt, grid), support, grid)
    cells = kernel.select("w", "y", "x", "re", "im").limit(BROADCAST_CELLS + 1).toPandas()
    if len(cells) <= BROADCAST_CELLS:
        parts = partial_grids(located, cells, grid, unit)
        return parts.groupBy("v", "u").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("hits").alias("hits"))
    rows = contributions(located, kernel, grid)
    return rows.groupBy("v", "u").agg(F.sum(in_units(F.col("add_re"), unit)).alias("re"), F.sum(in_units(F.col("add_im"), unit)).alias("im"), F.count("*").alias("hits"))


def streaming_skipped(samples: DataFrame, support: DataFrame, grid: Grid) -> DataFrame:
    """Samples without a place on the grid, for each block and so in all."""
    located = with_support(locate(samples, grid), support, grid)
    return located.groupBy("block").agg(F.sum(F.when(inside(grid), 0).otherwise(1)).alias("num_skipped"), F.count("*").alias("num_samples"))


def windowed_histogram(events: DataFrame, time: str, width: str, late: str, bin_of: Column) -> DataFrame:
    """Rows in each bin and time window; a window is final once ``late`` has passed the latest time seen, and later rows are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), bin_of.alias("bin")).agg(F.count("*").alias("n"))


def run_to_files(stream: DataFrame, path: str, keys: Sequence[str], trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Write each micro-batch's changed rows below ``path``; by default what is there is processed and the query ends.

    Every batch has a folder of its own, which a batch that is run again overwrites. ``latest`` reads the result.
    """
    if missing := set(keys) - set(stream.columns):
        raise ValueError(f"no columns {sorted(missing)}")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str]) -> DataFrame:
    """The last state of each key that ``run_to_files`` has written; empty where no batch has been."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    values = [c for c in schema.names if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("state"))
    return best.select(*[F.col(c) if c in keys else F.col("state")[c].alias(c) for c in schema.names])
