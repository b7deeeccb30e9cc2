"""Written intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so a lost
executor loses nothing that a later stage needs.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set and the master is local (tests, a laptop) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fringe-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/fringe-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Rows that go to a Python worker at a time where they hold whole texts, and about how many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What runs within leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within gives texts to Python some megabytes at a time: the executor holds a batch outside its heap, and so does each worker."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        yield


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffles that made it are dropped."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more: not a later job, nor a result that is still to be computed."""
    for df in tables:
        if path := _path_of.pop(df, None):
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def cleanup() -> None:
    """Delete what this process has written, where its session is still there."""
    while _written:
        _delete(*_written.pop())


atexit.register(cleanup)
