"""Session settings shared by the bench, the tests and interactive use."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "fringe", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with AQE on; on a cluster leave ``master`` unset and size ``shuffle_partitions`` to the data."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions, for work that costs far more than moving its rows.

    Tables of many files have partitions enough and are left as they are, and so is what isn't read from files.
    Nothing is executed: the optimizer's size of the plan and the names of its files decide.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size >= cores * split or len(df.inputFiles()) >= cores else df.repartition(2 * cores)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Each name, or with underscores behind it until no column has it (in any case): for columns that come and go within an operator."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir``; only where none is set and the master is local a folder is made.

    Spark deletes it once nothing refers to it any more, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``get_session`` does.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fringe-"))
    return df.checkpoint()
