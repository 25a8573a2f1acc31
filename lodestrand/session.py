"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "lodestrand", cores: int | str = "*", shuffle_partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A local session with adaptive execution and Arrow on; clusters bring their own session. What is no longer used of `checkpoints` is deleted."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    if checkpoints:
        spark.sparkContext.setCheckpointDir(checkpoints)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what jobs write in between: the cluster's spark.checkpoint.dir, or the one set on the session.

    A session on one machine (master local) that has none gets a temporary one. A cluster without one is
    an error, as files on one machine's disk are lost with it and others can't read them.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrand-"))
        folder = context.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again from there, so it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of what is no longer referred to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    for _ in range(40):  # a thread tells the JVM what Python has given up
        time.sleep(0.05)
        if not waiting:
            break
    for _ in range(2):  # what the first finds may have held more
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Bytes per core below which a shuffled result counts as small.
SMALL = 64 << 20


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """`df` in at least `per_core` partitions per core, for stages whose cost is CPU and not data.

    Scans of a few small files, and small results of a shuffle that adaptive execution puts
    together, give fewer partitions than the cluster has cores. Large inputs have more already and
    pass through without a shuffle. Nothing runs to find that out: a scan's partitions are planned,
    and the size of what comes after a shuffle is the optimizer's estimate.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        few = int(str(execution.optimizedPlan().stats().sizeInBytes())) < want * SMALL
    else:
        few = df.rdd.getNumPartitions() < want
    return df.repartition(want) if few else df
