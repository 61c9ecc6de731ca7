"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tandem", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, adaptive execution and skew-join handling switched on.

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    submitter; anything passed in ``conf`` wins (underscores stand for dots).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tandem-")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine:
    on a cluster the executors could not see it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the checkpoint folder, unique to this call."""
    return f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once below the shared folder and read it back.

    For results several branches need: they then share one computation, survive lost
    executors, and Spark knows their size when it plans the joins.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that no side may be broadcast in, as both grow with the corpus.

    Spark sizes a table by its files and row width: it does not see the rows an explode adds, nor how far files are
    compressed, and once a broadcast is planned it stays, as a plan with more shuffles counts as dearer.
    """
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate whose successor has been written in full."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def shuffle_tasks(spark: SparkSession, at_least: int | None):
    """Shuffles of jobs that run inside have at least so many tasks: for aggregates over long rows, whose groups would otherwise
    meet in as many tasks as the session sets, however large the input, and spill there."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), at_least or 0))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when the scan has fewer partitions than there are cores.

    A large table has more splits than cores and is left alone; a small file is a
    single split, and everything up to the next shuffle would run on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
