"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "cohortscale") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COHORTSCALE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortscale-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never one that exists."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows, and the partition each is in, are fixed from here on."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of what is run within, the shuffle files go as soon as it has ended; Spark else keeps them until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once in columns and read from there; the shuffles they came from are freed.

    What is repeated takes little room, where ``cut_lineage`` keeps whole rows; the partition each row was in is not kept.
    """
    path = scratch_path(df.sparkSession, "stored")
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: MB of a batch of whole rows that goes to Python. Executor and worker each hold a few such batches.
BATCH_MB = 4


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most ``BATCH_MB``, a setting of the session; Spark's own limit is 64."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_MB}m")


#: Rows of a task, about, where a step holds or sorts them.
ROWS_PER_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks to deal ``rows`` to: as many as the session has, more where a task would hold too many."""
    return max(width(spark), -(-rows // ROWS_PER_TASK))


def width(spark: SparkSession) -> int:
    """How many tasks to spread generated rows over; AQE would merge them, being few bytes."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
