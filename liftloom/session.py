"""Spark session set-up."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings that can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # merge session windows on the map side, so one busy session reaches the shuffle as a few rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


#: shuffle bytes per task that leave room for sorting in memory
TASK_BYTES = 256 * 1024 * 1024


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings the jobs rely on to a session somebody else made.

    Tell the input size of a large run: shuffles then start with a task per 256 MB of it, and adaptive execution merges
    those that turn out small. It can merge tasks but not split them, so starting too low costs more than too high.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(now, -(-input_bytes // TASK_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(tasks))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES // 2))
    return spark


def build(name: str, cpus: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session, for tests and the bench. On a cluster use its own session and :func:`tune`.

    ``shared`` is the folder for written intermediate results.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every node can reach: ``spark.checkpoint.dir`` where the session names one.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="liftloom-")
    return _own_folders[context.applicationId]


_within = threading.local()


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`written` makes inside the block when it ends, also by an error.

    For a result that is itself stored inside the block, such as that of a micro-batch; frames made of such tables cannot be
    read afterwards. Blocks may be nested, and each thread has its own.
    """
    if not hasattr(_within, "paths"):
        _within.paths = []
    _within.paths.append([])
    try:
        yield
    finally:
        for name in _within.paths.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, by: SparkSession | None = None) -> DataFrame:
    """Write a result that is read more than once to the shared folder, and return it as a table read from there.

    This computes it once, cuts its lineage, and survives the loss of the executors that made it. ``by`` reads it, if not the session of ``df``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_within, "paths", None):
        _within.paths[-1].append(path)
    df.write.parquet(path)
    return (by or df.sparkSession).read.schema(df.schema).parquet(path)
