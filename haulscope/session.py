"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does three jobs here: it switches to a broadcast join only after the
# side's real size is known, splits skewed join partitions, and coalesces small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "haulscope", **overrides: str) -> SparkSession:
    """A session with the settings above; ``overrides`` use ``__`` for ``.`` in a key."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint directory of the session.

    Only a local session, whose executors share the driver's disk, may fall back to a
    temporary folder; a cluster without ``spark.checkpoint.dir`` is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="haulscope-")
    context.setCheckpointDir(cleaned(spark, f"file://{folder}"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared directory."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


def cleaned(spark: SparkSession, folder: str) -> str:
    """Have a work folder deleted when the session ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """Compute a result once, as compressed Parquet in the shared directory, and read it back.

    For large results that several passes read. ``folders`` are columns that become folders, so that
    readers open only those they ask for. The files go when the session ends.
    """
    spark = df.sparkSession
    target = cleaned(spark, work_folder(spark, purpose))
    df.write.partitionBy(*folders).parquet(target) if folders else df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files on the disks; otherwise they stay until the
    driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small intermediate result once, into the shared checkpoint directory (eager).

    For results that several branches of a plan read: without it each branch scans the large
    table again. Reliable, so a lost executor costs nothing.
    """
    context = df.sparkSession.sparkContext
    root = shared_root(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return df.checkpoint()
