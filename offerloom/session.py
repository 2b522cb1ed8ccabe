"""Session set-up and the shared work folder."""

from __future__ import annotations

import contextlib
import dataclasses
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("offerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("OFFERLOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="offerloom-")
    spark.conf.set(CHECKPOINT_KEY, named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table or stream."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so later stages see one fixed set of rows."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in this block go when its query ends, instead of whenever the driver collects garbage."""
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


@dataclasses.dataclass(frozen=True)
class Stored:
    """Rows that lie in the shared folder as Parquet until they are dropped."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.rows.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> Stored:
    """One fixed set of rows, as ``durable`` gives it, that leaves no shuffle files and can be dropped."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)
