"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder that the context has its checkpoints in.

    Only a session in one process may do without: it gets a new temp folder. On a cluster that is an error, as every
    machine would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if spark.conf.get("spark.checkpoint.dir", None) != found:
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table: computed once, without lineage, and safe from the loss of any executor."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_tasks(spark: SparkSession, most: str = "2m"):
    """What runs within gets tasks of ``most`` shuffled bytes, as rows of a few numbers take some bytes each only, but a hundred in a task's memory."""
    key, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    held = spark.conf.get(key, None)
    if held is None or size(held) > size(most):
        spark.conf.set(key, most)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)
