"""Tables written to the cluster's shared folder, to cut lineage or to read a costly result twice."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set to a temporary one only where it is unset, and only in local mode."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    discard(spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Has ``path`` removed when the application ends."""
    _written.append((spark, path))


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written once and read back.

    The copy lies where every executor can read it, so losing executors loses
    nothing.  It is removed when the application ends.
    """
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
