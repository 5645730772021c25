"""Where files between steps go."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder, which all executors share."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes the files, and lets go of what steps that have ended still hold: Spark deletes shuffle files once the driver's garbage is collected."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
