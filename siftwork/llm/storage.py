"""Tables between steps, in the session's checkpoint folder, which all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}.parquet"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one computation: written, read back without their lineage, and deleted when they are no longer needed.

    They have Spark's own compression: a stronger one takes native memory for every column and thread, which an executor doesn't give back.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = table_path(self.spark, name)
        rows.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Deletes the n oldest tables."""
        for path in self.paths[:n]:
            delete(self.spark, path)
        del self.paths[:n]

    def done(self, *names: str) -> None:
        """Deletes the tables of these names, and lets go of what made them."""
        for path in [p for p in self.paths if p.rpartition("/")[2].rpartition("-")[0] in names]:
            delete(self.spark, path)
            self.paths.remove(path)
        self.tidy()

    def tidy(self) -> None:
        """Lets go of what steps that have ended still hold: Spark deletes shuffle files once the driver's garbage is collected.

        On a cluster the scheduler holds on to the plan of its last job, so that is made a small one.
        """
        self.spark.range(1).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Deletes the tables; nothing that is still to be computed may read them."""
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()
        self.tidy()
