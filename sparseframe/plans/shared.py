"""The folder that driver and executors share, tables in it, and what is known of an input's size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in memory that a join may send to all tasks.
SENT_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparseframe-"))
            got = sc._jsc.sc().getCheckpointDir()
        where = got.get()
    return where.rstrip("/")


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a table's bytes; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def by_size(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows for a join by key: sent to all tasks where they are few, else never.

    Spark takes a written table for as large as its compressed files, and would send millions of rows through the driver.
    """
    small = rows * (16 + df._jdf.schema().defaultSize()) <= SENT_BYTES
    return F.broadcast(df) if small else df.hint("merge")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    What a lazy result still reads stays until the application ends (expire); what no later
    plan reads is dropped by its maker.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table, written and to be read again; with a folder for each value of the whole number `by`, if given."""
        path, out = f"{self.root}/{name}", df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        self.expire()
        return self.spark.read.schema(df.schema).parquet(path)

    def _at(self, *name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *name)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def expire(self) -> None:
        """What is left goes when the application ends: results are lazy and may read it until then."""
        fs, path = self._at()
        fs.deleteOnExit(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)
