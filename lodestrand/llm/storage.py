"""Tables written between the phases of an operator.

Every phase that others build on is written to the folder that the session names in
``spark.checkpoint.dir`` and read back, so that a lost executor costs a task and not
the lineage before it. All reading and writing goes through Spark's own readers and
writers; no path is opened by Python.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import attach


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is configured, one of our own on a single machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A folder of written tables that belongs to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = attach(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the DataFrame that reads it back."""
        self.tables += 1
        path = f"{self.root}/{self.tables:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a written table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def release(self, rounds: int = 1) -> None:
        """Let Spark remove shuffle files of finished phases now, not at its next collection. The
        files of the phase that has just ended go in the second round."""
        for _ in range(rounds):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            if rounds > 1:
                time.sleep(0.5)
