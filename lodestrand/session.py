"""Sessions and what Python workers need."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed for them."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine, as tests and the benchmark use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestrand")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)


def checkpoints(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Without that setting, one of our own on a single machine (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestrand-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as rows in the checkpoint folder, for columns such as a partition's number that must not
    be made twice."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
