"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode gets a fresh folder, as in tests; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str = "index") -> str:
    """A fresh folder in it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path of a folder that every machine mounts; a store that only Spark reads has none."""
    scheme, sep, path = folder.partition(":")
    if not sep or "/" in scheme:
        return folder
    if scheme != "file":
        raise ValueError(f"{folder} is no mounted folder")
    return "/" + path.lstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever reads it and whichever executor is lost."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
