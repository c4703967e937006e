"""Shared working folder: staged tables, reuse by parameters, streaming state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import exists, params_key


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A private folder stands in for it only in a local session, where every task sees it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="relaydesk-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Workspace:
    """A run's own folder below the shared one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/run-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, name: str, df: DataFrame, compression: str | None = None) -> DataFrame:
        """Write a table and go on from the written copy: computed once, read by many plans, and
        safe when executors are lost. ``compression`` is a Parquet codec, else the session's."""
        writer = df.write.mode("overwrite")
        (writer.option("compression", compression) if compression else writer).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def once(self, name: str, params: dict, build) -> DataFrame:
        """The table built with exactly these parameters, reused if a finished copy is there."""
        path = self.path(params_key(name, params))
        if not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
