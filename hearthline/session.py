"""Session-level choices shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGES: list[str] = []
_LOCAL: list[str] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared work folder. Only a local master may go without one: it gets one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="hearthline-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a reused result in the shared folder, so that lost executors cost little.

    Nothing reads the write's shuffles once the result is complete, so executors are told to drop their files.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, "stage"), spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Remove what `cut_lineage` wrote in this session, once the results that read it are stored."""
    while _STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

