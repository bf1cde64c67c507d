"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="grovemap-"))


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/grovemap/{label}-{uuid.uuid4().hex}"
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    return path


def cut(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later plans start from files instead of recomputing. Removed when the driver's JVM ends; instead: a table that an earlier cut returned and nothing but df still needs, which is removed now, so that loops don't fill the folder."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    if old := getattr(instead, "_cut_at", None):
        system, where = _at(spark, old)
        system.delete(where, True)
    return out
