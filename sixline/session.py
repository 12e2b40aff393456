"""Session helpers: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in local mode is a temporary folder used; a cluster
    without the setting is an error, since a machine's own folder isn't seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = os.path.join(tempfile.gettempdir(), "sixline-checkpoints")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_MADE: list[str] = []


def tidy(spark: SparkSession) -> None:
    """Deletes what this process wrote to shared storage to cut lineage; call it when no result is needed any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    context = spark.sparkContext.getCheckpointDir()
    for path in [*_MADE, *([context] if context else [])]:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.clear()
    if context:
        spark.sparkContext.setCheckpointDir(context.rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from shared storage, so that its lineage ends here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def cut_columnar(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`cut`, written as Parquet: for tables that are read several times by few columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
