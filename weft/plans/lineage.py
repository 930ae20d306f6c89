"""Cutting lineage between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a scratch one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder; it survives executor loss."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet below the shared checkpoint folder and read back, and its folder, for ``removed``.

    A checkpoint keeps the size that the planner had estimated for df, and that of a join is the product of its sides: in a
    loop the number of its digits grows by a factor a round. A table read from files has the size of its files."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a table of ``stored_at`` that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
