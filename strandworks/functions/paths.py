"""Where intermediate files go."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_folder(application: str) -> str:
    """A temporary folder of this machine, one for each application."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names.

    Where the session names none, a temporary folder serves, but only if the executors are threads of the driver; on a
    cluster that is an error, as its machines would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        root = own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """What an application's intermediate files stand in."""
    return f"strandworks-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes all intermediate files of this application, by Spark's own file systems; results not yet read are lost."""
    root = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder(spark)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
