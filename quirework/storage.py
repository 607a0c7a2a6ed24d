"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only local sessions may do without the setting."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark, "_quirework_shared", None) or tempfile.mkdtemp(prefix="quirework-")
        spark._quirework_shared = folder
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again, so that lost executors cost nothing upstream."""
    path = f"{shared_folder(df.sparkSession)}/quirework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quirework_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable tables from which nothing is left to be read: all that came of them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quirework_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
