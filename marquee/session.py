"""Where intermediate results that must outlive an executor are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it.  Where that is unset, as in tests, a folder in the
    warehouse serves, which driver and executors share as well; it goes when the session ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    root = f"{warehouse}/_intermediate-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A path nobody has written to yet, under the shared folder."""
    return f"{durable_root(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written to the shared folder and read from there on.

    A Parquet table rather than an RDD checkpoint: later steps read only the columns they need,
    and the planner knows its size.
    """
    spark = df.sparkSession
    path = new_folder(spark, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
