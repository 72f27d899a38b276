"""Intermediate tables in the session's shared folder, which every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset a local session (tests, the command line) gets a folder of
    its own; on a cluster it is an error, as executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._pl_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no frame still in use reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df._pl_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def gather(df: DataFrame) -> DataFrame:
    """df as a local table of the driver. Only for tables whose rows are bounded by the number of columns."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)
