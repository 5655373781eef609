"""The shared folder that tasks, driver and lost executors' successors can all read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset and the session is a local one, below a folder made here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and every reader sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str, buckets: int | None = None, sort: bool = False) -> DataFrame:
    """``df`` written to ``path`` in buckets of ``key`` (each sorted, if asked for) and read again: joins by ``key`` don't
    move it. The table's name is only needed to read the buckets and is dropped at once; its files stay."""
    spark = df.sparkSession
    table = f"bucketed_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key)
    (out.sortBy(key) if sort else out).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return back


def discard(spark: SparkSession, path: str) -> None:
    """Delete what this package has written to ``path`` and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
