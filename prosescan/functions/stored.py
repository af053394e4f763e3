"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this driver has written and not deleted yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where none is (as in tests), one beside the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written and read again: its plan is cut, and lost executors cost no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_stored(spark: SparkSession) -> None:
    """Deletes all that stored wrote; DataFrames that were made of it can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
