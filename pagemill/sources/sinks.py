"""Sinks: resumable, idempotent or only-if-changed writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.ranking import same_rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what stands at ``path``, if anything does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def append_new(df: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame] = lambda new: new) -> int:
    """Append the rows whose key the table at ``path`` doesn't have yet; how many. ``make`` is applied to those rows alone.

    Rows are written once and counted by what was written; without new ones nothing is. A table that lacks the key is an error.
    """
    spark = df.sparkSession
    there = exists(spark, path)
    if there:
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        if df.isEmpty():
            return 0
    seen = Observation()
    make(df.dropDuplicates([key])).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write unless the table at ``path`` has the very rows; whether it was written."""
    spark = df.sparkSession
    if exists(spark, path) and same_rows(df, spark.read.schema(df.schema).parquet(path)).first()["same"]:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def once(path: str, make, spark: SparkSession) -> DataFrame:
    """The table at ``path``; made and written first if it isn't finished."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
