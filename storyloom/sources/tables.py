"""A table of Parquet files parted by day, changed by whole partitions: those without a changed row keep their files.

Changes are written beside the table and moved into place when the job is done, so a lost executor costs tasks and never a half-written
partition. An upsert keeps the latest version of each key and a patch sets fields to given values, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import merge_fields, upsert_articles

DAY = "published_date"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_days(df: DataFrame, path: str, day: str = DAY) -> None:
    """Replace the partitions of path that df has rows of. A day's rows are together in few files; a day with very many is split."""
    df.hint("rebalance", F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _touched(spark: SparkSession, path: str, changes: DataFrame, day: str) -> DataFrame:
    """The table's rows of the days that changes has: what is sent is a row a day, and prunes the scan's partitions."""
    return spark.read.parquet(path).join(F.broadcast(changes.select(day).filter(F.col(day).isNotNull()).distinct()), day, "left_semi")


def upsert_table(path: str, updates: DataFrame, key: str, version: str = "updated_at", first: str = "fetched_at", day: str = DAY) -> None:
    """upsert_articles into the table at path, which is made where it isn't there. A key's day never changes: it is a part of the id."""
    spark = updates.sparkSession
    base = _touched(spark, path, updates, day).select(updates.columns) if exists(spark, path) else updates.limit(0)
    write_days(upsert_articles(base, updates, key, version, first), path, day)


def patch_table(path: str, patch: DataFrame, key: str, day: str = DAY) -> None:
    """merge_fields of patch (key, day, fields) into the table at path; keys that it hasn't are left out."""
    base = _touched(patch.sparkSession, path, patch, day)
    write_days(merge_fields(base, patch.drop(day), key), path, day)
