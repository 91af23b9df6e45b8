"""Results with an age: rows of a cache table (key, ..., saved_at), and when they are too old."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours that weights stay fresh, hours after which a cleanup drops rows, and days that parameters stay fresh.
WEIGHT_HOURS, KEEP_HOURS, PARAMETER_DAYS = 72, 24, 180


def is_stale(last_updated: Column, now: Column, max_days: int = PARAMETER_DAYS) -> Column:
    """Whether a time, as text, is so many whole days ago or more; a missing or unreadable one is."""
    at = F.try_to_timestamp(last_updated)
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at)) / 86400)
    return F.coalesce(days >= max_days, F.lit(True))


def age_hours(now: Column) -> Column:
    return (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("saved_at"))) / 3600


def fresh(cache: DataFrame, key: str, now: Column, hours: float = WEIGHT_HOURS) -> DataFrame:
    """The rows of a key that were saved last, without key and saved_at, if they are younger than so many hours."""
    rows = cache.where(F.col("key") == key).withColumn("_last", F.max("saved_at").over(Window.partitionBy("key")))
    return rows.where((F.col("saved_at") == F.col("_last")) & (age_hours(now) < hours)).drop("key", "saved_at", "_last")


def pruned(cache: DataFrame, now: Column, hours: float = KEEP_HOURS) -> DataFrame:
    """The rows that a cleanup keeps: those younger than so many hours."""
    return cache.where(age_hours(now) < hours)


def remembered(path: str, key: str, build: Callable[[], DataFrame], like: DataFrame, hours: float = WEIGHT_HOURS) -> DataFrame:
    """The fresh rows of a key in the cache at path, or what build() makes, which is added to it; like has their columns."""
    spark, now = like.sparkSession, F.current_timestamp()
    schema = like.select("*", F.lit("").alias("key"), F.lit(None).cast("timestamp").alias("saved_at")).schema
    places = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = places.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(places)
    if there and not (found := fresh(spark.read.schema(schema).parquet(path), key, now, hours)).isEmpty():
        return found
    build().select(*like.columns).withColumns({"key": F.lit(key), "saved_at": now}).coalesce(1).write.mode("append").parquet(path)
    return fresh(spark.read.schema(schema).parquet(path), key, now, hours)
