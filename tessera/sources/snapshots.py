"""A price store of snapshots: folders that are never changed, and a list of those that make up each version.

Tickers are dealt to buckets by hash. A write makes new folders for the buckets that it touches, out of the last version's rows and its
own, and then claims the next version by a file that must not be there yet; if another writer was first, it begins again from
that version. So a reader sees a whole version or the one before, a write that fails leaves nothing but unused files,
and of two writers neither loses rows.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import staged
from tessera.sources import prices

BUCKETS, TRIES = 64, 20
LISTED = "version long, bucket int, folder string"


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int").alias("bucket")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, bucket and folder of every version that is there."""
    try:
        return spark.read.schema(LISTED).json(f"{path}/_versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTED)


def latest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """The last version (or the one asked for) and the folder of each of its buckets; 0 and none before the first write."""
    known = versions(spark, path)
    at = known.agg(F.max("version")).first()[0] if version is None else version
    rows = known.where(F.col("version") == at).collect() if at else []  # a row for each bucket
    if version and not rows:
        raise ValueError(f"there is no version {version}")
    return at or 0, {r["bucket"]: r["folder"] for r in rows}


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None, like: DataFrame | None = None) -> DataFrame:
    """The rows of a version, the last if none is given; an empty table like like before the first write."""
    _, folders = latest(spark, path, version)
    chosen = [f"{path}/{folder}" for b, folder in sorted(folders.items()) if buckets is None or b in buckets]
    if chosen:
        return spark.read.schema(like.schema).parquet(*chosen) if like is not None else spark.read.parquet(*chosen)
    if like is None:
        raise ValueError(f"{path} has no rows yet")
    return like.limit(0)


def claim(spark: SparkSession, path: str, version: int, rows: list[dict]) -> bool:
    """Whether this writer was the first to make the version; its list appears whole or not at all."""
    text = "".join(json.dumps(row) + "\n" for row in rows)
    local = path.removeprefix("file://") if "://" not in path.removeprefix("file://") else None
    if local is not None:
        os.makedirs(f"{local}/_versions", exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=f"{local}/_versions", prefix="_", delete=False) as out:
            out.write(text)
        try:
            os.link(out.name, f"{local}/_versions/{version:010d}.json")  # fails if it is there
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(out.name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{name}")
    made, target = at(f"_{uuid.uuid4().hex}"), at(f"{version:010d}.json")
    files = made.getFileSystem(conf)
    with contextlib.closing(files.create(made)) as out:
        out.write(bytearray(text.encode()))
    how = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf).rename(made, target, options)  # atomic, and fails if it is there
        return True
    except Exception as e:
        files.delete(made, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def commit(spark: SparkSession, path: str, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Make the next version of merge(stored, fresh), bucket by bucket; only buckets with rows of fresh are read and written."""
    fresh = staged(fresh)
    touched = sorted(r["bucket"] for r in fresh.select(bucket(buckets)).distinct().collect())  # buckets at most
    for _ in range(TRIES):
        version, folders = latest(spark, path)
        if not touched:
            return version
        stored = read(spark, path, version or None, touched, fresh)
        name = f"data/{uuid.uuid4().hex}"
        rows = merge(stored, fresh).withColumn("_bucket", bucket(buckets))
        order = ["_bucket", *(c for c in ("ticker", "date") if c in rows.columns)]
        rows.repartition("_bucket").sortWithinPartitions(*order).write.partitionBy("_bucket").parquet(f"{path}/{name}")
        now = folders | {b: f"{name}/_bucket={b}" for b in touched}
        if claim(spark, path, version + 1, [{"version": version + 1, "bucket": b, "folder": folder} for b, folder in sorted(now.items())]):
            return version + 1
    raise Conflict(f"{TRIES} tries")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, forced: bool = False, buckets: int = BUCKETS) -> int:
    """prices.upsert() into the store: its version after it."""
    return commit(spark, path, fresh, lambda stored, rows: prices.upsert(stored, rows.dropDuplicates(["ticker", "date"]), forced), buckets)


def backfill(spark: SparkSession, path: str, fresh: DataFrame, buckets: int = BUCKETS) -> int:
    """prices.backfill() into the store: its version after it."""
    return commit(spark, path, fresh, prices.backfill, buckets)


def unused(spark: SparkSession, path: str, keep: int = 1) -> DataFrame:
    """folder: those that none of the last keep versions has."""
    known = versions(spark, path)
    last = (known.agg(F.max("version")).first()[0] or 0) - keep
    return known.where(F.col("version") <= last).select("folder").distinct().join(known.where(F.col("version") > last).select("folder"), "folder", "left_anti")


def bucketed(rows: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """rows as a catalogue table whose files are hashed and sorted by ticker: windows and groups by ticker need no exchange.

    Nor do joins by ticker and date, if spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    rows.write.mode("overwrite").bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(table)
    return rows.sparkSession.table(table)
