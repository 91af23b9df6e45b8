"""Cut the lineage of an intermediate table: write it to the shared folder, read it back."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where it is unset, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and kept as columns, so that later plans read only what they need of it and know its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_staged() -> None:
    """Delete the tables that this process has staged."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
