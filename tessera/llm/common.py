"""What the operators of this subpackage share: staged tables, row keys and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship

#: ASCII white space: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_staged: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own in local mode."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and its shuffle files can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    with contextlib.suppress(Exception):  # a Spark without this setting keeps its shuffle files a little longer
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """stage(df), and then delete all other tables that were staged after the first since ones: df's inputs among them."""
    out = stage(df, name)
    drop_staged(since, len(_staged) - 1)
    return out


def staged_so_far() -> int:
    return len(_staged)


@atexit.register
def drop_staged(a: int = 0, b: int | None = None) -> None:
    """Delete the staged tables of this process, or those from a to b."""
    gone = _staged[a:b]
    del _staged[a:b]
    for spark, path in gone:
        with contextlib.suppress(Exception):  # the session may have ended
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(docs: DataFrame, gone: DataFrame, *more: Column) -> DataFrame:
    """docs less the rows whose doc_id (and values of more) are among the columns of gone; nulls are equal, and no column name clashes."""
    name = "_gone"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    rows = gone.toDF(*(f"{name}{i}" for i in range(1 + len(more)))).distinct()
    same = [x.eqNullSafe(F.col(f"{name}{i}")) for i, x in enumerate([F.col("doc_id"), *more])]
    return docs.join(rows, same, "left_anti")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def white_words(text: Column) -> Column:
    """The runs of characters that aren't ASCII white space."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def variant(text: Column) -> Column:
    """A 64-bit hash of a text: with doc_id, the key of a row whose doc_id may be repeated."""
    return F.xxhash64(text)


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each value begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
