"""The store of snapshots: whole versions, failed writes, writers at once; and tables without exchanges."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import align, windows
from tessera.sources import snapshots

DAY = dt.date(2020, 1, 1)


def table(spark, *rows):
    return spark.createDataFrame([(t, DAY + dt.timedelta(d), float(c)) for t, d, c in rows], "ticker string, date date, close double")


def content(df):
    return {(r["ticker"], (r["date"] - DAY).days): r["close"] for r in df.collect()}


def test_versions_upserts_and_backfills(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert snapshots.latest(spark, path) == (0, {})
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.upsert(spark, path, table(spark, ("A", 1, 1), ("B", 1, 2), ("B", 1, 2)), buckets=4) == 1
    assert snapshots.upsert(spark, path, table(spark, ("A", 1, 9), ("A", 2, 3), ("C", 1, 4)), buckets=4) == 2
    want = {("A", 1): 1, ("A", 2): 3, ("B", 1): 2, ("C", 1): 4}
    assert content(snapshots.read(spark, path)) == want
    assert snapshots.upsert(spark, path, table(spark, ("A", 1, 9)), forced=True, buckets=4) == 3
    assert snapshots.backfill(spark, path, table(spark, ("A", 0, 7), ("A", 1, 8), ("B", 5, 6)), buckets=4) == 4
    assert content(snapshots.read(spark, path)) == want | {("A", 1): 9, ("A", 0): 7, ("B", 5): 6}
    assert content(snapshots.read(spark, path, version=2)) == want and content(snapshots.read(spark, path, version=1)) == {("A", 1): 1, ("B", 1): 2}
    assert snapshots.upsert(spark, path, table(spark), buckets=4) == 4
    live = set(snapshots.latest(spark, path)[1].values())
    assert not live & {r["folder"] for r in snapshots.unused(spark, path).collect()} and snapshots.unused(spark, path, keep=9).isEmpty()
    with pytest.raises(ValueError):
        snapshots.read(spark, path, version=77)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/store"
    snapshots.upsert(spark, path, table(spark, *((f"T{i}", 0, i) for i in range(40))), buckets=8)
    before = snapshots.latest(spark, path)[1]
    snapshots.upsert(spark, path, table(spark, ("T3", 1, 1)), buckets=8)
    after = snapshots.latest(spark, path)[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/store"
    snapshots.upsert(spark, path, table(spark, ("A", 0, 1), ("B", 0, 2)), buckets=2)
    fails = lambda stored, fresh: fresh.withColumn("close", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        snapshots.commit(spark, path, table(spark, ("A", 1, 5)), fails, 2)
    assert content(snapshots.read(spark, path)) == {("A", 0): 1, ("B", 0): 2} and snapshots.latest(spark, path)[0] == 1


def test_writers_at_once_lose_no_rows(spark, tmp_path):
    path = f"{tmp_path}/store"
    tables = [table(spark, *((f"W{w}", d, w) for d in range(3)), ("shared", w, w)) for w in range(4)]
    failed = []

    def write(rows):
        try:
            snapshots.upsert(spark, path, rows, buckets=1)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(t,)) for t in tables]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert content(snapshots.read(spark, path)) == {(f"W{w}", d): w for w in range(4) for d in range(3)} | {("shared", w): w for w in range(4)}
    assert snapshots.latest(spark, path)[0] == 4


def test_a_version_is_claimed_once(spark, tmp_path):
    for path in (f"{tmp_path}/plain", f"file://{tmp_path}/uri", f"viewfs://here/{tmp_path.name}"):
        if path.startswith("viewfs"):
            os.makedirs(f"{tmp_path}/mounted/{tmp_path.name}")
            spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./" + tmp_path.name, f"file://{tmp_path}/mounted/{tmp_path.name}")
        row = [{"version": 1, "bucket": 0, "folder": "x"}]
        assert snapshots.claim(spark, path, 1, row) and not snapshots.claim(spark, path, 1, row)
        assert snapshots.latest(spark, path) == (1, {0: "x"})


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("T"), F.col("id") % 20).alias("ticker"), F.date_add(F.lit(DAY), (F.col("id") / 20).cast("int")).alias("date"), (F.rand(1) + 1).alias("adj_close"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    made = snapshots.bucketed(rows, "bucketed.prices", 4)
    other = snapshots.bucketed(rows.select("ticker", "date", F.col("adj_close").alias("m")), "bucketed.markets", 4)
    returns = windows.simple_returns(made)
    rolled = returns.withColumn("v", windows.rolling_std("ret", 5))
    joined = rolled.join(other.hint("merge"), ["ticker", "date"])
    wide = align.as_of(made, other, "m")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        for df in (returns, rolled, joined, rolled.groupBy("ticker").agg(F.avg("ret"))):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1  # a union of two tables is dealt out once
        assert joined.count() == wide.count() == 2000
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP DATABASE bucketed CASCADE")
