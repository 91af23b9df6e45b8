"""Stores, caches and streams, which queries on one table can't show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import caching
from tessera.plans import portfolio
from tessera.sources import prices
from tessera.streaming import bars

DAY = dt.date(2020, 1, 1)


def table(spark, *rows):
    return spark.createDataFrame([(t, DAY + dt.timedelta(d), c) for t, d, c in rows], "ticker string, date date, close double")


def full(rows):
    return rows.select("ticker", "date", *(F.col("close").alias(c) for c in ("open", "high", "low")), "close", F.col("close").alias("adj_close"), F.lit(1.0).alias("volume"))


def test_store_keeps_what_is_there_and_reads_what_is_asked(spark, tmp_path):
    path = f"{tmp_path}/store"
    prices.write_store(full(table(spark, ("A", 0, 1.0), ("A", 1, 2.0), ("B", 0, 3.0))), path)
    stored = prices.read_store(spark, path)
    prices.save_new(full(table(spark, ("A", 0, 9.0), ("C", 0, 4.0))), path, stored)
    got = {(r["ticker"], r["close"]) for r in prices.read_store(spark, path).collect()}
    assert got == {("A", 1.0), ("A", 2.0), ("B", 3.0), ("C", 4.0)}
    prices.save_new(full(table(spark, ("A", 0, 9.0))), path, stored, forced=True)
    assert {(r["ticker"], r["close"]) for r in prices.read_store(spark, path).collect()} == {("A", 9.0), ("B", 3.0), ("C", 4.0)}
    asked = prices.read_store(spark, path, ["A"], "2020-01-01", "2020-01-31")
    plan = asked.select("close")._jdf.queryExecution().executedPlan().toString()
    assert "ticker" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan and "open" not in plan.split("ReadSchema")[1]


def test_csv_histories(spark, tmp_path):
    (tmp_path / "XYZ.csv").write_text("When,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,,2,0.5,NaN,10\n")
    rows = sorted(prices.csv_prices(spark, str(tmp_path)).collect(), key=lambda r: r["date"])
    assert [(r["ticker"], r["date"], r["open"], r["close"], r["adj_close"]) for r in rows] == [("XYZ", dt.date(2020, 1, 2), 1.0, 1.5, 1.5), ("XYZ", dt.date(2020, 1, 3), None, None, None)]


def test_snap_refuses_other_directions(spark):
    with pytest.raises(ValueError):
        prices.snap(spark.range(1).select(F.current_date().alias("date")), prices.calendar(spark, "2020-01-01", "2020-01-31"), "up")


def test_synthetic_returns_are_seeded_normal_business_days(spark):
    rows = prices.synthetic(spark, 20, 252)
    got = rows.agg(F.count("*"), F.avg("ret"), F.stddev_samp("ret"), F.count_if(F.weekday("date") > 4)).first()
    assert got[0] == 20 * 252 and abs(got[1] - 0.0005) < 0.002 and abs(got[2] - 0.02) < 0.001 and got[3] == 0
    assert rows.exceptAll(prices.synthetic(spark, 20, 252)).isEmpty() and not rows.exceptAll(prices.synthetic(spark, 20, 252, seed=1)).isEmpty()


def test_cache_builds_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("A", 0.25), ("B", 0.75)], "ticker string, weight double")

    like = spark.createDataFrame([], "ticker string, weight double")
    for _ in range(2):
        got = caching.remembered(f"{tmp_path}/cache", "k", build, like)
        assert {(r["ticker"], r["weight"]) for r in got.collect()} == {("A", 0.25), ("B", 0.75)}
    assert len(made) == 1
    caching.remembered(f"{tmp_path}/cache", "k", build, like, hours=0)
    assert len(made) == 2
    assert caching.pruned(spark.read.parquet(f"{tmp_path}/cache"), F.current_timestamp() + F.expr("interval 30 hours")).isEmpty()


def test_configuration_and_models():
    config = portfolio.Config.from_dict({"models": {"1.5": ["nested_clustering"]}, "objective": "kappa", "unknown": 1})
    assert config.models == ((1.5, ("nested_clustering",)),) and config.objective == "kappa" and config.min_weight == 0.01
    with pytest.raises(ValueError, match="unknown model"):
        portfolio.optimise("nothing", None, config)
    portfolio.model("mine")(lambda returns, *rest: returns)
    assert portfolio.optimise("mine", "r", config) == "r" and portfolio.MODELS.pop("mine")


def streamed(spark, tmp_path, batches, transform, name):
    """What a stream over these batches, one file each, has written in append mode."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, ticker string").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in{i}")
    schema = spark.read.parquet(f"{tmp_path}/in0").schema
    out, source = f"{tmp_path}/out", f"{tmp_path}/all"
    for i in range(len(batches)):
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(source)
        query = transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def event(i, minutes, value=1.0, user=1, ticker="T"):
    return (i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=minutes), user, "click", value, ticker)


def test_late_rows_do_not_change_closed_bars(spark, tmp_path):
    batches = [[event(1, 5, 1.0), event(2, 30, 3.0)], [event(3, 200, 5.0)], [event(4, 20, 99.0), event(5, 400, 7.0)], [event(6, 700, 1.0)]]
    got = {r["start"].hour: (r["open"], r["high"], r["n"]) for r in streamed(spark, tmp_path, batches, lambda s: bars.bars(s, late="30 minutes"), "bars").collect()}
    assert got[0] == (1.0, 3.0, 2) and got[3] == (5.0, 5.0, 1)


def test_streamed_sessions_end_after_the_gap(spark, tmp_path):
    batches = [[event(1, 0), event(2, 20)], [event(3, 45)], [event(4, 300)], [event(5, 600)]]
    got = {r["start"].hour: r["n"] for r in streamed(spark, tmp_path, batches, lambda s: bars.sessions(s, late="10 minutes"), "sessions").collect()}
    assert got[0] == 3 and got[5] == 1


def test_streamed_repeats_are_dropped(spark, tmp_path):
    batches = [[event(1, 0), event(2, 0)], [event(3, 0), event(4, 1)]]
    got = [r["ts"].minute for r in streamed(spark, tmp_path, batches, lambda s: bars.append_only(s), "once").collect()]
    assert sorted(got) == [0, 1]
