"""Machines on streams against the batch operators, with rows out of order and late ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signals
from tessera.streaming import machines

pytest.importorskip("google.protobuf")  # what Spark's Python workers speak with the state store
DAY = dt.datetime(2020, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def streamed(spark, tmp_path, batches, schema, transform):
    """What a stream over these batches has written, one run for each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        made = transform(spark.readStream.schema(schema).parquet(f"{tmp_path}/source"))
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def shuffled(rows, made, size=12):
    """Batches of rows that are up to ten days out of order, and an end that passes all."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] - DAY).days + made.uniform(0, 10))
    return [[rows[i] for i in order[k : k + size]] for k in range(0, len(order), size)]


def test_positions_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    made = np.random.default_rng(0)
    rows = [(t, DAY + dt.timedelta(d), float(v) if made.random() > 0.05 else None, -0.5, 0.5) for t in "AB" for d, v in enumerate(np.sin(np.arange(30) / 3) + made.normal(0, 0.3, 30))]
    end = [(t, DAY + dt.timedelta(200), 0.0, -0.5, 0.5) for t in "AB"]
    late = [("A", DAY - dt.timedelta(300), 9.0, -0.5, 0.5)]
    schema = "ticker string, ts timestamp, dev double, stop double, take double"
    got = streamed(rocks, tmp_path, [*shuffled(rows, made, 20), end, late, end], schema, lambda s: machines.positions(s, "15 days"))
    batch = rocks.createDataFrame(rows, schema).withColumn("date", F.col("ts"))
    want = signals.basket_positions(batch, F.col("stop"), F.col("take"))
    assert {(r["ticker"], r["ts"]): r["position"] for r in got.where("ts < '2020-06-01'").collect()} == {(r["ticker"], r["date"]): r["position"] for r in want.collect()}
    assert got.where("ts < '2020-06-01'").count() == len(rows)


def test_signals_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    made = np.random.default_rng(1)
    rows = [(t, DAY + dt.timedelta(d), float(z) if d > 3 else None, 0.8, 1.0, 1.2) for t in "AB" for d, z in enumerate(1.8 * np.sin(np.arange(30) / 2) + made.normal(0, 0.3, 30))]
    end = [(t, DAY + dt.timedelta(200), 0.0, 0.8, 1.0, 1.2) for t in "AB"]
    schema = "ticker string, ts timestamp, z double, decay double, high double, low double"
    got = streamed(rocks, tmp_path, [*shuffled(rows, made, 20), end, end], schema, lambda s: machines.states(s, "15 days")).where("ts < '2020-06-01'")
    want = {(r["ticker"], r["date"]): (r["state"], r["adj"]) for r in signals.walked(rocks.createDataFrame(rows, schema).withColumn("date", F.col("ts")), 0.5).collect()}
    found = {(r["ticker"], r["ts"]): (r["state"], r["adj"]) for r in got.collect()}
    assert found.keys() == want.keys() and {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert [found[k][1] for k in sorted(want)] == pytest.approx([want[k][1] for k in sorted(want)])
