"""The segmented scan against a walk row by row."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import scan, signals


IMAGES = list(product((-1, 0, 1), repeat=3))


def walk(codes):
    """state, place and entered of each row."""
    state, entered, out = 0, None, []
    for i, code in enumerate(codes):
        now = IMAGES[code][state + 1]
        entered = None if now == 0 else i if now != state else entered
        state = now
        out.append((state, i, entered))
    return out


def test_codes_compose_as_their_functions(spark):
    rows = spark.range(27).select(F.col("id").cast("int").alias("a")).join(spark.range(27).select(F.col("id").cast("int").alias("b")))
    for r in rows.select("a", "b", scan.composed("a", "b").alias("c"), scan.state_of("a").alias("s"), scan.code(*(F.lit(x) for x in (-1, 1, 0))).alias("k")).collect():
        assert IMAGES[r["c"]] == tuple(IMAGES[r["b"]][x + 1] for x in IMAGES[r["a"]])
        assert r["s"] == IMAGES[r["a"]][1] and IMAGES[r["k"]] == (-1, 1, 0)
    assert IMAGES[scan.SAME] == (-1, 0, 1)


@pytest.mark.parametrize("steps", [2, 10])
def test_scan_equals_the_walk_over_several_levels(spark, monkeypatch, steps):
    monkeypatch.setattr(scan, "STEPS", steps)
    monkeypatch.setattr(scan, "SLICE", 1 << steps)
    made = np.random.default_rng(0)
    holds = [IMAGES.index(x) for x in ((-1, 0, 1), (-1, 1, 1), (-1, -1, 0), (0, 0, 1), (0, 0, 0), (1, -1, -1))]
    series = {f"k{n}": [int(c) for c in made.choice(holds, n, p=(0.5, 0.1, 0.1, 0.1, 0.1, 0.1))] for n in (1, 2, 5, 17, 300)}
    rows = [(k, i, c) for k, codes in series.items() for i, c in enumerate(codes)]
    table = spark.createDataFrame(rows, "ticker string, date int, c int").orderBy(F.rand(1))
    got = {k: [] for k in series}
    for r in scan.run(table, F.col("c")).orderBy("ticker", "date").collect():
        got[r["ticker"]].append((r["state"], r["place"], r["entered"]))
    assert got == {k: walk(codes) for k, codes in series.items()}


def test_no_rows(spark):
    assert scan.run(spark.createDataFrame([], "ticker string, date int, c int"), F.col("c")).collect() == []


def test_one_long_series_is_spread_over_tasks(spark):
    n = 1_000_000
    line = spark.range(n).select(F.lit("basket").alias("ticker"), F.col("id").alias("date"), F.sin(F.col("id") / 50).alias("dev"))
    held = signals.basket_positions(line, -0.5, 0.5)
    got = held.agg(F.count("*"), F.count_if(F.col("position") == 1), F.count_if(F.col("position") == -1)).first()
    dev, now, counts = np.sin(np.arange(n) / 50), 0, [0, 0, 0]
    for d in dev:
        now = (1 if d < -0.5 else -1 if d > 0.5 else 0) if now == 0 else 0 if now == 1 and d >= 0 or now == -1 and d <= 0 else now
        counts[now] += 1
    assert tuple(got) == (n, counts[1], counts[-1])


def test_parts_of_one_series_are_many(spark):
    line = spark.range(200_000).select(F.lit("one").alias("ticker"), F.col("id").alias("date"), F.lit(scan.SAME).alias("c"))
    parts = line.repartitionByRange(8, "ticker", "date").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 60_000
