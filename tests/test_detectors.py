"""Detectors over many tickers at once."""

import datetime as dt

import numpy as np
import pytest

from tessera.functions import numerics
from tessera.operators import anomaly


def table(spark, sizes, seed=0):
    made = np.random.default_rng(seed)
    rows = [(f"T{i:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(made.normal(0, 0.02) + (0.5 if k == n // 2 else 0))) for i, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double")


def test_series_side_by_side_are_filtered_as_each_alone():
    y = np.random.default_rng(1).normal(0, 0.1, (90, 6))
    y[:, 1], y[:, 2] = 0.0, np.arange(90) / 2
    both = numerics.kalman_residuals(y)
    for i in range(6):
        assert both[:, i] == pytest.approx(numerics.kalman_residuals(y[:, i]), abs=1e-10)
    assert numerics.kalman_residuals(y[:2]).shape == (2, 6)


def test_tickers_are_whole_however_the_rows_come(spark, monkeypatch):
    rows = table(spark, [80, 80, 3, 41, 80, 1, 41])
    whole = {(r["ticker"], r["date"]): r["flag"] for r in anomaly.kalman(rows, 3.0).collect()}
    monkeypatch.setattr(anomaly, "ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = {(r["ticker"], r["date"]): r["flag"] for r in anomaly.kalman(rows, 3.0).collect()}
        study = {r["ticker"]: r["fraction"] for r in anomaly.threshold_study(rows, "kalman").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == parts and len(whole) == 326 and any(whole.values())
    assert set(study) == {f"T{i:02d}" for i in range(7)} and all(0 <= x <= 1 for x in study.values())


@pytest.mark.parametrize("n, d, size", [(120, 3, 64), (40, 1, 256), (9000, 2, 32), (30, 2, 16)])
def test_a_forest_grown_by_levels_is_that_of_one_node_after_another(n, d, size):
    x = np.round(np.random.default_rng(n).normal(size=(n, d)), 1 if n == 30 else 9)
    trees, made, least = 7, np.random.default_rng(42), min(size, n)
    levels = int(np.ceil(np.log2(max(least, 2))))
    samples = [made.choice(n, least, replace=False) for _ in range(trees)]
    pick, place = made.random((2, trees, 2 << levels))
    usual = lambda m: 0.0 if m < 2 else 1.0 if m == 2 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def depth(tree, row):
        inside, node, k = x[samples[tree]], 1, 0
        while True:
            open_ = np.flatnonzero(inside.max(0) > inside.min(0)) if len(inside) else []
            if k == levels or not len(open_):
                return k + usual(len(inside))
            c = open_[int(pick[tree, node] * len(open_))]
            low, high = inside[:, c].min(), inside[:, c].max()
            cut = low + (high - low) * place[tree, node]
            right = row[c] >= cut
            inside, node, k = inside[(inside[:, c] >= cut) == right], 2 * node + right, k + 1

    some = np.arange(0, n, max(1, n // 40))
    want = [0.5 - 2.0 ** (-sum(depth(t, x[i]) for t in range(trees)) / trees / usual(least)) for i in some]
    assert numerics.isolation_scores(x, trees, size)[some] == pytest.approx(want, abs=1e-12)
