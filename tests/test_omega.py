"""The Omega program against grids, the gradient method and its own bound."""

import datetime as dt
import itertools

import numpy as np
import pytest

from tessera.functions import numerics
from tessera.operators import omega

DAY = dt.date(2020, 1, 1)


def series(n, k, seed):
    made = np.random.default_rng(seed)
    return made.normal(made.uniform(-0.0005, 0.002, k), made.uniform(0.005, 0.02, k), (n, k))


def table(spark, x):
    return spark.createDataFrame([(f"T{j:02d}", DAY + dt.timedelta(i), float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "ticker string, date date, ret double").repartition(4)


def ratio(x, w, target=0.0):
    r = x @ w - target
    return np.maximum(r, 0).sum() / np.maximum(-r, 0).sum()


@pytest.mark.parametrize("cap, target", [(1.0, 0.0), (0.5, 0.0003)])
def test_no_point_of_a_fine_grid_is_better(spark, cap, target):
    x = series(150, 3, 1)
    rows = omega.best_weights(table(spark, x), cap, target).orderBy("ticker").collect()
    w = np.array([r["weight"] for r in rows])
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= cap + 1e-7 and abs(rows[0]["gap"]) < 1e-8
    grid = [np.array(c) / 60 for c in itertools.product(range(61), repeat=3) if sum(c) == 60 and max(c) <= 60 * cap]
    best = max(ratio(x, g, target) for g in grid)
    assert best - 1e-9 <= ratio(x, w, target) == pytest.approx(rows[0]["omega"])


def test_as_good_as_the_gradient(spark):
    x = series(250, 12, 2)
    rows = omega.best_weights(table(spark, x), 0.3).orderBy("ticker").collect()
    w = np.array([r["weight"] for r in rows])
    other = numerics.best_weights("omega", x.mean(0), np.cov(x, rowvar=False), x, 0.3)
    assert ratio(x, w) >= ratio(x, other) - 1e-9 and abs(rows[0]["gap"]) < 1e-8 and w.max() <= 0.3 + 1e-7


def test_no_excess_one_ticker_and_no_rows(spark):
    fall = omega.best_weights(table(spark, -np.abs(series(30, 3, 3)))).collect()
    assert [r["weight"] for r in fall] == pytest.approx([1 / 3] * 3) and fall[0]["gap"] is None
    alone = omega.best_weights(table(spark, np.abs(series(30, 1, 4)) - 0.003)).collect()
    assert alone[0]["weight"] == 1.0
    assert omega.best_weights(table(spark, series(1, 1, 5)).limit(0)).collect() == []
