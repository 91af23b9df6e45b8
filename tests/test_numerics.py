"""The dense algorithms against brute force, closed forms and hand-made cases."""

import itertools

import numpy as np
import pytest

from tessera.functions import numerics
from tessera.operators.metrics import OBJECTIVES


def series(n=120, k=3, seed=0):
    made = np.random.default_rng(seed)
    return made.normal([0.001, 0.002, 0.0005][:k], [0.01, 0.02, 0.005][:k], (n, k))


def simplex(k, steps):
    return [np.array(c, float) / steps for c in itertools.product(range(steps + 1), repeat=k) if sum(c) == steps]


@pytest.mark.parametrize("name", OBJECTIVES)
def test_weights_are_as_good_as_the_best_of_a_fine_grid(name):
    x = series()
    mu, cov = x.mean(0) * 252, np.cov(x, rowvar=False) * 252
    w = numerics.best_weights(name, mu, cov, x)
    f = numerics.objective(name, mu, cov, x)
    assert w.sum() == pytest.approx(1, abs=1e-6) and (w >= -1e-9).all()
    best = min(map(f, simplex(3, 50)))
    assert f(w) <= best + 1e-3 * max(1.0, abs(best))


def test_smallest_spread_is_inverse_to_variance_without_correlation():
    mu, cov = np.ones(3), np.diag([1.0, 2.0, 4.0])
    w = numerics.best_weights("sharpe", mu, cov, series())
    assert w == pytest.approx(np.array([4, 2, 1]) / 7, abs=2e-3)


@pytest.mark.parametrize("cap", [1.0, 0.5, 1 / 3])
def test_the_sharpe_program_is_as_good_as_a_fine_grid(cap):
    x = series(k=3, seed=7)
    mu, cov = x.mean(0) * 252, np.cov(x, rowvar=False) * 252
    w, f = numerics.sharpe_program(mu, cov, cap), numerics.objective("sharpe", mu, cov, x)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= cap + 1e-7
    assert f(w) <= min(f(g) for g in simplex(3, 60) if g.max() <= cap + 1e-9) + 1e-9
    assert f(w) <= f(numerics.best_weights("sharpe", mu, cov, x, cap)) + 1e-6


def test_the_sharpe_program_without_binding_limits_has_a_closed_form():
    made = np.random.default_rng(8)
    a = made.normal(size=(20, 20))
    cov = a @ a.T / 20 + np.eye(20)
    w = made.random(20) + 0.5
    assert numerics.sharpe_program(cov @ w, cov) == pytest.approx(w / w.sum(), abs=1e-7)
    assert numerics.sharpe_program(-np.ones(4), np.eye(4)) == pytest.approx(np.full(4, 0.25))


def test_bounds_and_sums():
    x = series()
    w = numerics.best_weights("sharpe", x.mean(0), np.cov(x, rowvar=False), x, max_weight=0.4)
    assert w.max() <= 0.4 + 1e-6 and w.sum() == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        numerics.best_weights("sharpe", x.mean(0), np.cov(x, rowvar=False), x, total=5.0)
    with pytest.warns(UserWarning, match="unknown objective"):
        numerics.objective("nonsense", x.mean(0), np.cov(x, rowvar=False), x)


def test_forest_isolates_the_outlier():
    x = np.append(np.random.default_rng(3).normal(0, 1, 200), 15.0)[:, None]
    assert numerics.isolation_scores(x).argmin() == 200


def test_filter_follows_a_line_and_not_a_jump():
    line = 0.5 * np.arange(60)
    assert np.abs(numerics.kalman_residuals(line)[20:]).max() < 0.05
    jump = np.random.default_rng(4).normal(0, 0.01, 80)
    jump[50] += 1
    assert np.abs(numerics.kalman_residuals(jump)).argmax() == 50


def test_cointegration_solves_the_eigenproblem():
    made = np.random.default_rng(5)
    a = made.normal(size=(3, 200))
    b = made.normal(size=(3, 200)) + 0.5 * a
    s00, s01, s11 = a @ a.T / 200, a @ b.T / 200, b @ b.T / 200
    values, v = numerics.cointegration(s00, s01, s11)
    whole = np.linalg.inv(s11) @ s01.T @ np.linalg.inv(s00) @ s01
    assert sorted(values) == pytest.approx(sorted(np.linalg.eigvals(whole).real), rel=1e-6)
    assert whole @ v == pytest.approx(values[0] * v, rel=1e-5, abs=1e-8) and np.abs(v).sum() == pytest.approx(1)


def test_two_series_that_move_together_are_cointegrated(spark):
    from tessera.plans import portfolio

    made = np.random.default_rng(6)
    common, days = np.cumsum(made.normal(0, 0.02, 400)), [np.datetime64("2020-01-01") + i for i in range(400)]
    rows = [(t, d.astype(object), float(np.exp(5 + scale * c + made.normal(0, 0.005)))) for t, scale in (("A", 1.0), ("B", 2.0)) for d, c in zip(days, common)]
    got = {r["ticker"]: r["v"] for r in portfolio.johansen(spark.createDataFrame(rows, "ticker string, date date, adj_close double")).collect()}
    assert got["A"] == pytest.approx(2 / 3, abs=0.02) and got["B"] == pytest.approx(-1 / 3, abs=0.02)
