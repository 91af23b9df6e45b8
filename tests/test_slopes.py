"""Gradients of the objectives."""

import numpy as np
import pytest

from tessera.functions import numerics
from tessera.operators.metrics import OBJECTIVES


@pytest.mark.parametrize("name", OBJECTIVES)
@pytest.mark.parametrize("scale", [0.02, 0.4])
def test_slopes_are_those_of_differences(name, scale):
    made = np.random.default_rng(9)
    x = made.normal(0.002, scale, (150, 6))
    mu, cov = x.mean(0) * 252, np.cov(x, rowvar=False) * 252
    f, rise = numerics.objective(name, mu, cov, x), numerics.slope(name, mu, cov, x)
    for w in (np.full(6, 1 / 6), made.dirichlet(np.ones(6)), made.normal(0, 0.5, 6)):
        want = np.array([(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)])
        assert rise(w) == pytest.approx(want, rel=1e-4, abs=1e-5 * np.abs(want).max())


@pytest.mark.parametrize("name", OBJECTIVES)
def test_weights_of_many_assets_don_t_take_an_evaluation_for_each(name, monkeypatch):
    made, calls, whole = np.random.default_rng(10), [], numerics.objective
    x = made.normal(0.001, 0.02, (60, 200))

    def counted(*given):
        f = whole(*given)
        return lambda w: calls.append(1) or f(w)

    monkeypatch.setattr(numerics, "objective", counted)
    numerics.best_weights(name, x.mean(0) * 252, np.cov(x, rowvar=False) * 252 + 0.01 * np.eye(200), x, steps=20)
    assert len(calls) <= 2 * (1 + 20 * 25)
