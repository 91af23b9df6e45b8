"""The programs split by tickers against those with a square of the tickers."""

import numpy as np
import pytest

from tessera.operators import linalg, omega, panel, ratios
from tessera.plans import portfolio
from tests.test_omega import ratio, series, table


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(panel, "BLOCKS", 3)


@pytest.fixture(scope="module")
def wide():
    """More tickers than dates, with a market that no weights can avoid."""
    market = np.random.default_rng(7).normal(0, 0.03, (40, 1))
    return 0.3 * series(40, 70, 6) + 0.002 + market - market.mean()


def test_omega_is_that_of_the_square(spark, wide):
    got = ratios.best_omega(table(spark, wide), 0.2).orderBy("ticker").collect()
    want = omega.best_weights(table(spark, wide), 0.2).orderBy("ticker").collect()
    w, other = (np.array([r["weight"] for r in x]) for x in (got, want))
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.2 + 1e-7 and got[0]["gap"] < 1e-7
    assert ratio(wide, w) == pytest.approx(got[0]["omega"]) == pytest.approx(ratio(wide, other), rel=1e-6)


def test_sharpe_is_that_of_the_square(spark, wide, monkeypatch):
    of = lambda: {r["ticker"]: r["weight"] for r in portfolio.sharpe_program(table(spark, wide), "sharpe", 0.2, floor=1e-4).collect()}
    with monkeypatch.context() as m:
        m.setattr(linalg, "products", None)
        got = of()
    monkeypatch.setattr(portfolio, "is_wide", lambda rows: False)
    assert got == pytest.approx(of(), abs=1e-6)


def test_more_tickers_than_the_square_takes(spark, wide, monkeypatch):
    monkeypatch.setattr(omega, "MAX_TICKERS", 60)
    assert portfolio.best_omega(table(spark, wide), 0.2).count() == 70
    assert portfolio.sharpe_program(table(spark, wide), "sharpe", 0.2).count() >= 5
    assert portfolio.best_omega(table(spark, -np.abs(wide))).first()["weight"] == pytest.approx(1 / 70)
