"""Spectral clusters of more tickers than dates: by series, without a table of pairs, and with few passes for the draws of k-means."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import kmeans, linalg, panel, spectral
from tessera.plans import portfolio


def returns_of(spark, n, days, seed=3):
    """n tickers on some days, of which a tenth are copies."""
    made = np.random.default_rng(seed)
    x = made.normal(0, 0.01, (n, days)) + made.normal(0.001, 0.02, (n // 10, days))[np.arange(n) % (n // 10)]
    x[: n // 10] = x[-(n // 10) :]
    rows = [(f"T{j:03d}", dt.date(2020, 1, 1) + dt.timedelta(i), float(x[j, i])) for j in range(n) for i in range(days)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double")


def normalised(spark, returns, n):
    """The normalised affinity as numpy has it, by pairs."""
    corr = linalg.as_correlation(linalg.shrunk(returns).select("a", "b", "value")).where("a < b")
    m = np.zeros((n, n))
    for r in spectral.normalised(corr.select("a", "b", linalg.affinity(corr["value"]).alias("value"))).collect():
        i, j = int(r["a"][1:]), int(r["b"][1:])
        m[i, j] = m[j, i] = r["value"]
    return m


@pytest.mark.parametrize("k", [12, 40])  # fewer and more than the dates
def test_leading_space_by_series_is_that_of_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(panel, "BLOCKS", 5)
    returns = returns_of(spark, 120, 25)
    made = panel.of(returns)
    rows = spectral.affinity_rows(panel.units(made, panel.shrunk(made)), made.n)
    want, axes = np.linalg.eigh(normalised(spark, returns, made.n))
    at = np.array([-1.5, -0.9, 0.0, 3.0])
    assert spectral.counts(rows, at).tolist() == [(made.n * want > s).sum() for s in at]
    found, values = spectral.leading_of_rows(rows, made.n, k)
    x = np.concatenate([b.x for b in sorted(found.collect(), key=lambda b: b.number)])
    assert values == pytest.approx(made.n * want[::-1][:k], abs=1e-7)
    assert x @ x.T == pytest.approx(axes[:, -k:] @ axes[:, -k:].T, abs=1e-5)


def test_equal_eigenvalues_at_the_end_of_the_wanted_ones(spark):
    x = np.zeros((60, 3))
    x[:20] = np.random.default_rng(1).normal(0, 0.4, (20, 3))  # and forty series without a move, whose eigenvalues are equal
    block = panel.Block(0, np.arange(60), [f"T{i}" for i in range(60)], None, None, x)
    rows = spectral.affinity_rows(spark.sparkContext.parallelize([block], 1), 60)
    (b,) = rows.collect()
    m = b.x @ b.x.T - np.diag(b.core)
    (found,), values = (lambda f: (f[0].collect(), f[1]))(spectral.leading_of_rows(rows, 60, 10))
    assert values == pytest.approx(np.linalg.eigvalsh(m)[::-1][:10], abs=1e-9)
    assert m @ found.x == pytest.approx(found.x * values, abs=1e-6)


def test_clusters_need_no_pairs(spark, monkeypatch):
    returns = returns_of(spark, 120, 25)
    want = {(r["ticker"], r["cluster"]) for r in wide(monkeypatch, returns, False)}
    monkeypatch.setattr(linalg, "products", None)
    assert {(r["ticker"], r["cluster"]) for r in wide(monkeypatch, returns, True)} == want


def wide(monkeypatch, returns, whether):
    monkeypatch.setattr(portfolio, "is_wide", lambda rows: whether)
    return portfolio.clusters(returns, "spectral").collect()


def test_draws_of_few_passes_are_those_of_one_each(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 6))
    x[200:] = x[:100]
    rdd = spark.sparkContext.parallelize([kmeans.Block([f"T{j}" for j in range(i, 300, 3)], x[i::3]) for i in range(3)], 3)
    passes, reduced = [], kmeans.reduced
    monkeypatch.setattr(kmeans, "reduced", lambda *given: passes.append(1) or reduced(*given))
    got = kmeans.seeds(rdd, 60, 2, 42)
    assert len(passes) < 30
    monkeypatch.setattr(kmeans, "AHEAD", 1)
    want = kmeans.seeds(rdd, 60, 2, 42)
    assert len(passes) > 60 and all((a == b).all() for a, b in zip(got, want))
    assert len(np.unique(got[0], axis=0)) == 60


def test_draws_beyond_the_different_vectors(spark):
    rdd = spark.sparkContext.parallelize([kmeans.Block([f"T{i}{j}" for j in range(8)], np.ones((8, 2)) * i) for i in range(3)], 3)
    (got,) = kmeans.seeds(rdd, 9, 1, 42)
    assert len(got) == 9 and len(np.unique(got, axis=0)) == 3
