"""K-means of more tickers than a sketch has components, and of more dates than tickers, by whole rows of distances."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import kmeans, linalg, panel, series_kmeans
from tessera.plans import portfolio


def returns_of(spark, n, days, seed=3):
    made = np.random.default_rng(seed)
    x = made.normal(0, 0.01, (n, days)) + made.normal(0.001, 0.02, (6, days))[np.arange(n) % 6]
    rows = [(f"T{j:04d}", dt.date(2020, 1, 1) + dt.timedelta(i), float(x[j, i])) for j in range(n) for i in range(days)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double")


def vectors(spark, returns):
    made = panel.of(returns)
    x = np.concatenate([b.x for b in sorted(panel.units(made, panel.shrunk(made)).collect(), key=lambda b: b.number)])
    d = np.sqrt((1 - np.clip(x @ x.T, -1, 1)) / 2)
    np.fill_diagonal(d, 0.0)
    names = [r["ticker"] for r in made.names.orderBy("i").collect()]
    return spark.createDataFrame([(t, row.tolist()) for t, row in zip(names, d)], "ticker string, x array<double>")


def labels(rows):
    return {r["ticker"]: r["cluster"] for r in rows.collect()}


@pytest.mark.parametrize("n, days", [(90, 30), (60, 80)])
def test_clusters_are_those_of_whole_rows(spark, monkeypatch, n, days):
    monkeypatch.setattr(panel, "BLOCKS", 5)
    returns = returns_of(spark, n, days)
    want = labels(kmeans.clusters(vectors(spark, returns), portfolio.KMEANS_SIZES))
    monkeypatch.setattr(linalg, "products", None)  # nor are there pairs
    assert labels(portfolio.clusters(returns, "kmeans")) == want and len(set(want.values())) > 1


def test_more_tickers_than_a_sketch_has_components(spark):
    returns = returns_of(spark, 1100, 12, 7)
    assert labels(portfolio.clusters(returns, "kmeans")) == labels(kmeans.clusters(vectors(spark, returns), portfolio.KMEANS_SIZES))


def test_nothing_is_sketched(spark, monkeypatch):
    monkeypatch.setattr(panel, "distance_rows", None)
    monkeypatch.setattr(kmeans, "distance_rows", None)
    returns = returns_of(spark, 80, 30)
    assert len(labels(portfolio.clusters(returns, "kmeans"))) == 80
    assert sum(r["weight"] for r in portfolio.nested_clustering(returns, "kappa", floor=0.0).collect()) == pytest.approx(1)


@pytest.mark.parametrize("objective", ["kappa", "sk_mix"])
def test_nested_weights_have_one_path(spark, monkeypatch, objective):
    returns = returns_of(spark, 30, 60)  # more dates than tickers
    monkeypatch.setattr(linalg, "products", None)
    assert sum(r["weight"] for r in portfolio.nested_clustering(returns, objective, floor=0.0).collect()) == pytest.approx(1)


def test_nested_weights_need_a_date_of_all(spark):
    rows = [(f"T{j}", dt.date(2020, 1, 1 + i), 0.01 * i * (j + 1)) for i in range(12) for j in range(6) if i % 6 != j]
    with pytest.raises(ValueError, match="date that all tickers have"):
        portfolio.nested_clustering(spark.createDataFrame(rows, "ticker string, date date, ret double"), "sharpe").collect()


@pytest.mark.parametrize("days", [20, 70])
def test_shrinkage_by_the_lesser_square(spark, monkeypatch, days):
    monkeypatch.setattr(panel, "BLOCKS", 4)
    returns = returns_of(spark, 40, days)
    assert panel.shrunk(panel.of(returns)).shrinkage == pytest.approx(linalg.shrunk(returns).first()["shrinkage"])


def test_starts_that_are_left_empty_stay(spark):
    block = panel.Block(0, np.arange(6), list("abcdef"), None, None, np.eye(6)[[0, 0, 0, 1, 1, 1]])
    rows = series_kmeans.Rows(spark.sparkContext.parallelize([block], 1), 6)
    ((cost, members),) = series_kmeans.lloyd(rows, [np.array([0, 0, 3])], 9)
    assert members.T.tolist() == [[True] * 3 + [False] * 3, [True] + [False] * 5, [False] * 3 + [True] * 3] and cost >= 0
