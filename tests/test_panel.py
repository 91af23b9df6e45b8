"""What is made of blocks of series against what the tables of pairs give."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.staging import staged
from tessera.operators import graph, kmeans, linalg, panel
from tessera.plans import portfolio


@pytest.fixture(scope="module")
def returns(spark):
    """90 tickers on 30 dates and one that most lack; some series are alike, some equal."""
    made = np.random.default_rng(4)
    base = made.normal(0.001, 0.02, (30, 9))
    x = base[:, np.arange(90) % 9] + made.normal(0, 0.01, (30, 90))
    x[:, 81:85] = x[:, 0:4]
    rows = [(f"T{j:03d}", dt.date(2020, 1, 1) + dt.timedelta(i), float(x[i, j])) for i in range(30) for j in range(90)]
    rows += [(f"T{j:03d}", dt.date(2020, 3, 1), 0.01) for j in range(10)]
    return staged(spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(3))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(panel, "BLOCKS", 5)  # of 18 tickers


@pytest.fixture(scope="module")
def shrunk_pairs(returns):
    return staged(linalg.as_correlation(linalg.shrunk(returns).select("a", "b", "value")).where("a < b"))


def test_shrinkage_is_that_of_pairs(returns, small):
    assert panel.shrunk(panel.of(returns)).shrinkage == pytest.approx(linalg.shrunk(returns).first()["shrinkage"])


@pytest.mark.parametrize("width", [1024, 16])
def test_rows_are_those_of_pairs(spark, returns, small, shrunk_pairs, width):
    made = panel.of(returns, width)
    got = panel.distance_rows(spark, panel.units(made, panel.shrunk(made)), made.n, width)
    want = kmeans.distance_rows(shrunk_pairs.withColumn("value", F.sqrt((1 - F.col("value")) / 2)), width)
    of = lambda rows: np.array([r["x"] for r in sorted(rows.collect(), key=lambda r: r["ticker"])])
    assert of(got) == pytest.approx(of(want), abs=1e-9)


def test_trees_of_blocks_hold_the_tree(spark, returns, small, shrunk_pairs):
    made = panel.of(returns)
    edges = staged(panel.forest(spark, panel.units(made, panel.shrunk(made)), lambda c, a, b: [("", 1 - c), ("r", np.round(1 - c, 1))]))
    tree = lambda rows: {(r["a"], r["b"]) for r in graph.spanning_tree(rows).collect()}
    pairs = shrunk_pairs.select(F.lit("").alias("g"), "a", "b", (1 - F.col("value")).alias("value"))
    assert edges.count() == 2 * (10 * 35 + 5 * 17) < pairs.count()
    assert tree(edges.where("g = ''")) == tree(pairs)
    assert tree(edges.where("g = 'r'")) == tree(pairs.withColumn("value", F.round("value", 1)))


@pytest.mark.parametrize("method", ["kmeans", "mst"])
def test_clusters_without_pairs_are_those_of_pairs(returns, small, monkeypatch, method):
    of = lambda: {tuple(r) for r in portfolio.clusters(returns, method).collect()}
    with monkeypatch.context() as m:
        m.setattr(linalg, "products", None)
        got = of()
    monkeypatch.setattr(portfolio, "is_wide", lambda rows: False)
    assert got == of() and len(got) == 90


@pytest.mark.parametrize("objective", ["kappa", "sharpe"])
def test_nested_weights_without_pairs_are_those_of_pairs(returns, small, monkeypatch, objective):
    of = lambda: {r["ticker"]: r["weight"] for r in portfolio.nested_clustering(returns, objective, floor=0.0).collect()}
    with monkeypatch.context() as m:
        m.setattr(linalg, "products", None)
        got = of()
    monkeypatch.setattr(portfolio, "is_wide", lambda rows: False)
    want = of()
    assert len(got) == 10 or len(got) == 90
    assert {t for t in got} == set(want) and [got[t] for t in sorted(got)] == pytest.approx([want[t] for t in sorted(got)], abs=2e-3)


def test_forest_of_edges_is_that_of_rounds(spark):
    made = np.random.default_rng(6)
    u, v = np.triu_indices(40, 1)
    value = np.round(made.random(len(u)), 1)
    kept = panel.forest_of(u, v, value)
    rows = spark.createDataFrame([("", f"t{a:02d}", f"t{b:02d}", float(x)) for a, b, x in zip(u, v, value)], "g string, a string, b string, value double")
    assert {(f"t{a:02d}", f"t{b:02d}") for a, b in zip(u[kept], v[kept])} == {(r["a"], r["b"]) for r in graph.spanning_tree(rows).collect()}


@pytest.mark.parametrize("sums", [1 << 24, 40])
def test_silhouettes_of_series_are_those_of_pairs(spark, returns, small, shrunk_pairs, monkeypatch, sums):
    monkeypatch.setattr(panel, "SUMS", sums)
    made = panel.of(returns)
    rows = [(c, f"T{j:03d}", f"T{j % k:03d}") for c, k in ((0, 9), (3, 4), (5, 1), (6, 45)) for j in range(90 - 20 * (c == 3))]
    labels = spark.createDataFrame(rows, "cell int, ticker string, cluster string")
    pairs = shrunk_pairs.withColumn("value", (1 - F.col("value")) / 2)
    of = lambda rows: {r["cell"]: r["s"] for r in rows.collect()}
    got = of(panel.mean_silhouettes(spark, made, panel.units(made, panel.shrunk(made)), lambda c: (1 - c) / 2, labels))
    assert got == pytest.approx(of(graph.mean_silhouettes(pairs, labels))) and len(got) == 4


@pytest.mark.parametrize("nearby", [None, portfolio.NEARBY])
def test_density_clusters_without_pairs_are_those_of_pairs(returns, small, monkeypatch, nearby):
    of = lambda: {tuple(r) for r in portfolio.clusters(returns, "hdbscan", nearby).collect()}
    with monkeypatch.context() as m:
        m.setattr(linalg, "products", None)
        got = of()
    monkeypatch.setattr(portfolio, "is_wide", lambda rows: False)
    assert got == of() and len(got) == 90 and len({c for _, c in got}) > 2
