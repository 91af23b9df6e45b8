"""Trees of reachability for the density study: those of scales up to 1 are one, and none is made twice."""

import numpy as np
import pytest

from tessera.operators import graph, panel
from tessera.plans import portfolio
from tests.test_panel import returns, shrunk_pairs, small  # noqa: F401


def test_few_trees_serve_all_scales(spark, returns, small, shrunk_pairs, monkeypatch):  # noqa: F811
    asked, lengths, study = [], panel.merged_forest, {}

    def counted(spark, made, blocks, reach):
        asked.append(sum(1 for _ in reach(np.zeros((1, 1)), panel.Block(0, None, None, None, None, None, np.zeros(1)), panel.Block(0, None, None, None, None, None, np.zeros(1)))))
        return lengths(spark, made, blocks, reach)

    monkeypatch.setattr(panel, "merged_forest", counted)
    monkeypatch.setattr(portfolio, "density_search", lambda tickers, trees, means, axes, nearby: study.update(trees=trees))
    made = panel.of(returns)
    portfolio.density_of_series(spark, made, panel.units(made, panel.shrunk(made)), None)
    of = lambda rows: {(r["g"], r["a"], r["b"]): r["value"] for r in rows.collect()}
    for scales in ([0.1, 0.5, 1.0, 1.5, 2.0], [0.4, 0.6, 1.4, 1.5]):
        got = of(study["trees"](scales))
        want = of(graph.spanning_tree(graph.reachability(shrunk_pairs.selectExpr("a", "b", "(1 - value) / 2 AS value"), 2, scales)))
        assert got == pytest.approx(want) and len(got) == 89 * len(scales)
    assert asked == [3, 1]


def test_nearest_of_all_others(spark):
    x = np.random.default_rng(2).normal(0, 0.1, (50, 9))
    blocks = [panel.Block(k, np.arange(10 * k, 10 * k + 10), None, None, None, x[10 * k : 10 * k + 10]) for k in range(5)]
    found = panel.with_nearest(spark.sparkContext.parallelize(blocks, 5), lambda c: (1 - c) / 2)
    far = (1 - x @ x.T) / 2
    np.fill_diagonal(far, np.inf)
    assert np.concatenate([b.core for b in sorted(found.collect(), key=lambda b: b.number)]) == pytest.approx(far.min(1))
