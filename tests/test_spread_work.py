"""Work that is spread over tasks, or done once for all cells of a study."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import signals
from tessera.plans import catalogue


def test_drawing_is_spread_however_small_the_file(spark, tmp_path):
    spark.range(5000).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    days = [(i, "1-URGENT", dt.datetime(2000, 1, 3) + dt.timedelta(days=i), 10.0) for i in range(5)]
    spark.createDataFrame(days, "o_orderkey long, o_orderpriority string, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    drawn = catalogue.QUERIES["synthetic_returns"](spark, str(tmp_path))
    assert drawn.rdd.getNumPartitions() >= 8 and drawn.count() == 25000


def test_blends_add_up_tickers_once_for_all_cells(spark):
    made = np.random.default_rng(3)
    names, days = [f"T{i}" for i in range(6)], [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    x = made.normal(0.001, 0.02, (40, 6))
    returns = spark.createDataFrame([(t, d, float(x[i, j]) if (i + j) % 7 else None) for j, t in enumerate(names) for i, d in enumerate(days)], "ticker string, date date, ret double")
    k, v = made.dirichlet(np.ones(6)), made.dirichlet(np.ones(6))
    side = lambda w: spark.createDataFrame([(t, float(a)) for t, a in zip(names, w)], "ticker string, weight double")
    grid = signals.blend_grid(side(k), side(v), returns, 3)
    got = {(round(r["a"] * 3), round(r["b"] * 3)): r["score"] for r in grid.collect()}
    known = np.array([[x[i, j] if (i + j) % 7 else 0.0 for j in range(6)] for i in range(40)])
    want = {}
    for a in range(1, 4):
        for b in range(1, 4):
            r = known @ ((a * k + b * v) / (a + b))
            want[a, b] = 0.5 * (r.mean() / (r.std(ddof=1) * np.sqrt(252)) + r.mean() / (np.maximum(-r, 0)[r < 0] ** 3).mean() ** (1 / 3))
    assert got == pytest.approx(want, rel=1e-9)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LocalRelation" if "LocalRelation" in plan else "LogicalRDD")
    joins = plan[plan.rindex("Generate") :]
    assert "Join Inner, (ticker" in joins  # the tickers' join is under the cells, not over them
