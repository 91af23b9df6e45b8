"""Studies against plain loops: whole grids, halving, and points between the grid's."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signals, study

STEPS = 4


@pytest.fixture(scope="module")
def rows(spark):
    """Mean-reverting series, a flat one that never trades, one that ends early, and one of a single row."""
    rng, found = np.random.default_rng(3), []
    for t in range(6):
        x = 0.0
        for i in range(240 if t != 4 else 60):
            x = 0.8 * x + rng.normal(0, 0.05) if t else 0.0
            price = math.exp(x + rng.normal(0, 0.08))  # trades may lose
            found.append((f"t{t}", dt.date(2020, 1, 1) + dt.timedelta(i), price, x))
    found.append(("single", dt.date(2020, 1, 1), 1.0, 0.0))
    df = spark.createDataFrame(found, "ticker string, date date, price double, dev double")
    sigma = df.groupBy("ticker").agg(F.coalesce(F.stddev_samp("dev"), F.lit(0.0)).alias("sigma"))
    return spark.createDataFrame(df.join(sigma, "ticker").toPandas())


def plain_score(series, stop, take):
    """(score, trades) of one ticker's rows (date, price, dev, sigma), or None without a trade."""
    trades, entry = [], None
    for k, (_, price, dev, sigma) in enumerate(series):
        if entry is not None and dev > take * sigma:
            trades.append(math.log(price / entry))
            entry = None
        if entry is None and dev < stop * sigma and any(d > take * s for _, _, d, s in series[k + 1 :]):
            entry = price
    if not trades:
        return None
    x = np.array(trades)
    sd = x.std(ddof=1) if len(x) > 1 else math.nan
    fall = -x[x < 0]
    sharpe = x.mean() / (sd * math.sqrt(252)) if sd and sd > 0 else math.nan
    kappa = x.mean() / np.mean(fall**3) ** (1 / 3) if len(fall) else math.nan
    score = sharpe * (x > 0).mean() * math.log(len(x) + 1) * kappa
    return (0.0 if math.isnan(score) else score), len(x)


def grid():
    ends = [2 * k / STEPS for k in range(STEPS + 1)]
    return [(-a, b) for a in ends for b in ends]


def by_ticker(rows):
    found = {}
    for r in rows.orderBy("ticker", "date").collect():
        found.setdefault(r["ticker"], []).append((r["date"], r["price"], r["dev"], r["sigma"]))
    return found


def order(series):
    def key(cell):
        got = plain_score(series, *cell)
        return (math.inf if got is None else -round(got[0], study.DECIMALS), -cell[0], cell[1])

    return key


def found(df):
    return {r["ticker"]: r for r in df.collect()}


def search(rows, score=signals.bound_scores, **more):
    prefer = [-F.col("stop"), F.col("take")]
    return study.search(rows, ["ticker"], signals.bound_cells(STEPS), signals.bound_axes(STEPS), score, prefer, **more)


def test_the_grid_is_whole_without_halving(rows):
    got = found(search(rows))
    series = by_ticker(rows)
    assert set(got) == {t for t, s in series.items() if any(plain_score(s, *c) for c in grid())}
    for t, r in got.items():
        want = min(grid(), key=order(series[t]))
        score, trades = plain_score(series[t], *want)
        assert (r["stop"], r["take"], r["trades"]) == (want[0], want[1], trades) and r["score"] == pytest.approx(score, rel=1e-9)


def test_points_between_are_never_worse_and_those_of_a_plain_loop(rows):
    coarse, fine, series = found(search(rows)), found(search(rows, rounds=2)), by_ticker(rows)
    assert set(coarse) == set(fine)
    better = 0
    for t, r in fine.items():
        best = (coarse[t]["stop"], coarse[t]["take"])
        for k in (1, 2):
            d = 2 / STEPS / 2**k
            near = {(max(-2.0, min(0.0, best[0] + i * d)), max(0.0, min(2.0, best[1] + j * d))) for i in (-1, 0, 1) for j in (-1, 0, 1)}
            best = min({best} | near, key=order(series[t]))
        assert (r["stop"], r["take"]) == pytest.approx(best) and r["score"] >= coarse[t]["score"] - 1e-9
        better += r["score"] > coarse[t]["score"] + 1e-9
    assert better


def test_halving_scores_fewer_cells_and_keeps_those_of_a_plain_loop(rows):
    """Cells by row: each round's live cells times the rows up to its share of the time."""
    work = Counter()

    def counted(part):
        work["rounds"] += 1
        work["cells"] += part.agg(F.sum(F.size("cells"))).first()[0] or 0
        return signals.bound_scores(part)

    shares, keep = (1 / 9, 1 / 3, 1.0), 1 / 3
    got, whole = found(search(rows, counted, shares=shares, keep=keep)), found(search(rows))
    assert work["rounds"] == 3 and work["cells"] < rows.count() * len(grid()) / 2
    series = by_ticker(rows)
    first, last = min(s[0][0] for s in series.values()), max(s[-1][0] for s in series.values())
    for t, s in series.items():
        live = grid()
        for share in shares[:-1]:
            part = [x for x in s if x[0] <= first + (last - first) * share]
            live = sorted(live, key=order(part))[: max(1, math.ceil(len(live) * keep))]
        best = min(live, key=order(s))
        if plain_score(s, *best) is None:
            assert t not in got
        else:
            assert (got[t]["stop"], got[t]["take"]) == best and got[t]["score"] <= whole[t]["score"] + 1e-9


def test_empty_tables_and_wrong_shares(rows):
    assert search(rows.where("false")).count() == 0
    assert search(rows.where("false"), shares=(0.5, 1.0), rounds=1).count() == 0
    for bad in ({"shares": (0.5,)}, {"shares": (1.0, 0.5, 1.0)}, {"shares": ()}, {"keep": 0.0}, {"rounds": -1}):
        with pytest.raises(ValueError):
            search(rows, **bad)


def test_bounds_of_a_basket(spark, rows):
    """One series as a basket: the study's best is the first row of its grid, and points between are no worse."""
    line = rows.where("ticker = 't1'").select("date", (F.col("dev") + 10).alias("spread"))
    tried = signals.basket_grid(line, STEPS).where("trades > 0 and sharpe is not null and not isnan(sharpe)")
    want = tried.orderBy(F.desc("sharpe"), F.desc("stop"), "take").first()
    got = signals.basket_bounds(line, STEPS).first()
    assert (got["stop"], got["take"], got["trades"]) == (want["stop"], want["take"], want["trades"])
    assert signals.basket_bounds(line, STEPS, rounds=1).first()["sharpe"] >= want["sharpe"] - 1e-9
