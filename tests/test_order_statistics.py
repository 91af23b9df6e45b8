"""The sorted window against a sort of every frame."""

import time

import numpy as np
import pytest

from tessera.operators import order_statistics


def plain(values, n, scale):
    out = []
    for i, x in enumerate(values):
        frame = values[max(0, i - n + 1) : i + 1]
        z = None
        if None not in frame:
            m = np.median(frame)
            mad = np.median(np.abs(np.array(frame) - m)) / scale
            z = (x - m) / mad if mad else None
        out.append(z)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 8, 21])
def test_scores_of_frames_with_ties_and_gaps(n):
    made = np.random.default_rng(n)
    values = [None if made.random() < 0.03 else float(np.round(made.normal(), 1)) for _ in range(400)]
    got, want = order_statistics.scores(values, n, 1.4826), plain(values, n, 1.4826)
    assert [z is None for z in got] == [z is None for z in want]
    assert [z for z in got if z is not None] == pytest.approx([z for z in want if z is not None])


def test_slices_reach_back(spark, monkeypatch):
    monkeypatch.setattr(order_statistics, "SLICE", 10)
    made = np.random.default_rng(0)
    series = {t: [float(x) for x in made.normal(size=k)] for t, k in (("a", 1), ("b", 39), ("c", 40), ("d", 200))}
    series["d"][77] = None
    rows = [(t, i, x, 0.0) for t, xs in series.items() for i, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "ticker string, date int, ret double, z double").repartition(5)
    for n in (1, 5):
        got = {t: [] for t in series}
        for r in order_statistics.robust_zscore(table, "ret", n).orderBy("ticker", "date").collect():
            got[r["ticker"]].append(r["z"])
        for t, xs in series.items():
            want = plain(xs, n, 1.4826)
            assert [z is None for z in got[t]] == [z is None for z in want] and [z for z in got[t] if z is not None] == pytest.approx([z for z in want if z is not None])


def test_time_hardly_depends_on_the_window():
    values = [float(x) for x in np.random.default_rng(0).normal(size=20_000)]
    took = []
    for n in (20, 2000):
        began = time.process_time()
        order_statistics.scores(values, n, 1.4826)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0]
