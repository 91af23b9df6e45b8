"""Weights with the greatest Omega ratio, as a linear-fractional program.

With y the weights scaled to a mean excess return of 1, the ratio is greatest where the sum of shortfalls q is least:
minimise sum(q) with q >= -(r - target) y and q >= 0 for each date, the mean excess of y 1, and 0 <= y <= max_weight * sum(y).
An interior point method solves it: dates stay on the executors with their own shortfall, slack and multiplier, and each
step brings sums over them, a square of the tickers and two vectors, to the driver. The dual variables give a bound,
so the gap to the optimum is known.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.functions.staging import staged
from tessera.operators.graph import numbered

#: Tickers at most: their square goes to the driver. Steps at most, and the gap at which they end.
MAX_TICKERS, STEPS, GAP = 2000, 100, 1e-9
#: Rows of a block, how much closer to complementarity a step aims, and the share of the way to the border that it goes.
ROWS, CENTRE, REACH = 4096, 0.15, 0.995


class Dates(NamedTuple):
    """Excess returns of some dates (a row each), shortfalls q, slacks s of q + a y, and multipliers u between 0 and 1."""

    a: np.ndarray
    q: np.ndarray
    s: np.ndarray
    u: np.ndarray


def moves(d: Dates, dy: np.ndarray, aim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's changes of q, s and u for a change of y."""
    h, g = curvature(d, aim)
    by = d.a @ dy
    du = g - h * by
    dq = (aim - (1 - d.u) * d.q + d.q * du) / (1 - d.u)
    return dq, dq + by, du


def curvature(d: Dates, aim: float) -> tuple[np.ndarray, np.ndarray]:
    """What a date's u loses by a unit of its a dy, and gains without."""
    v = 1 - d.u
    below = d.s + d.u * d.q / v
    return d.u / below, (aim - d.u * d.s - d.u * (aim - v * d.q) / v) / below


def limit(x: np.ndarray, dx: np.ndarray) -> float:
    """The longest step up to 1 that keeps x positive, less a little."""
    falling = dx < 0
    return min(1.0, REACH * float((-x[falling] / dx[falling]).min())) if falling.any() else 1.0


def blocks(returns: DataFrame, target: float) -> tuple[list[str], RDD]:
    """Sorted tickers, and the excess returns over target of each date as rows; missing ones are 0 returns."""
    known = returns.where("ret is not null")
    tickers = staged(numbered(known.select("ticker").distinct(), "ticker", "i"))
    names = [r["ticker"] for r in tickers.orderBy("i").limit(MAX_TICKERS + 1).collect()]
    if len(names) > MAX_TICKERS:
        raise ValueError(f"more than {MAX_TICKERS} tickers")
    n = len(names)
    entries = F.map_from_entries(F.collect_list(F.struct("i", "ret")))
    rows = known.join(F.broadcast(tickers), "ticker").groupBy("date").agg(entries.alias("m"))  # MAX_TICKERS at most
    wide = rows.select(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)) - target).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_pydict({"b": [pickle.dumps(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, n))]})

    ship(returns.sparkSession)
    return names, wide.mapInArrow(pack, "b binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def added(rdd: RDD, of, merge=lambda x, y: tuple(a + b for a, b in zip(x, y))):
    both = lambda x, y: y if x is None else x if y is None else merge(x, y)
    return rdd.treeAggregate(None, lambda acc, block: both(acc, of(block)), both)


def solve(rdd: RDD, n: int, max_weight: float = 1.0) -> tuple[np.ndarray, float, float] | None:
    """(weights, Omega ratio, gap of the sum of shortfalls) for blocks of excess returns; None where no ticker has a positive mean."""
    sums, days = added(rdd, lambda a: (a.sum(0), len(a)))
    m = sums / days
    if not m.max() > 0 or not n * max_weight >= 1:
        return None
    b = max_weight * np.ones((n, n)) - np.eye(n)
    y = np.ones(n) / n + (0.5 / n) * (m > 0) * min(1.0, 0.5 * (n * max_weight - 1))
    y = y / abs(m @ y) if abs(m @ y) > 1e-9 * np.abs(m).max() else y / np.abs(m).max()
    if n * max_weight <= 1 + 1e-9:
        w = np.ones(n) / n
        up, down = added(rdd, lambda a: (np.maximum(a @ w, 0).sum(), np.maximum(-a @ w, 0).sum()))
        return w, float(up / max(down, 1e-300)), 0.0

    def begin(a: np.ndarray) -> Dates:
        x = a @ y
        q = np.maximum(0, -x) + np.abs(x).mean() + 1e-6
        return Dates(a, q, q + x, np.full(len(a), 0.5))

    state = rdd.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    s4, lam = b @ y, 0.0
    total = added(state, lambda d: (d.q.sum(), (d.u * d.s).sum() + ((1 - d.u) * d.q).sum()))
    mean = float(total[1] / (2 * days))
    p, w = mean / y, mean / s4
    for _ in range(STEPS):
        held = added(state, lambda d: (d.q.sum(), d.a.T @ d.u, (d.u * d.s).sum() + ((1 - d.u) * d.q).sum()))
        worst, off = held[0], held[1] + p + b @ w + lam * m
        aim = CENTRE * float(held[2] + p @ y + w @ s4) / (2 * days + 2 * n)
        gap = float(worst - lam)
        if abs(gap) <= GAP * max(1.0, worst) and np.abs(off).max() <= GAP * max(1.0, np.abs(held[1]).max()) and abs(m @ y - 1) <= GAP:
            break

        def newton(d: Dates, aim: float = aim) -> tuple[np.ndarray, np.ndarray]:
            h, g = curvature(d, aim)
            return (d.a * h[:, None]).T @ d.a, d.a.T @ g

        square, pull = added(state, newton)
        left = np.zeros((n + 1, n + 1))
        left[:n, :n] = -(square + np.diag(p / y) + b @ np.diag(w / s4) @ b)
        left[:n, n] = left[n, :n] = m
        right = np.append(-off - pull - (aim - p * y) / y - b @ ((aim - w * s4) / s4), 1 - m @ y)
        step = np.linalg.lstsq(left, right, rcond=None)[0] if np.linalg.cond(left) > 1e15 else np.linalg.solve(left, right)
        dy, dlam = step[:n], float(step[n])
        dp, ds4 = (aim - p * y - p * dy) / y, b @ dy
        dw = (aim - w * s4 - w * ds4) / s4

        def reach(d: Dates, dy: np.ndarray = dy, aim: float = aim) -> tuple[float, float]:
            dq, ds, du = moves(d, dy, aim)
            return min(limit(d.q, dq), limit(d.s, ds)), min(limit(d.u, du), limit(1 - d.u, -du))

        primal, dual = added(state, reach, lambda x, z: (min(x[0], z[0]), min(x[1], z[1])))
        primal, dual = min(primal, limit(y, dy), limit(s4, ds4)), min(dual, limit(p, dp), limit(w, dw))

        def go(d: Dates, dy: np.ndarray = dy, aim: float = aim, primal: float = primal, dual: float = dual) -> Dates:
            dq, ds, du = moves(d, dy, aim)
            return Dates(d.a, d.q + primal * dq, d.s + primal * ds, d.u + dual * du)

        y, s4, p, w, lam = y + primal * dy, s4 + primal * ds4, p + dual * dp, w + dual * dw, lam + dual * dlam
        state, old = state.map(go).persist(StorageLevel.MEMORY_AND_DISK), state
        state.count()
        old.unpersist()
    state.unpersist()
    weights = np.maximum(y, 0) / np.maximum(y, 0).sum()
    up, down = added(rdd, lambda a: (np.maximum(a @ weights, 0).sum(), np.maximum(-a @ weights, 0).sum()))
    return weights, float(up / max(down, 1e-300)), gap / max(1.0, float(worst))


def best_weights(returns: DataFrame, max_weight: float = 1.0, target: float = 0.0) -> DataFrame:
    """ticker, weight, omega (the ratio of the whole) and gap (relative, to the optimum); equal weights and no gap where no ticker's mean is over target."""
    names, rdd = blocks(returns, target)
    spark = returns.sparkSession
    schema = "ticker string, weight double, omega double, gap double"
    if not names:
        return spark.createDataFrame([], schema)
    n = len(names)
    found = solve(rdd, n, max(max_weight, 1 / n))
    rdd.unpersist()
    weights, ratio, gap = found if found else (np.full(n, 1 / n), None, None)
    return spark.createDataFrame([(t, float(v), ratio, gap) for t, v in zip(names, weights)], schema)
