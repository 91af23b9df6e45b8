"""The programs of the greatest Omega and Sharpe ratios where there are more tickers than dates.

They are those of omega.py and numerics.sharpe_program(), but what is split is the tickers: each block keeps its own weights,
slacks and multipliers on the executors. Newton's system is a diagonal plus products of the series, so a step brings a
square of the dates and a few vectors of that length to the driver, and nothing as long as the tickers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import panel
from tessera.operators.kmeans import reduced
from tessera.operators.omega import CENTRE, GAP, Dates, curvature, limit, moves

STEPS = 150


class Part(NamedTuple):
    """Some tickers: their names, series a (a column each), means m, scaled weights y, slacks s of the limit, and both multipliers."""

    names: list[str]
    a: np.ndarray
    m: np.ndarray
    y: np.ndarray
    s: np.ndarray
    p: np.ndarray
    w: np.ndarray


class Shortfalls:
    """The sum of shortfalls: its dates have states of their own."""

    ridge, joint = 0.0, False

    def __init__(self, ay: np.ndarray):
        q = np.maximum(0, -ay) + np.abs(ay).mean() + 1e-6
        self.d = Dates(np.zeros((len(ay), 1)), q, q + ay, np.full(len(ay), 0.5))

    def slack(self) -> tuple[float, int]:
        """The products of the dates' slacks and multipliers, and how many there are."""
        return float((self.d.u * self.d.s).sum() + ((1 - self.d.u) * self.d.q).sum()), 2 * len(self.d.q)

    def force(self, ay: np.ndarray) -> np.ndarray:
        return self.d.u

    def newton(self, ay: np.ndarray, aim: float) -> tuple[np.ndarray, np.ndarray]:
        h, g = curvature(self.d, aim)
        return h, self.d.u + g

    def moves(self, ady: np.ndarray, aim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return moves(self.d._replace(a=ady[:, None]), np.ones(1), aim)

    def reach(self, ady: np.ndarray, aim: float) -> tuple[float, float]:
        dq, ds, du = self.moves(ady, aim)
        return min(limit(self.d.q, dq), limit(self.d.s, ds)), min(limit(self.d.u, du), limit(1 - self.d.u, -du))

    def go(self, ady: np.ndarray, aim: float, primal: float, dual: float) -> None:
        dq, ds, du = self.moves(ady, aim)
        self.d = self.d._replace(q=self.d.q + primal * dq, s=self.d.s + primal * ds, u=self.d.u + dual * du)

    def gap(self, lam: float, slack: float) -> float:
        worst = float(self.d.q.sum())
        return abs(worst - lam) / max(1.0, worst)


class Variance:
    """y'Vy with V = scale * aa' + ridge."""

    joint = True

    def __init__(self, scale: float, ridge: float):
        self.scale, self.ridge = 2 * scale, 2 * ridge

    def slack(self) -> tuple[float, int]:
        return 0.0, 0

    def force(self, ay: np.ndarray) -> np.ndarray:
        return -self.scale * ay

    def newton(self, ay: np.ndarray, aim: float) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(ay), self.scale), -self.scale * ay

    def reach(self, ady: np.ndarray, aim: float) -> tuple[float, float]:
        return 1.0, 1.0

    def go(self, ady: np.ndarray, aim: float, primal: float, dual: float) -> None:
        pass

    def gap(self, lam: float, slack: float) -> float:
        return slack / max(lam, 1e-300)  # lam is twice the least variance at the end


def added(p: tuple, q: tuple) -> tuple:
    return tuple(a + b for a, b in zip(p, q))


def solve(parts: RDD, n: int, cap: float, begin) -> tuple[RDD, float, float]:
    """Parts with weights y (of any scale), their sum, and the gap. begin(a y) makes the goal, Shortfalls or Variance.

    Minimises the goal under m y = 1 and 0 <= y <= cap * sum(y).
    """
    state = parts.persist(StorageLevel.MEMORY_AND_DISK)
    old, lam, goal, gap = None, 0.0, None, np.inf
    for _ in range(STEPS):

        def sums(x: Part) -> tuple:
            return x.a @ x.y, np.array([x.p @ x.y + x.w @ x.s, x.m @ x.y, x.w.sum(), (1 / x.s).sum(), (x.w / x.s).sum(), x.y.sum()])

        ay, (slack, my, wsum, turn, v, total) = reduced(state, sums, added)
        if old is not None:
            old.unpersist()
        if goal is None:
            goal = begin(ay)
            if goal.slack()[1]:  # multipliers that agree with those of the dates
                mean = goal.slack()[0] / goal.slack()[1]
                old, state = state, state.map(lambda x, mean=mean: x._replace(p=mean / x.y, w=mean / x.s)).persist(StorageLevel.MEMORY_AND_DISK)
                ay, (slack, my, wsum, turn, v, total) = reduced(state, sums, added)
                old.unpersist()
        force, ridge = goal.force(ay), goal.ridge

        own, count = goal.slack()
        aim = CENTRE * (slack + own) / (count + 2 * n)
        h, f = goal.newton(ay, aim)

        def right(x: Part, f: np.ndarray = f, aim: float = aim, turn: float = turn, lam: float = lam) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r = x.a.T @ f - ridge * x.y + lam * x.m + aim / x.y + aim * (cap * turn - 1 / x.s)
            v = x.w / x.s
            return r, 1 / (x.p / x.y + v + ridge), np.vstack([x.a, np.ones(len(x.y)), v])

        def system(x: Part, force: np.ndarray = force, wsum: float = wsum, lam: float = lam) -> tuple:
            r, inverse, u = right(x)
            both = np.stack([r, x.m], 1) * inverse[:, None]
            pull = x.a.T @ force - ridge * x.y
            off = np.array([np.abs(pull + x.p + cap * wsum - x.w + lam * x.m).max(), np.abs(pull).max()])
            return (u * inverse) @ u.T, u @ both, np.stack([r, x.m]) @ both, off

        square, pulled, small, (off, size) = reduced(state, system, lambda p, q: (*added(p[:3], q[:3]), np.maximum(p[3], q[3])))
        gap = goal.gap(lam, slack + own)
        if gap <= GAP and off <= GAP * max(1.0, size) and abs(my - 1) <= GAP:
            break
        t = len(h)
        root = np.append(np.sqrt(h), [1.0, 1.0])
        left = root[:, None] * square * root
        left[:t, :t] += np.eye(t)
        left[t:, t:] += np.array([[0.0, -1 / cap], [-1 / cap, -v]])
        z = root[:, None] * np.linalg.solve(left, root[:, None] * pulled)  # of r and of m
        mr, mm = small[1, 0] - pulled[:, 1] @ z[:, 0], small[1, 1] - pulled[:, 1] @ z[:, 1]
        dlam = float((1 - my - mr) / mm)
        z = z[:, 0] + dlam * z[:, 1]

        def change(x: Part, z: np.ndarray = z, dlam: float = dlam) -> np.ndarray:
            r, inverse, u = right(x)
            return inverse * (r + dlam * x.m - z @ u)

        ady, dsum = reduced(state, lambda x: (x.a @ (dy := change(x)), dy.sum()), added)

        def rest(x: Part, dsum: float = dsum, aim: float = aim) -> tuple[np.ndarray, ...]:
            dy = change(x)
            ds = cap * dsum - dy
            return dy, ds, (aim - x.p * x.y - x.p * dy) / x.y, (aim - x.w * x.s - x.w * ds) / x.s

        def reach(x: Part) -> np.ndarray:
            dy, ds, dp, dw = rest(x)
            return np.array([min(limit(x.y, dy), limit(x.s, ds)), min(limit(x.p, dp), limit(x.w, dw))])

        primal, dual = np.minimum(reduced(state, reach, np.minimum), goal.reach(ady, aim))
        if goal.joint:
            primal = dual = min(primal, dual)

        def go(x: Part, primal: float = primal, dual: float = dual) -> Part:
            dy, ds, dp, dw = rest(x)
            return x._replace(y=x.y + primal * dy, s=x.s + primal * ds, p=x.p + dual * dp, w=x.w + dual * dw)

        goal.go(ady, aim, primal, dual)
        lam += dual * dlam
        old, state = state, state.map(go).persist(StorageLevel.MEMORY_AND_DISK)  # made, and the old one let go, by the next sums
    return state, float(total), float(gap)


def parts(made: panel.Panel, series, means, n: int, cap: float) -> RDD:
    """The blocks as Part's with equal weights; series and means of a block's rows."""

    def part(b: panel.Block) -> Part:
        y = np.full(len(b.names), 1 / n)
        s = np.full(len(b.names), cap - 1 / n)
        return Part(b.names, np.ascontiguousarray(series(b.x).T), means(b.x), y, s, 1 / y / n, 1 / s / n)

    return made.blocks.map(part)


def rows(spark: SparkSession, found: RDD, total: float, ratio: float | None = None, gap: float | None = None) -> DataFrame:
    def row(x: Part) -> pa.RecordBatch:
        k = len(x.names)
        return pa.RecordBatch.from_arrays([pa.array(x.names), pa.array(np.maximum(x.y, 0) / total), pa.array([ratio] * k, pa.float64()), pa.array([gap] * k, pa.float64())], names=["ticker", "weight", "omega", "gap"])

    return panel.table(spark, found.map(row), "ticker string, weight double, omega double, gap double")


def best_omega(returns: DataFrame, max_weight: float = 1.0, target: float = 0.0) -> DataFrame:
    """omega.best_weights() of more tickers than dates."""
    made, spark = panel.of(returns), returns.sparkSession
    n, cap = made.n, max(max_weight, 1 / made.n)
    excess = lambda x: np.nan_to_num(x) - target
    found = parts(made, excess, lambda x: excess(x).mean(1), n, cap)
    most = reduced(found, lambda x: x.m.max(), max)
    if not most > 0:
        return rows(spark, found, 1.0)
    if n * cap <= 1 + 1e-9:
        total, gap = 1.0, 0.0
    else:
        start = 1 / most  # weights whose mean is near 1
        found, total, gap = solve(found.map(lambda x: x._replace(y=x.y * start, s=x.s * start)), n, cap, Shortfalls)
        total = reduced(found, lambda x: np.maximum(x.y, 0).sum(), lambda a, b: a + b)
    r = reduced(found, lambda x: x.a @ (np.maximum(x.y, 0) / total), lambda a, b: a + b)
    return rows(spark, found, total, float(np.maximum(r, 0).sum() / max(np.maximum(-r, 0).sum(), 1e-300)), gap)


def best_sharpe(returns: DataFrame, days: int, max_weight: float = 1.0) -> DataFrame | None:
    """ticker, weight and gap of numerics.sharpe_program() by shrunk covariances, of more tickers than dates; None without dates that all have."""
    made, spark = panel.of(returns), returns.sparkSession
    if not made.full.any():
        return None
    n, cap, full, cov = made.n, max(max_weight, 1 / made.n), made.full, panel.shrunk(made)
    found = parts(made, lambda x: panel.centred(x, full), lambda x: np.nanmean(x, 1) * days, n, cap)
    most, square = reduced(found, lambda x: (x.m.max(), (x.a * x.a).sum()), lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    if not most > 0 or n * cap <= 1 + 1e-9:
        return rows(spark, found, 1.0)
    size = cov.scale * square / n + cov.ridge  # the mean variance
    found, _, gap = solve(found.map(lambda x: x._replace(m=x.m / most)), n, cap, lambda ay: Variance(cov.scale / size, cov.ridge / size))
    total = reduced(found, lambda x: np.maximum(x.y, 0).sum(), lambda a, b: a + b)
    return rows(spark, found, total, None, gap)
