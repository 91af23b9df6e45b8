"""Small dense algorithms, for tables that Spark has already reduced to one row an asset or a pair."""

from __future__ import annotations

import warnings

import numpy as np


def onto_simplex(v: np.ndarray, total: float, low: float, high: float) -> np.ndarray:
    """The nearest point with that sum and those bounds, by bisection on a shift."""
    a, b = (v - high).min(), (v - low).max()
    for _ in range(100):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(v - mid, low, high).sum() > total else (a, mid)
    return np.clip(v - (a + b) / 2, low, high)


def objective(name: str, mu: np.ndarray, cov: np.ndarray, x: np.ndarray, order: int = 3, target: float = 0.0):
    """The function of weights to minimise."""
    sharpe = lambda w: (w @ mu) / np.sqrt(max(w @ cov @ w, 1e-18))

    def kappa(w):
        r = x @ w
        return (r.mean() - target) / max((np.maximum(target - r, 0) ** order).mean(), 1e-8) ** (1 / order)

    def omega(w):
        r = x @ w - target
        return np.maximum(r, 0).mean() / max(np.maximum(-r, 0).mean(), 1e-12)

    def tail(w):
        r = np.sort(x @ w)
        worst = r[: max(1, int(np.ceil(0.05 * len(r))))].mean()
        return r.std() + max(0.0, -worst)

    growth = lambda w: np.prod(1 + x @ w) - 1
    known = {
        "min_vol_tail": tail,
        "kappa": lambda w: -kappa(w),
        "omega": lambda w: -omega(w),
        "sharpe": lambda w: -sharpe(w),
        "sk_mix": lambda w: -(kappa(w) + sharpe(w)) / 2,
        "so_mix": lambda w: -(sharpe(w) + omega(w)) / 2,
        "aggro": lambda w: -(growth(w) + sharpe(w) + kappa(w)) / 3,
        "yolo": lambda w: -(growth(w) + sharpe(w)) / 2,
    }
    if name not in known:
        warnings.warn(f"unknown objective {name}; the Sharpe ratio is taken", stacklevel=2)
    return known.get(name, known["sharpe"])


def slope(name: str, mu: np.ndarray, cov: np.ndarray, x: np.ndarray, order: int = 3, target: float = 0.0):
    """The gradient of objective() as a function of weights, in a few products of x and cov with vectors."""
    mean = x.mean(0)

    def sharpe(w):
        pull = cov @ w
        var = w @ pull
        return mu / np.sqrt(max(var, 1e-18)) - ((w @ mu) * var**-1.5 * pull if var > 1e-18 else 0.0)

    def kappa(w):
        r = x @ w
        short = np.maximum(target - r, 0)
        power = (short**order).mean()
        d = max(power, 1e-8) ** (1 / order)
        fall = -(power ** (1 / order - 1)) * (short ** (order - 1) @ x) / len(r) if power > 1e-8 else 0.0
        return mean / d - (r.mean() - target) / d**2 * fall

    def omega(w):
        r = x @ w - target
        gain, loss = np.maximum(r, 0).mean(), np.maximum(-r, 0).mean()
        low = max(loss, 1e-12)
        return (r > 0) @ x / len(r) / low + (gain / low**2 * ((r < 0) @ x) / len(r) if loss > 1e-12 else 0.0)

    def tail(w):
        r = x @ w
        worst = np.argsort(r, kind="stable")[: max(1, int(np.ceil(0.05 * len(r))))]
        sd = r.std()
        return ((r - r.mean()) @ x / len(r) / sd if sd else 0.0) - (x[worst].mean(0) if r[worst].mean() < 0 else 0.0)

    def growth(w):
        f = 1 + x @ w
        before, behind = np.cumprod(np.append(1.0, f[:-1])), np.cumprod(np.append(1.0, f[:0:-1]))[::-1]
        return (before * behind) @ x

    known = {
        "min_vol_tail": tail,
        "kappa": lambda w: -kappa(w),
        "omega": lambda w: -omega(w),
        "sharpe": lambda w: -sharpe(w),
        "sk_mix": lambda w: -(kappa(w) + sharpe(w)) / 2,
        "so_mix": lambda w: -(sharpe(w) + omega(w)) / 2,
        "aggro": lambda w: -(growth(w) + sharpe(w) + kappa(w)) / 3,
        "yolo": lambda w: -(growth(w) + sharpe(w)) / 2,
    }
    return known.get(name, known["sharpe"])


def best_weights(name: str, mu: np.ndarray, cov: np.ndarray, x: np.ndarray, max_weight: float = 1.0, short: bool = False, total: float = 1.0, steps: int = 150) -> np.ndarray:
    """Projected gradient with halving steps, from equal weights and from each end of the means."""
    n = len(mu)
    high = max(max_weight, 1 / n)
    low = -high if short else 0.0
    if not n * low <= total <= n * high:
        raise ValueError("no weights within the bounds have that sum")
    f, rise, best = objective(name, mu, cov, x), slope(name, mu, cov, x), (np.inf, np.full(n, total / n))
    for begin in (np.full(n, total / n), onto_simplex(mu / (np.abs(mu).max() + 1e-12), total, low, high)):
        w, value, step = begin, f(begin), 0.5
        for _ in range(steps):
            grad = rise(w)
            scale = np.abs(grad).max()
            if not scale:
                break
            while step > 1e-7:
                new = onto_simplex(w - step * grad / scale, total, low, high)
                if (better := f(new)) < value - 1e-12:
                    break
                step /= 2
            else:
                break
            w, value, step = new, better, min(1.0, step * 1.5)
        best = min(best, (value, w), key=lambda p: p[0])
    return best[1]


def isolation_scores(x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> np.ndarray:
    """0.5 less the usual score of an isolation forest: low values are isolated.

    All trees grow together, a level at a time; each node has its own draws, whatever the others draw.
    """
    made, (n, d) = np.random.default_rng(seed), x.shape
    size = min(size, n)
    levels = int(np.ceil(np.log2(max(size, 2))))
    m = np.maximum(np.arange(size + 1), 3)
    usual = np.where(np.arange(size + 1) > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.arange(size + 1) == 2)
    row = np.concatenate([made.choice(n, size, replace=False) for _ in range(trees)])
    width = 2 << levels  # nodes of a tree: the root is 1, the sides of i are 2 i and 2 i + 1
    pick, place = made.random((2, trees * width))
    feature, cut, reached = np.full(trees * width, -1), np.zeros(trees * width), np.zeros(trees * width)
    reached += np.tile(np.floor(np.log2(np.maximum(np.arange(width), 1))), trees)
    node = np.repeat(np.arange(trees) * width + 1, size)
    for level in range(levels + 1):
        if not len(node):
            break
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        at, sizes = node[starts], np.diff(np.append(starts, len(node)))
        lo, hi = (np.stack([ends.reduceat(x[row, c], starts) for c in range(d)], 1) for ends in (np.minimum, np.maximum))
        open_ = (hi > lo) & (level < levels)
        k = open_.sum(1)
        reached[at[k == 0]] += usual[sizes[k == 0]]
        c = (open_.cumsum(1) > np.floor(pick[at] * k)[:, None]).argmax(1)
        low, high = lo[np.arange(len(at)), c], hi[np.arange(len(at)), c]
        feature[at] = np.where(k > 0, c, -1)
        cut[at] = low + (high - low) * place[at]
        going = np.repeat(k > 0, sizes)
        node, row = node[going], row[going]
        base = node // width * width
        node = base + 2 * (node - base) + (x[row, feature[node]] >= cut[node])
        order = np.argsort(node, kind="stable")
        node, row = node[order], row[order]
    base, depths = np.arange(trees)[:, None] * width, np.zeros(n)
    for begin in range(0, n, 8192):  # what is held at once doesn't grow with the rows
        rows = np.arange(begin, min(n, begin + 8192))
        node = np.tile(base + 1, len(rows))
        for _ in range(levels):
            f = feature[node]
            node = np.where(f >= 0, base + 2 * (node - base) + (x[rows, f] >= cut[node]), node)
        depths[rows] = reached[node].sum(0)
    return 0.5 - 2.0 ** (-depths / trees / max(usual[size], 1e-12))


def inverse(p: np.ndarray) -> np.ndarray:
    """Inverses of symmetric 2 x 2 matrices (2, 2, ...), pseudo-inverses where they are singular."""
    det = p[0, 0] * p[1, 1] - p[0, 1] * p[1, 0]
    flat = ~(np.abs(det) > 1e-14 * np.abs(p[0, 0] * p[1, 1]))
    out = np.stack([np.stack([p[1, 1], -p[0, 1]]), np.stack([-p[1, 0], p[0, 0]])]) / np.where(flat, 1.0, det)
    if flat.any():
        out[..., flat] = np.moveaxis(np.linalg.pinv(np.moveaxis(p[..., flat], -1, 0)), 0, -1)
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (2, 2, ...)."""
    return np.einsum("ij...,jk...->ik...", a, b)


def kalman_residuals(y: np.ndarray, rounds: int = 10) -> np.ndarray:
    """y less its filtered level under a constant-velocity model, noise refined by expectation maximisation.

    y is one series, or a column for each of several of the same length, which are filtered side by side.
    """
    if y.ndim == 1:
        return kalman_residuals(y[:, None], rounds)[:, 0]
    n, k = y.shape
    q, r = np.tile(np.diag([1e-5, 1e-4])[:, :, None], k), np.full(k, 1e-2)
    f = np.array([[1.0, 1], [0, 1]])
    m, p = np.zeros((n, 2, k)), np.zeros((n, 2, 2, k))
    ahead_m, ahead_p = np.zeros((n, 2, k)), np.zeros((n, 2, 2, k))
    for step in range(rounds + 1):
        for t in range(n):
            if t:
                u, v = m[t - 1], p[t - 1]
                ahead_m[t] = u[0] + u[1], u[1]
                side = v[0, 1] + v[1, 1], v[1, 0] + v[1, 1]
                ahead_p[t] = ((v[0, 0] + v[1, 0] + side[0], side[0]), (side[1], v[1, 1])) + q
            else:
                ahead_m[t], ahead_p[t] = (y[0], np.zeros(k)), np.eye(2)[:, :, None]
            gain = ahead_p[t, :, 0] / (ahead_p[t, 0, 0] + r)
            m[t] = ahead_m[t] + gain * (y[t] - ahead_m[t, 0])
            p[t] = ahead_p[t] - gain[:, None] * ahead_p[t, 0]
        if step == rounds or n < 3:
            return y - m[:, 0]
        ms, ps, cross = m.copy(), p.copy(), np.zeros((n, 2, 2, k))
        for t in range(n - 2, -1, -1):
            j = times(np.stack([p[t, :, 0] + p[t, :, 1], p[t, :, 1]], 1), inverse(ahead_p[t + 1]))
            turned = np.swapaxes(j, 0, 1)
            ms[t] += (j * (ms[t + 1] - ahead_m[t + 1])).sum(1)
            ps[t] += times(times(j, ps[t + 1] - ahead_p[t + 1]), turned)
            cross[t + 1] = times(ps[t + 1], turned)
        r = np.maximum(1e-12, ((y - ms[:, 0]) ** 2 + ps[:, 0, 0]).mean(0))
        e = ms[1:] - np.einsum("ij,tjk->tik", f, ms[:-1])
        whole = np.einsum("tik,tjk->ijk", e, e) + (ps[1:] - np.einsum("tijk,lj->tilk", cross[1:], f) - np.einsum("ij,tljk->tilk", f, cross[1:]) + np.einsum("ij,tjlk,ml->timk", f, ps[:-1], f)).sum(0)
        q = (whole + np.swapaxes(whole, 0, 1)) / 2 / (n - 1) + 1e-12 * np.eye(2)[:, :, None]


def cointegration(s00: np.ndarray, s01: np.ndarray, s11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, leading vector) of the rank test from residual moments; the vector's sizes add to 1, its first part is positive."""
    root = np.linalg.inv(np.linalg.cholesky(s11 + 1e-12 * np.trace(s11) / len(s11) * np.eye(len(s11))))
    values, vectors = np.linalg.eigh(root @ s01.T @ np.linalg.pinv(s00) @ s01 @ root.T)
    v = root.T @ vectors[:, -1]
    v = v / np.abs(v).sum()
    return values[::-1], v * np.sign(v[np.flatnonzero(np.abs(v) > 1e-12)[0]])


def sharpe_program(mu: np.ndarray, cov: np.ndarray, max_weight: float = 1.0, steps: int = 100, least: float = 1e-12) -> np.ndarray:
    """Weights from 0 to max_weight, of sum 1, with the greatest mu w / sqrt(w cov w), as a quadratic program; equal ones if no mean is positive.

    With y scaled to mu y = 1 the variance is minimised under 0 <= y <= max_weight * sum(y), by an interior point method.
    """
    n = len(mu)
    if not mu.max() > 0 or n * max_weight <= 1 + 1e-9:
        return np.full(n, 1 / n)
    scale, size = np.abs(mu).max(), np.trace(cov) / n
    m, v = mu / scale, cov / size
    border = max_weight * np.ones((n, n)) - np.eye(n)
    y, lam = np.ones(n) / n, 0.0
    s = border @ y
    p, w = 1 / y, 1 / s
    for _ in range(steps):
        gap = (p @ y + w @ s) / (2 * n)
        off, short = 2 * v @ y - p - border @ w - lam * m, 1 - m @ y
        if gap < least and np.abs(off).max() < 1e-9 and abs(short) < 1e-9:
            break
        aim = 0.1 * gap
        left = np.zeros((n + 1, n + 1))
        left[:n, :n] = 2 * v + np.diag(p / y) + border @ np.diag(w / s) @ border
        left[:n, n] = left[n, :n] = -m
        step = np.linalg.solve(left, np.append(-off + (aim - p * y) / y + border @ ((aim - w * s) / s), -short))
        dy, dlam = step[:n], step[n]
        dp, ds = (aim - p * y - p * dy) / y, border @ dy
        dw = (aim - w * s - w * ds) / s
        falls = [(-x[d < 0] / d[d < 0]).min() for x, d in ((y, dy), (s, ds), (p, dp), (w, dw)) if (d < 0).any()]
        t = min(1.0, 0.995 * min(falls, default=2.0))
        y, s, p, w, lam = y + t * dy, s + t * ds, p + t * dp, w + t * dw, lam + t * dlam
    return np.maximum(y, 0) / np.maximum(y, 0).sum()
