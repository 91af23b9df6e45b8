"""Leading eigenvectors of a symmetric matrix that is a table of pairs.

A basis of a few blocks of vectors is one array for each ticker. A round multiplies its newest block with the matrix by a join and a
sum, and brings only the products of the basis with itself to the driver, which solves the small problem there (Rayleigh-Ritz);
the residuals of the wanted vectors are the next block. When the basis has its full width it starts again from
the best vectors found.

With more tickers than dates the normalised affinity is a product of the series less a diagonal, and no pair is written. The greatest
eigenvalues are counted by squares of the dates, and a rational filter that passes them alone is applied to random vectors: its inverses, too,
are solved by squares of the dates.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.functions.staging import staged
from tessera.operators import kmeans, panel

#: Blocks of a full basis (or as many vectors as FULL, if that is more), vectors in a block beyond those wanted, rounds at most, and the residual at which they end.
BLOCKS, FULL, SPARE, ROUNDS, TOLERANCE = 6, 256, 4, 60, 1e-9


def matrix_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def multiplied(matrix: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """(ticker, y): matrix(a, b, value), each pair both ways, times the columns of x(ticker, x)."""
    joined = matrix.join(x.select(F.col("ticker").alias("b"), "x"), "b")
    sums = [F.sum(F.col("value") * F.get("x", F.lit(j))).alias(f"y{j}") for j in range(width)]
    return joined.groupBy(F.col("a").alias("ticker")).agg(*sums).select("ticker", F.array(*(f"y{j}" for j in range(width))).alias("y"))


def grams(basis: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """V'V and V'MV of basis(ticker, v, m): squares of the basis' width."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            if batch.num_rows:
                v, m = matrix_of(batch, 0), matrix_of(batch, 1)
                own = np.stack([v.T @ v, v.T @ m])
                whole = own if whole is None else whole + own
        if whole is not None:
            yield pa.RecordBatch.from_pydict({"b": [pickle.dumps(whole)]})

    sums = basis.select("v", "m").mapInArrow(part, "b binary").rdd.map(lambda r: pickle.loads(r[0]))
    return tuple(sums.treeReduce(np.add))


def turned(basis: DataFrame, c: np.ndarray, r: np.ndarray, values: np.ndarray) -> DataFrame:
    """basis times c, and x, the residuals of its vectors v r with their values."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, m = matrix_of(batch, 1), matrix_of(batch, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays(v @ c), arrays(m @ c), arrays(m @ r - v @ (r * values))], names=["ticker", "v", "m", "x"])

    return basis.select("ticker", "v", "m").mapInArrow(turn, "ticker string, v array<double>, m array<double>, x array<double>")


def leading(matrix: DataFrame, k: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """(ticker, x), the k eigenvectors with the greatest eigenvalues of matrix(a, b, value) (each pair once, and its diagonal), and these values."""
    ship(matrix.sparkSession)
    both = staged(matrix.select("a", "b", "value").unionByName(matrix.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value")))
    tickers = both.select(F.col("a").alias("ticker")).distinct()
    n = tickers.count()
    k = min(k, n)
    width, have, found = min(n, k + SPARE), 0, np.zeros(k)
    unit = lambda j: (F.xxhash64("ticker", F.lit(j)) / F.lit(2.0**63)) if j else F.lit(1.0)
    empty = F.array().cast("array<double>")
    new = tickers.select("ticker", empty.alias("v"), empty.alias("m"), F.array(*map(unit, range(width))).alias("x"))
    for i in range(rounds + 1):
        basis = staged(new.join(multiplied(both, new, width), "ticker").select("ticker", F.concat("v", "x").alias("v"), F.concat("m", "y").alias("m")))
        s, h = grams(basis)
        if have and (i == rounds or np.sqrt(np.diag(s)[have : have + k]).max() < tolerance):  # the first k of the basis are good
            return basis.select("ticker", F.slice("v", 1, k).alias("x")), found[:k]
        scale = 1 / np.sqrt(np.maximum(np.diag(s), 1e-300))
        sizes, axes = np.linalg.eigh(s * np.outer(scale, scale))
        kept = sizes > 1e-10 * sizes.max()
        white = scale[:, None] * axes[:, kept] / np.sqrt(sizes[kept])
        found, turn = np.linalg.eigh(white.T @ (h + h.T) / 2 @ white)
        found, c = found[::-1], (white @ turn)[:, ::-1]
        width = min(width, c.shape[1])
        if c.shape[1] >= n:  # the whole space
            return turned(basis, c[:, :k], c[:, :1], found[:1]).select("ticker", F.col("v").alias("x")), found[:k]
        keep = c[:, : 2 * width] if c.shape[1] + width > max(BLOCKS * width, FULL) else c
        new, have = turned(basis, keep, c[:, :width], found[:width]), keep.shape[1]


def normalised(affinity: DataFrame) -> DataFrame:
    """affinity(a, b, value), a < b, divided by the roots of both row sums; the diagonal counts as 0."""
    sums = affinity.select(F.explode(F.array("a", "b")).alias("t"), "value").groupBy("t").agg(F.sum("value").alias("s"))
    of = lambda c: sums.select(F.col("t").alias(c), F.col("s").alias(f"_{c}"))
    return affinity.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("value") / F.sqrt(F.greatest(F.col("_a") * F.col("_b"), F.lit(1e-24)))).alias("value"))


def embedding(affinity: DataFrame, k: int) -> DataFrame:
    """ticker, x: its row of the k leading eigenvectors of the normalised affinity, scaled to length 1."""
    vectors, _ = leading(normalised(affinity), k)
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return vectors.withColumn("_l", F.greatest(length, F.lit(1e-12))).select("ticker", F.transform("x", lambda v: v / F.col("_l")).alias("x"))


#: Shifts that one pass counts for, poles of the filter, columns beyond those counted, and the greatest residual by the half width of the filter's edge.
SHIFTS, POLES, MORE, CLOSE = 3, 8, 16, 1e-6


class Edge(NamedTuple):
    """The filter passes what is above at + gap (at half where it is beyond reach) and stops what is below at - gap, to the least eigenvalue at - reach; width: columns of its basis."""

    at: float
    gap: float
    reach: float
    width: int


def affinity_rows(units: RDD, n: int) -> RDD:
    """Blocks of panel.units() with x and core such that n times normalised() of their affinity is xx' less core on the diagonal."""
    total = kmeans.reduced(units, lambda b: b.x.sum(0), np.add)

    def rows(b: panel.Block) -> panel.Block:
        square = (b.x * b.x).sum(1)
        s = np.maximum((n - 1 + b.x @ total - square) / 2, 1e-12)
        return b._replace(x=np.column_stack([np.ones(len(s)), b.x]) * np.sqrt(n / 2 / s)[:, None], core=n * (1 + square) / 2 / s)

    return units.map(rows)


def added(p: tuple, q: tuple) -> tuple:
    return tuple(u + v for u, v in zip(p, q))


def half(m: np.ndarray) -> np.ndarray:
    """The upper triangles of symmetric squares."""
    return m[..., *np.triu_indices(m.shape[-1])]


def whole(m: np.ndarray) -> np.ndarray:
    """The symmetric squares of half()."""
    size = int(np.sqrt(2 * m.shape[-1]))
    out = np.zeros((*m.shape[:-1], size, size), m.dtype)
    i, j = np.triu_indices(size)
    out[..., i, j] = out[..., j, i] = m
    return out


def counts(rows: RDD, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of affinity_rows() are above each of at, by the signs of a square of the dates (Sylvester's law of inertia)."""

    def part(b: panel.Block) -> tuple:
        d = b.core + at[:, None]
        d[d == 0] = 1e-300
        return np.stack([half(b.x.T @ (b.x / own[:, None])) for own in d]), (d < 0).sum(1)

    squares, below = kmeans.reduced(rows, part, added)
    return below + np.array([(np.linalg.eigvalsh(m) > 1).sum() for m in whole(squares)])


def shift_between(rows: RDD, ends: tuple[float, float], least: int, most: int) -> tuple[float, int]:
    """A shift above which are at least least and at most most eigenvalues, and how many; if equal eigenvalues leave none, the next one below it."""
    (lo, hi), below = ends, None
    while True:
        at = np.linspace(lo, hi, SHIFTS + 2)[1:-1]
        found = counts(rows, at)
        fit = np.flatnonzero((found >= least) & (found <= most))
        if len(fit):
            return float(at[fit[-1]]), int(found[fit[-1]])
        over = np.flatnonzero(found > most)
        if len(over):
            lo = float(at[over[-1]])
            below = lo, int(found[over[-1]])
        hi = float(at[over[-1] + 1]) if len(over) and over[-1] + 1 < len(at) else hi if len(over) else float(at[0])
        if hi - lo < 1e-12 * max(1.0, abs(hi)):
            return below or (lo, int(counts(rows, np.array([lo]))[0]))


def edge_below(rows: RDD, n: int, k: int) -> Edge:
    """An edge below the k greatest eigenvalues, with as few more above it as a third of k lets be."""
    sums, deepest = kmeans.reduced(rows, lambda b: (float((b.x * b.x).sum()), float(b.core.max())), lambda p, q: (p[0] + q[0], max(p[1], q[1])))
    more = max(MORE, k // 3)
    upper, count = shift_between(rows, (-1.001 * deepest, 1.001 * sums / k), k, k + more // 4)
    lower, count = shift_between(rows, (-1.001 * deepest, upper), min(count + more // 2, n), min(count + more, n))
    at = (upper + lower) / 2
    return Edge(at, (upper - lower) / 2, max(1.001 * deepest + at, upper - lower), min(n, count + MORE))


def poles(edge: Edge) -> tuple[np.ndarray, np.ndarray]:
    """t and w with which the sum of w x / (x x + t t) is near the sign of x from the edge's gap to its reach."""
    t = np.geomspace(edge.gap / 3, 3 * edge.reach, POLES)
    x = np.geomspace(edge.gap, edge.reach, 40 * POLES)[:, None]
    return t, np.linalg.lstsq(x / (x * x + t * t), np.ones(len(x)), rcond=None)[0]


def leading_of_rows(rows: RDD, n: int, k: int, rounds: int = ROUNDS) -> tuple[RDD, np.ndarray]:
    """Blocks whose x are the k eigenvectors of affinity_rows() with the greatest eigenvalues, and these values.

    A round filters the vectors and finds the best in their span (Rayleigh-Ritz); the driver gets squares of the vectors' number and of the dates.
    """
    edge = edge_below(rows, n, k)
    t, w = poles(edge)
    z = edge.at - 1j * t

    squares = whole(kmeans.reduced(rows, lambda b: np.stack([half(b.x.T @ (b.x / (b.core + s)[:, None])) for s in z]), np.add))
    inverses = np.linalg.inv(np.eye(squares.shape[-1]) - squares)

    def drawn(b: panel.Block) -> tuple:
        return b, np.array([np.random.default_rng(zlib.crc32(name.encode())).standard_normal(edge.width) for name in b.names])

    now, old, values = rows.map(drawn), None, np.zeros(k)
    for i in range(rounds + 1):

        def sides(own: tuple) -> np.ndarray:
            b, v = own
            return np.stack([(b.x / (b.core + s)[:, None]).T @ v for s in z])

        right = kmeans.reduced(now, sides, np.add)
        solved = now.context.broadcast(inverses @ right)

        def filtered(own: tuple, solved=solved) -> tuple:
            b, v = own
            out = v.copy()
            for s, weight, y in zip(z, w, solved.value):
                out -= weight * ((v + b.x @ y) / (b.core + s)[:, None]).real
            return b, out / 2

        made = now.map(filtered).persist(StorageLevel.MEMORY_AND_DISK)
        s, e, g = kmeans.reduced(made, lambda own: (own[1].T @ own[1], own[1].T @ (own[0].core[:, None] * own[1]), own[0].x.T @ own[1]), added)
        scale = 1 / np.sqrt(np.maximum(np.diag(s), 1e-300))
        sizes, axes = np.linalg.eigh(s * np.outer(scale, scale))
        kept = sizes > 1e-13 * sizes.max()
        white = scale[:, None] * axes[:, kept] / np.sqrt(sizes[kept])
        g = g @ white
        found, turn = np.linalg.eigh(g.T @ g - white.T @ e @ white)
        found, c, g = found[::-1], (white @ turn)[:, ::-1], (g @ turn)[:, ::-1]
        values = found[:k]

        def turned_by(own: tuple, c=c) -> tuple:
            return own[0], own[1] @ c

        def off(own: tuple, g=g[:, :k], values=values) -> np.ndarray:
            b, v = own
            return ((b.x @ g - (b.core[:, None] + values) * v[:, :k]) ** 2).sum(0)

        now = made.map(turned_by).persist(StorageLevel.MEMORY_AND_DISK)
        far = float(np.sqrt(kmeans.reduced(now, off, np.add).max()))
        made.unpersist()
        if old:
            old.unpersist()
        old = now
        if far <= CLOSE * edge.gap or i == rounds:
            return now.map(lambda own: own[0]._replace(x=own[1][:, :k])), values


def embedding_of_series(spark: SparkSession, units: RDD, n: int, k: int) -> DataFrame:
    """embedding() of the affinities (1 + c) / 2 of panel.units(), by their series, so that there is no table of pairs."""
    few = max(1, min(units.getNumPartitions(), spark.sparkContext.defaultParallelism))
    rows = affinity_rows(units, n).coalesce(few).persist(StorageLevel.MEMORY_AND_DISK)
    found, _ = leading_of_rows(rows, n, k)
    return panel.table(spark, found.map(lambda b: panel.lists(b._replace(x=b.x / np.maximum(np.sqrt((b.x * b.x).sum(1, keepdims=True)), 1e-12)))), "ticker string, x array<double>")
