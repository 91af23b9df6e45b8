"""Returns of many tickers as blocks of series that stay on the executors.

With more tickers than dates the pairs are many but the series are short: covariances are products of the series, so what
would be made of a table of pairs is made of two blocks at a time, and no pair is written. The driver gets squares of the dates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.functions.staging import staged
from tessera.operators import kmeans
from tessera.operators.graph import numbered

#: Tickers of a block at most, and blocks of a smaller table.
BLOCK, BLOCKS = 2048, 32


class Block(NamedTuple):
    """Some tickers with their place among all, the slot and sign of each in a sketch, and x: a row of returns for each, NaN where one is missing; core: the distance of each to its nearest."""

    number: int
    place: np.ndarray
    names: list[str]
    slot: np.ndarray
    sign: np.ndarray
    x: np.ndarray
    core: np.ndarray | None = None


class Panel(NamedTuple):
    """Blocks of returns; n tickers; days on which any has a return, and which of them all have; names (ticker, i), and tickers of a block."""

    blocks: RDD
    n: int
    days: np.ndarray
    full: np.ndarray
    names: DataFrame
    size: int


class Shrunk(NamedTuple):
    """Ledoit-Wolf covariances of a panel: scale times the products of centred series, and ridge on the diagonal; the shrinkage."""

    scale: float
    ridge: float
    shrinkage: float


class Product:
    """Covariances scale * x'x, x a row for each date, with ridge on the diagonal: what weights need of them are products."""

    __array_ufunc__ = None  # so that arrays leave their products with it to it

    def __init__(self, x: np.ndarray, scale: float, ridge: float):
        self.x, self.scale, self.ridge = x, scale, ridge

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.scale * (self.x.T @ (self.x @ w)) + self.ridge * w

    __rmatmul__ = __matmul__


def of(returns: DataFrame, width: int = kmeans.WIDTH) -> Panel:
    """The panel of returns(ticker, date, ret); tickers are in the order of their names."""
    spark = returns.sparkSession
    ship(spark)
    known = returns.where("ret is not null").select("ticker", "date", "ret")
    names = staged(numbered(known.select("ticker").distinct(), "ticker", "i"))
    n = names.count()
    days = staged(numbered(known.groupBy("date").agg(F.count("*").alias("k")), "date", "t"))
    calendar = days.orderBy("t").toPandas()  # a row for each date
    slot, sign = (F.pmod(h := F.xxhash64("ticker"), F.lit(width)), kmeans.signs(h)) if n > width else (F.col("i"), F.lit(1.0))
    size, length = max(1, min(BLOCK, -(-n // BLOCKS))), len(calendar)
    own = known.join(F.broadcast(days.select("date", F.col("t").cast("int").alias("t"))), "date").groupBy("ticker").agg(F.collect_list(F.struct("t", "ret")).alias("r"))
    dealt = own.join(names.select("ticker", "i", slot.cast("int").alias("slot"), sign.alias("sign"), F.floor(F.col("i") / size).cast("int").alias("k")), "ticker")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i").combine_chunks()
        entries, sizes = (f(rows["r"].combine_chunks()) for f in (pa.compute.list_flatten, pa.compute.list_value_length))
        x = np.full((rows.num_rows, length), np.nan)
        x[np.repeat(np.arange(rows.num_rows), sizes.to_numpy()), entries.field("t").to_numpy()] = entries.field("ret").to_numpy()
        block = Block(rows["k"][0].as_py(), rows["i"].to_numpy(), rows["ticker"].to_pylist(), rows["slot"].to_numpy(), rows["sign"].to_numpy(), x)
        return pa.table({"k": pa.array([rows["k"][0].as_py()], pa.int32()), "b": pa.array([pickle.dumps(tuple(block))], pa.binary())})

    blobs = staged(dealt.groupBy("k").applyInArrow(pack, "k int, b binary"))
    count = -(-n // size)
    keyed = blobs.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(max(1, count), lambda k: k)
    blocks = keyed.map(lambda kv: Block(*pickle.loads(kv[1]))).persist(StorageLevel.MEMORY_AND_DISK)
    return Panel(blocks, n, calendar["date"].to_numpy(), calendar["k"].to_numpy() == n, names, size)


def mapped(panel: Panel, f: Callable[[np.ndarray], np.ndarray]) -> RDD:
    """The blocks with f of their series."""
    return panel.blocks.map(lambda b: b._replace(x=f(b.x)))


def shrunk(panel: Panel) -> Shrunk:
    """The shrinkage of linalg.shrunk() over the dates that all tickers have, from a square of the dates or, if the tickers are fewer, from every two blocks."""
    full, n, t = panel.full, panel.n, int(panel.full.sum())
    few = t <= n

    def sums(b: Block) -> tuple:
        x = centred(b.x, full)
        return x.T @ x if few else np.zeros(()), (x * x).sum(0)

    gram, day = kmeans.reduced(panel.blocks, sums, lambda p, q: tuple(u + v for u, v in zip(p, q)))
    squares = (gram * gram).sum() if few else met(panel.blocks).map(lambda p: float(((centred(p[0].x, full) @ centred(p[1].x, full).T) ** 2).sum())).sum()
    mu, s2, q2 = float(day.sum() / t / n), float(squares / t**2), float((day * day).sum() / t)
    delta = (s2 - n * mu * mu) / n
    beta = min(delta, (q2 - s2) / (n * t))
    s = beta / delta if delta else 0.0
    return Shrunk((1 - s) / t, s * mu, s)


def centred(x: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Series on the dates that all tickers have, less their means."""
    x = x[:, full]
    return x - x.mean(1, keepdims=True)


def units(panel: Panel, cov: Shrunk) -> RDD:
    """Blocks whose series' products are the shrunk correlations of different tickers."""
    full, scale, ridge = panel.full, cov.scale, cov.ridge

    def unit(x: np.ndarray) -> np.ndarray:
        x = centred(x, full)
        d = np.sqrt(scale * (x * x).sum(1) + ridge)
        return x * (np.sqrt(scale) / np.where(d > 0, d, np.inf))[:, None]

    return mapped(panel, unit).persist(StorageLevel.MEMORY_AND_DISK)


def met(blocks: RDD) -> RDD:
    """Every two blocks in either order, those of one left block one after another in a task."""
    return blocks.cartesian(blocks.coalesce(1))


def once(a: Block, b: Block) -> bool:
    """Whether this is the one of the two orders that counts; either counts equally often."""
    i, j = a.number, b.number
    return i == j or (i < j) == ((i + j) % 2 == 0)


def correlations(a: Block, b: Block) -> np.ndarray:
    return np.clip(a.x @ b.x.T, -1.0, 1.0)


def apart(a: Block, b: Block) -> np.ndarray:
    """The distances sqrt((1 - c) / 2) of the series of two blocks."""
    d = np.sqrt((1 - correlations(a, b)) / 2)
    if a.number == b.number:
        np.fill_diagonal(d, 0.0)
    return d


def table(spark: SparkSession, batches: RDD, schema: str) -> DataFrame:
    """An RDD of record batches as a table."""

    def packed(batch: pa.RecordBatch) -> tuple[bytes]:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return (out.getvalue().to_pybytes(),)

    def opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for blob in row.column(0):
                yield from pa.ipc.open_stream(blob.as_py())

    return spark.createDataFrame(batches.map(packed), "b binary").mapInArrow(opened, schema)


def lists(b: Block) -> pa.RecordBatch:
    """A block's names and rows."""
    return pa.RecordBatch.from_arrays([pa.array(b.names), pa.ListArray.from_arrays(pa.array(np.arange(len(b.x) + 1) * b.x.shape[1], pa.int32()), pa.array(b.x.ravel()))], names=["ticker", "x"])


def series(spark: SparkSession, panel: Panel) -> DataFrame:
    """ticker, x: its returns on the panel's days, NaN where one is missing."""
    return table(spark, panel.blocks.map(lists), "ticker string, x array<double>")


def distance_rows(spark: SparkSession, blocks: RDD, n: int, width: int = kmeans.WIDTH) -> DataFrame:
    """kmeans.distance_rows() of the distances sqrt((1 - c) / 2) of units()."""
    size = width if n > width else n

    def rows(pairs: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        made = lambda b, x: lists(b._replace(x=x))
        own, sums = None, None
        for a, b in pairs:
            if own is None or own.number != a.number:
                if own is not None:
                    yield made(own, sums)
                own, sums = a, np.zeros((len(a.names), size))
            d = apart(a, b)
            order = np.argsort(b.slot, kind="stable")
            slots, starts = np.unique(b.slot[order], return_index=True)
            sums[:, slots] += np.add.reduceat(d[:, order] * b.sign[order], starts, axis=1)
        if own is not None:
            yield made(own, sums)

    return table(spark, met(blocks).mapPartitions(rows), "ticker string, x array<double>")


def least_edges(far: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and lengths of the edges of a minimum spanning tree of two sides (far: between them), or of one with itself where columns is rows.

    Of equal lengths the first by the lesser and then the greater place counts, as in graph.spanning().
    """
    one = columns is rows
    place = rows if one else np.concatenate([rows, columns])
    p, m = len(rows), len(rows) if one else len(rows) + len(columns)
    back = far if one else np.ascontiguousarray(far.T)
    best, parent, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
    key = lambda i, j: (np.minimum(place[i], place[j]), np.maximum(place[i], place[j]))
    out, u = np.zeros((max(m - 1, 0), 2), np.int64), 0
    length = np.zeros(max(m - 1, 0))
    for step in range(m - 1):
        open_[u], best[u] = False, np.inf
        part = slice(0, m) if one else slice(p, m) if u < p else slice(0, p)
        d = far[u] if u < p else back[u - p]
        near = (d < best[part]) & open_[part]
        same = (d == best[part]) & open_[part]
        if same.any():
            at = np.flatnonzero(same)
            i = at + part.start
            (lo, hi), (old_lo, old_hi) = key(i, u), key(i, parent[i])
            near[at] |= (lo < old_lo) | ((lo == old_lo) & (hi < old_hi))
        np.copyto(best[part], d, where=near)
        parent[part][near] = u
        u = int(best.argmin())
        ties = np.flatnonzero(best == best[u])
        if len(ties) > 1:
            u = int(ties[np.lexsort(key(ties, parent[ties])[::-1])[0]])
        out[step], length[step] = (parent[u], u), best[u]
    a, b = place[out[:, 0]], place[out[:, 1]]
    return np.minimum(a, b), np.maximum(a, b), length


#: Graphs of two blocks: from their correlations each one's name and its lengths.
Lengths = Callable[[np.ndarray, Block, Block], Iterator[tuple[str, np.ndarray]]]


def trees(blocks: RDD, lengths: Lengths) -> RDD:
    """For every two blocks and each graph (a, b, g, u, v, value): the places and lengths of the edges of its tree."""

    def of_two(pair: tuple[Block, Block]) -> Iterator[tuple]:
        a, b = pair
        if once(a, b):
            for g, far in lengths(correlations(a, b), a, b):
                yield a, b, g, *least_edges(far, a.place, a.place if a.number == b.number else b.place)

    return met(blocks).flatMap(of_two)


def forest(spark: SparkSession, blocks: RDD, lengths: Lengths) -> DataFrame:
    """Edges (g, a, b, value) among which the minimum spanning trees of all pairs are: the trees of every two blocks."""

    def edges(tree: tuple) -> pa.RecordBatch:
        a, b, g, u, v, value = tree
        at = {int(i): t for x in (a, b) for i, t in zip(x.place, x.names)}
        return pa.RecordBatch.from_pydict({"g": [g] * len(u), "a": [at[int(i)] for i in u], "b": [at[int(i)] for i in v], "value": value})

    return table(spark, trees(blocks, lengths).map(edges), "g string, a string, b string, value double")


def forest_of(u: np.ndarray, v: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of some edges are those of their minimum spanning forest, by Borůvka's rounds; of equal lengths the first places count."""
    order = np.lexsort((v, u, value))
    nodes, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    edge, none, out = np.arange(len(order)), len(order), []
    while len(edge):
        best = np.full(len(nodes), none)
        for end in (a, b):
            np.minimum.at(best, end[edge], edge)
        own = np.flatnonzero(best < none)
        out.append(np.unique(best[own]))
        to = np.arange(len(nodes))
        to[own] = a[best[own]] + b[best[own]] - own
        root = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[root] = np.flatnonzero(root)
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        edge = edge[a[edge] != b[edge]]
    return order[np.concatenate(out)] if out else order


#: Edges for each ticker that one task makes a forest of.
MERGED = 16


def merged_forest(spark: SparkSession, panel: Panel, blocks: RDD, lengths: Lengths) -> DataFrame:
    """forest(), of which only the edges of minimum spanning forests are left: those of some trees each."""
    count = blocks.getNumPartitions()
    parts = max(1, -(-count * (count + 1) * panel.size // (MERGED * panel.n)))

    def keyed(tree: tuple) -> tuple:
        a, b, g, u, v, value = tree
        return (g, (a.number * count + b.number) % parts), (u.astype(np.int32), v.astype(np.int32), value)

    def merged(group: tuple) -> pa.RecordBatch:
        (g, _), found = group
        u, v, value = (np.concatenate(x) for x in zip(*found))
        kept = forest_of(u, v, value)
        return pa.RecordBatch.from_pydict({"g": [g] * len(kept), "u": u[kept], "v": v[kept], "value": value[kept]})

    edges = table(spark, trees(blocks, lengths).map(keyed).groupByKey(max(parts, count)).map(merged), "g string, u int, v int, value double")
    of = lambda end, name: panel.names.select(F.col("i").cast("int").alias(end), F.col("ticker").alias(name))
    return edges.join(of("u", "a"), "u").join(of("v", "b"), "v").select("g", "a", "b", "value")


def with_nearest(blocks: RDD, far: Callable[[np.ndarray], np.ndarray]) -> RDD:
    """Blocks of series with core, the distance far of the correlation to the nearest of all others."""

    def least(pair: tuple[Block, Block]) -> Iterator[tuple[int, np.ndarray]]:
        a, b = pair
        if once(a, b):
            d = far(correlations(a, b))
            if a.number == b.number:
                np.fill_diagonal(d, np.inf)
            else:
                yield b.number, d.min(0)
            yield a.number, d.min(1)

    count = blocks.getNumPartitions()
    cores = blocks.context.broadcast(met(blocks).flatMap(least).reduceByKey(np.minimum, min(count, 64)).collectAsMap())  # a number for each ticker
    return blocks.map(lambda b: b._replace(core=cores.value[b.number])).persist(StorageLevel.MEMORY_AND_DISK)


class Labelled(NamedTuple):
    """The clustered series of a block with labels, a column for each cell (-1: none), and kind, by which they are sorted: series with equal labels have one."""

    number: int
    x: np.ndarray
    labels: np.ndarray
    kind: np.ndarray


#: Sums of distances that a task holds.
SUMS = 1 << 24


def mean_silhouettes(spark: SparkSession, panel: Panel, blocks: RDD, far: Callable[[np.ndarray], np.ndarray], labels: DataFrame) -> DataFrame:
    """graph.mean_silhouettes() of labels(cell, ticker, cluster) under the distances far of correlations.

    A series' distances are added up by kinds of others, and these by the clusters of each cell.
    """
    cells = sorted(r["cell"] for r in labels.select("cell").distinct().collect())
    if not cells:
        return spark.createDataFrame([], "cell int, s double")
    size, count = panel.size, blocks.getNumPartitions()
    first = panel.names.select(F.col("ticker").alias("cluster"), F.col("i").cast("int").alias("c"))
    own = labels.join(first, "cluster").join(panel.names, "ticker").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("cell", "c"))).alias("m"))
    rows = staged(own.select("i", F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(-1)) for c in cells)).alias("l")))
    kinds = staged(numbered(rows.select("l").distinct(), "l", "kind"))
    m = kinds.count()
    known = rows.join(kinds, "l").groupBy(F.floor(F.col("i") / size).cast("int").alias("k")).agg(F.collect_list(F.struct("i", "kind", "l")).alias("r"))

    def packed(r: tuple) -> tuple:
        at = np.array([x[0] for x in r[1]])
        order = at.argsort()
        return r[0], (at[order] - r[0] * size, np.array([x[1] for x in r[1]])[order], np.array([x[2] for x in r[1]], np.int32)[order])

    def chosen(pair: tuple) -> Labelled:
        number, (x, (at, kind, label)) = pair
        order = np.argsort(kind, kind="stable")
        return Labelled(number, x[at[order]], label[order], kind[order])

    keyed = known.rdd.map(packed).partitionBy(count, lambda k: k)
    right = blocks.map(lambda b: (b.number, b.x)).partitionBy(count, lambda k: k).join(keyed, count).map(chosen).persist(StorageLevel.MEMORY_AND_DISK)
    split = -(-size * m // SUMS)

    def cut(b: Labelled) -> list[tuple]:
        at = np.array_split(np.arange(len(b.x)), split)
        return [(b.number * split + j, Labelled(b.number * split + j, b.x[i], b.labels[i], b.kind[i])) for j, i in enumerate(at)]

    left = right.flatMap(cut).partitionBy(count * split, lambda k: k).values().persist(StorageLevel.MEMORY_AND_DISK)

    def rows_of(pairs: Iterator[tuple[Labelled, Labelled]]) -> Iterator[tuple[int, tuple[float, int]]]:
        own = None
        for a, b in pairs:
            if own is None or own.number != a.number:
                if own is not None:
                    yield from summed(own, sums, sizes, of)
                own, sums, sizes, of = a, np.zeros((len(a.x), m)), np.zeros(m), np.full((m, len(cells)), -1, np.int32)
            d = far(np.clip(a.x @ b.x.T, -1.0, 1.0))
            if a.number // split == b.number:
                d[np.arange(len(a.x)), np.array_split(np.arange(len(b.x)), split)[a.number % split]] = 0.0
            found, starts, n = np.unique(b.kind, return_index=True, return_counts=True)
            sums[:, found] += np.add.reduceat(d, starts, axis=1)
            sizes[found] += n
            of[b.kind] = b.labels
        if own is not None:
            yield from summed(own, sums, sizes, of)

    def summed(own: Labelled, sums: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, tuple[float, int]]]:
        for cell, label, mine in zip(cells, of.T, own.labels.T):
            inside = np.flatnonzero(mine >= 0)
            if not len(inside):
                continue
            at = np.flatnonzero(label >= 0)
            at = at[np.argsort(label[at], kind="stable")]
            ids, starts = np.unique(label[at], return_index=True)
            n = np.add.reduceat(sizes[at], starts)
            total = np.add.reduceat(sums[np.ix_(inside, at)], starts, axis=1)
            row, column = np.arange(len(inside)), np.searchsorted(ids, mine[inside])
            x = total[row, column] / np.maximum(n[column] - 1, 1)
            means = total / n
            means[row, column] = np.inf
            y = means.min(1)
            some = (n[column] > 1) & np.isfinite(y)
            s = np.where(some, (np.where(some, y, 0) - x) / np.maximum(np.maximum(x, np.where(some, y, 0)), 1e-12), 0.0)
            yield cell, (float(s.sum()), len(s))

    parts = left.cartesian(right.coalesce(1)).mapPartitions(rows_of).reduceByKey(lambda p, q: (p[0] + q[0], p[1] + q[1])).collect()  # a row for each cell
    left.unpersist()
    right.unpersist()
    return spark.createDataFrame([(c, s / n) for c, (s, n) in parts], "cell int, s double")
