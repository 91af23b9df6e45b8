"""K-means over the rows of the distances of all tickers, which are made of blocks of series as they are needed.

A row has a component for each ticker, so the matrix is the square of the tickers and is never kept: a centroid is a set of tickers,
D h / |h|, and what it makes with the rows is D (D h) / |h|, two blocks of series at a time. The driver has the sets and a few numbers for each ticker.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import kmeans, panel


def products(left: RDD, right: RDD, of: Callable[[panel.Block], np.ndarray]) -> RDD:
    """Blocks of left whose core is their distances to the series of right times of these."""

    def rows(pairs: Iterator[tuple[panel.Block, panel.Block]]) -> Iterator[panel.Block]:
        sums: dict[int, panel.Block] = {}
        for a, b in pairs:
            made = panel.apart(a, b) @ of(b)
            if a.number in sums:
                np.add(made, sums[a.number].core, out=sums[a.number].core)
            else:
                sums[a.number] = a._replace(core=made)
        yield from sums.values()

    return left.cartesian(right.coalesce(1)).mapPartitions(rows)


def collected(blocks: RDD, n: int, of: Callable[[panel.Block], np.ndarray]) -> np.ndarray:
    """of each block, a row for each ticker, in their order."""
    out = None
    for place, rows in blocks.map(lambda b: (b.place, of(b))).collect():
        out = np.zeros((n, *rows.shape[1:]), rows.dtype) if out is None else out
        out[place] = rows
    return out


class Rows:
    """The rows of the distances of panel.units() of n tickers: their blocks, squared lengths and names."""

    def __init__(self, units: RDD, n: int):
        few = max(1, min(units.getNumPartitions(), units.context.defaultParallelism))
        self.blocks, self.n = units.map(lambda b: b._replace(slot=None, sign=None, core=None)).coalesce(few).persist(StorageLevel.MEMORY_AND_DISK), n
        self.bare = self.blocks.map(lambda b: b._replace(names=None)).persist(StorageLevel.MEMORY_AND_DISK)

        def squares(pairs: Iterator[tuple[panel.Block, panel.Block]]) -> Iterator[panel.Block]:
            sums: dict[int, panel.Block] = {}
            for a, b in pairs:
                if a.number not in sums:
                    sums[a.number] = a._replace(core=np.zeros(len(a.x)))
                np.add((panel.apart(a, b) ** 2).sum(1), sums[a.number].core, out=sums[a.number].core)
            yield from sums.values()

        self.norms = collected(self.bare.cartesian(self.bare.coalesce(1)).mapPartitions(squares), n, lambda b: b.core)

    def free(self) -> None:
        self.bare.unpersist()
        self.blocks.unpersist()

    def names(self) -> list[str]:
        return list(itertools.chain.from_iterable(x for _, x in sorted(self.blocks.map(lambda b: (b.number, b.names)).collect())))

    def gaps_to(self, places: list[int]) -> np.ndarray:
        """Squared distances of all rows to those at places."""
        chosen = sorted({int(p) for p in places})
        found = dict(self.bare.flatMap(lambda b: [(int(p), b.x[i]) for i, p in enumerate(b.place) if int(p) in chosen]).collect())
        x = panel.Block(-1, np.array(places), None, None, None, np.array([found[int(p)] for p in places]))

        def columns(b: panel.Block) -> np.ndarray:
            d = panel.apart(b, x)
            d[b.place[:, None] == x.place] = 0.0
            return d

        dots = collected(products(self.bare, self.bare, columns), self.n, lambda b: b.core)
        return np.maximum(self.norms[:, None] + self.norms[places] - 2 * dots, 0)

    def sums(self, members: np.ndarray, share: bool) -> RDD:
        """Blocks whose core are their components of the sums (or the means) of the rows of members, a column for each set."""
        width, sizes = members.shape[1], members.sum(0).astype(float) if share else np.ones(members.shape[1])
        bits = self.bare.context.broadcast(np.packbits(members, axis=1))
        return products(self.bare, self.bare, lambda b: np.unpackbits(bits.value[b.place], axis=1, count=width) / sizes).persist(StorageLevel.MEMORY_AND_DISK)

    def nearest(self, members: np.ndarray, parts: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """For each of parts of the means of members: the nearest of each row, and the sum of squared distances to these."""
        means = self.sums(members, True)
        squares = kmeans.reduced(means, lambda b: (b.core * b.core).sum(0), np.add)
        norms = self.bare.context.broadcast(self.norms)

        def own(b: panel.Block) -> np.ndarray:
            d = np.maximum(norms.value[b.place][:, None] + squares - 2 * b.core, 0)
            return np.stack([np.stack([d[:, p].argmin(1), d[:, p].min(1)], axis=1) for p in parts], axis=2)

        found = collected(products(self.bare, means, lambda b: b.core), self.n, own)
        means.unpersist()
        return found[:, 0].astype(np.int32), found[:, 1].sum(0)

    def silhouettes(self, labels: np.ndarray, sizes: list[int]) -> list[float]:
        """kmeans.mean_silhouettes() of the columns of labels, each with so many clusters."""
        parts, members = cut(sizes), hot(labels, sizes)
        n, psi = members.sum(0).astype(float), self.norms @ members
        sums = self.sums(members, False)
        given = self.bare.context.broadcast((self.norms, labels))

        def score(b: panel.Block) -> np.ndarray:
            norms, own = given.value
            return np.array([kmeans.silhouette_sum(norms[b.place], b.core[:, p], own[b.place, i], n[p], psi[p]) for i, p in enumerate(parts)])

        whole = kmeans.reduced(products(self.bare, sums, lambda b: b.core), score, np.add)
        sums.unpersist()
        return [float(s / self.n) if (n[p] > 0).sum() > 1 else -1.0 for s, p in zip(whole, parts)]


def cut(sizes: list[int]) -> list[slice]:
    edges = np.cumsum([0, *sizes])
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def hot(labels: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The sets that columns of labels make, a column for each."""
    return np.concatenate([labels[:, [i]] == np.arange(k) for i, k in enumerate(sizes)], axis=1)


def seeds(rows: Rows, most: int, tries: int, seed: int) -> np.ndarray:
    """kmeans.seeds() as places, a row for each try; a pass for each draw."""
    names, drawn, weight = rows.names(), np.zeros((tries, 0), int), np.ones((tries, rows.n))
    for i in range(most):
        hurry = -np.log([[(zlib.crc32(f"{seed}:{t}:{i}:{name}".encode()) + 1) / (2**32 + 1) for name in names] for t in range(tries)])
        with np.errstate(divide="ignore"):
            new = (hurry / weight).argmin(1)  # of equal ones the first name
        drawn = np.column_stack([drawn, new])
        if i + 1 < most:
            gaps = rows.gaps_to(new.tolist()).T
            gaps[gaps <= 1e-12 * rows.norms] = 0.0
            weight = np.minimum(weight, gaps) if i else gaps
    return drawn


def lloyd(rows: Rows, starts: list[np.ndarray], rounds: int) -> list[tuple[float, np.ndarray]]:
    """(cost, members) of each of several starts at places, all moved in the same passes, each until it stands still; an empty cluster stays where it was."""
    now = [np.arange(rows.n)[:, None] == start for start in starts]
    cost, going = np.zeros(len(now)), list(range(len(now)))
    for _ in range(rounds):
        sizes = [now[i].shape[1] for i in going]
        labels, costs = rows.nearest(np.concatenate([now[i] for i in going], axis=1), cut(sizes))
        cost[going], moved = costs, []
        for i, own in zip(going, labels.T):
            new = hot(own[:, None], [now[i].shape[1]])
            new = np.where(new.any(0), new, now[i])
            if (new != now[i]).any():
                moved.append(i)
            now[i] = new
        going = moved
        if not going:
            break
    return list(zip(cost.tolist(), now))


def clusters(spark: SparkSession, units: RDD, n: int, sizes: list[int], tries: int = kmeans.TRIES, rounds: int = kmeans.ROUNDS, seed: int = kmeans.SEED) -> DataFrame:
    """kmeans.clusters() of the rows of distances sqrt((1 - c) / 2) of panel.units() of n tickers, with a component for each ticker, however many."""
    table = lambda of: panel.table(spark, units.map(lambda b: pa.RecordBatch.from_pydict({"ticker": b.names, "cluster": pa.array(of(b.place), pa.int32())})), "ticker string, cluster int")
    sizes = [k for k in sizes if 2 <= k <= n - 1]
    if not sizes:
        return table(lambda place: np.zeros(len(place), np.int32))
    rows = Rows(units, n)
    drawn = seeds(rows, max(sizes), tries, seed)
    tried = lloyd(rows, [own[:k] for k in sizes for own in drawn], rounds)
    best = [min(tried[i * tries : (i + 1) * tries], key=lambda x: x[0])[1] for i in range(len(sizes))]
    labels, _ = rows.nearest(np.concatenate(best, axis=1), cut(sizes))
    scores = rows.silhouettes(labels, sizes) if len(best) > 1 else [0.0]
    rows.free()
    _, first, own = np.unique(labels[:, int(np.argmax(scores))], return_index=True, return_inverse=True)
    place = first.argsort().argsort()[own].astype(np.int32)  # clusters are numbered by their first ticker
    given = spark.sparkContext.broadcast(place)
    return table(lambda at: given.value[at])
