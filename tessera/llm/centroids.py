"""Centroid clustering (Lloyd rounds) by exponion search.

Every vector keeps an upper bound on the distance to its centroid and a lower one on the distance to all others. Where
the upper bound isn't under the lower one, nor under half the distance from its centroid to the next, the
vector looks only at centroids inside a ball around its own: those within twice its distance plus the distance from
its centroid to the next. Distances between centroids are sorted for each of them, so a ball is the
head of a list; its radius is inclusive and bounds are compared strictly, so a centroid at an equal distance is seen
and the smaller number wins. Distances are exact integers; bounds are doubles, moved outwards by more than
their rounding error.

Vectors are packed into blocks of one Arrow batch, with their bounds beside them, and the blocks are kept on the
executors from round to round. A round sends k centroids out and brings k sums back, by a tree.
Lost blocks are made again from the table and the centroids of the rounds since, without a shuffle.

Vectors with another number of components than dims, or with one that is null or not finite, are left out, and so
are null vectors. A null id is hashed as the word null; rows that agree in id and vector are each returned.
Equal hashes are ordered by components. With fewer than k vectors there are as many centroids as vectors; an empty
table gives an empty result. Components of any finite size are computed exactly; a distance or an inertia too great
for a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship

CLUSTERS, ROUNDS, SEED, SCALE, DIMS = 8, 10, 3, 1024, 64
#: Centroids at most: they and the distances between them, 8 * MAX_CLUSTERS ** 2 bytes, go to every task.
MAX_CLUSTERS = 4096
#: Components up to SMALL keep squared distances of MAX_DIMS components in 63 bits; larger ones become Python's integers.
SMALL, MAX_DIMS = 1 << 24, 1 << 12
#: More than the relative rounding error of a bound in one round.
SLACK = 1e-12
LONG = (1 << 63) - 1


class Block(NamedTuple):
    """Ids, integer vectors, the centroid of each (-1: none yet), and its bounds."""

    ids: pa.Array
    x: np.ndarray
    at: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Centres(NamedTuple):
    """Centroids, for each all of them in order of distance (itself first), these distances, and how far each has moved."""

    c: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    moved: np.ndarray


def whole(rows: list[list[int]] | np.ndarray, dims: int) -> np.ndarray:
    """Integers as longs, or as Python's where one is large."""
    found = np.array(rows, object).reshape(len(rows), dims)
    return found.astype(np.int64) if all(abs(v) <= SMALL for v in found.ravel()) else found


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles."""
    if not x.size or np.abs(x).max() <= SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    return whole([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()], x.shape[1])


def packed(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[Block]:
    """Batches (id, vector of dims components) to blocks of the vectors that are finite."""
    for batch in batches:
        flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
        x = flat.reshape(-1, dims)
        fine = np.isfinite(x).all(1)
        if n := int(fine.sum()):
            yield Block(batch.column(0).filter(pa.array(fine)), integers(x[fine], scale), np.full(n, -1), np.full(n, np.inf), np.zeros(n))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x - c
    return (d * d).sum(1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def root(v: int) -> float:
    half = math.isqrt(v)
    return math.sqrt(v) if v.bit_length() < 1000 else float(half) if half.bit_length() < 1023 else math.inf


def roots(squared: np.ndarray) -> np.ndarray:
    return np.array([root(int(v)) for v in squared], float) if squared.dtype == object else np.sqrt(squared.astype(float))


def centres(c: np.ndarray, before: np.ndarray | None = None) -> Centres:
    k = len(c)
    apart = np.array([roots(squares(c, row)) for row in c]).reshape(k, k)
    np.fill_diagonal(apart, -1.0)  # itself first, before others at the same place
    order = np.argsort(apart, axis=1, kind="stable")
    moved = np.zeros(k) if before is None else np.array([roots(squares(row[None], old))[0] for row, old in zip(c, before)])
    return Centres(c, order, np.take_along_axis(apart, order, 1), moved)


def assigned(block: Block, to: Centres) -> Block:
    """The block with each vector's nearest centroid, of equal ones the smallest, and new bounds."""
    k, x, at = len(to.c), block.x, block.at.copy()
    next_ = np.minimum(to.apart[:, 1], sys.float_info.max) if k > 1 else np.zeros(1)
    if at.size and at[0] < 0:
        at[:] = 0
        upper, lower, todo = block.upper.copy(), block.lower.copy(), np.arange(len(at))
    else:
        far = np.argsort(to.moved)[::-1][:2]
        others = np.where(at == far[0], to.moved[far[-1]], to.moved[far[0]])
        upper = (block.upper + to.moved[at]) * (1 + SLACK)
        lower = np.maximum(0, block.lower * (1 - SLACK) - others * (1 + SLACK))
        limit = np.maximum(lower, next_[at] / 2 * (1 - SLACK))
        todo = np.flatnonzero(upper >= limit)
        for a in np.unique(at[todo]):
            mine = todo[at[todo] == a]
            upper[mine] = roots(squares(x[mine], to.c[a])) * (1 + SLACK)
        todo = todo[upper[todo] >= limit[todo]]
    was = at.copy()
    for a in np.unique(was[todo]):
        mine = todo[was[todo] == a]
        best, name, second = squares(x[mine], to.c[a]), np.full(len(mine), a), np.full(len(mine), sys.float_info.max)
        radius = (2 * roots(best) + next_[a]) * (1 + 4 * SLACK)
        inside = np.searchsorted(to.apart[a], radius, side="right")  # itself and the next at least
        for j in range(1, int(inside.max())):
            rows, other = np.flatnonzero(inside > j), to.order[a, j]
            d, own = squares(x[mine[rows]], to.c[other]), best[rows]
            wins = (d < own) | (d == own) & (other < name[rows])
            second[rows] = np.minimum(second[rows], roots(np.where(wins, own, d)))
            best[rows], name[rows] = np.where(wins, d, own), np.where(wins, other, name[rows])
        at[mine], upper[mine], lower[mine] = name, roots(best) * (1 + SLACK), second * (1 - SLACK)
    return Block(block.ids, x, at, upper, lower)


Sums = dict[int, tuple[int, list[int]]]


def added(a: Sums, b: Sums) -> Sums:
    """Counts and sums by cluster, in Python's integers."""
    out = dict(a)
    for i, (n, values) in b.items():
        m, mine = out.get(i, (0, [0] * len(values)))
        out[i] = (m + n, [p + q for p, q in zip(mine, values)])
    return out


def sums(block: Block) -> Sums:
    return {int(a): (int((mine := block.at == a).sum()), [int(v) for v in block.x[mine].sum(0)]) for a in np.unique(block.at)}


def inertias(block: Block, to: Centres) -> Sums:
    return {int(a): (0, [sum(squares(block.x[block.at == a], to.c[a]).tolist())]) for a in np.unique(block.at)}


def total(blocks: RDD, of: Callable[[Block], Sums]) -> Sums:
    return blocks.treeAggregate({}, lambda acc, block: added(acc, of(block)), added, depth=3)


def first_centres(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The k vectors whose seed:id has the least hash, in its order."""
    fine = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is the greatest of all
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    top = vectors.where(fine).orderBy(digest, "x").limit(k).select("x").collect()
    return integers(np.array([r["x"] for r in top], float).reshape(len(top), dims), scale)


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that counts.

    Components are floor(scale * x). The centroids start as first_centres(); each round assigns every vector and moves
    each centroid that has vectors to the floor of their mean. Then vectors are assigned once more.
    """
    if not 0 < k <= MAX_CLUSTERS or not 0 < dims <= MAX_DIMS:
        raise ValueError(f"k up to {MAX_CLUSTERS} and dims up to {MAX_DIMS}")
    spark, kind = vectors.sparkSession, vectors.schema[vec_id].dataType.simpleString()
    ship(spark)
    thin = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("x")).where(F.size("x") == dims)
    c, before = first_centres(thin, k, seed, dims, scale), None
    blobs = thin.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [pickle.dumps(b)]}) for b in packed(batches, dims, scale)), "b binary")
    blocks = blobs.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def moved(blocks: RDD, to: Centres) -> RDD:
        sent = spark.sparkContext.broadcast(to)  # MAX_CLUSTERS bounds it
        return blocks.map(lambda block: assigned(block, sent.value)).persist(StorageLevel.MEMORY_AND_DISK)

    for _ in range(rounds):
        blocks, last = moved(blocks, centres(c, before)), blocks
        found = total(blocks, sums)
        last.unpersist()
        before = c
        c = whole([[v // found[i][0] for v in found[i][1]] if i in found else old.tolist() for i, old in enumerate(c)], dims)
        if (c == before).all():
            break
    to = centres(c, before)
    blocks = moved(blocks, to)
    spread = {i: v[0] for i, (_, v) in total(blocks, lambda block: inertias(block, to)).items()}
    fits = lambda v: v if v <= LONG else None
    names = [hashlib.sha256(",".join(str(v) for v in row.tolist()).encode()).hexdigest() for row in c]
    all_, own = fits(sum(spread.values())), {i: fits(v) for i, v in spread.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (pickle.loads(b) for batch in batches for b in batch.column(0).to_pylist()):
            at, distance = block.at.tolist(), np.zeros(len(block.at), object)
            for a in set(at):
                mine = np.flatnonzero(block.at == a)
                distance[mine] = [fits(v) for v in squares(block.x[mine], to.c[a]).tolist()]
            columns = [block.ids, pa.array(at, pa.int32()), pa.array(distance.tolist(), pa.int64()), pa.array([own[a] for a in at], pa.int64()), pa.array([all_] * len(at), pa.int64()), pa.array([names[a] for a in at])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    done = spark.createDataFrame(blocks.map(lambda b: (bytearray(pickle.dumps(b)),)), "b binary", verifySchema=False)
    return done.mapInArrow(rows, f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_sql() -> str:
    """The rounds written out, each from all distances."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::HUGEINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, 'null')), x)::INTEGER - 1 AS j, x AS c FROM v"
        " ORDER BY j LIMIT 8)",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'j': j}}) AS m FROM (SELECT r, vec_id, x, j, {distance} AS d FROM v, c{t}) GROUP BY r)")
        if t < ROUNDS:
            steps.append(
                f"c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(n.c, c{t}.c) AS c FROM c{t} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM"
                f" (SELECT m.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) g(i) GROUP BY 1, 2) GROUP BY j) n ON n.j = c{t}.j)"
            )
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m.j AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON c{last}.j = m.j"""
    )


OP11_SQL = op11_sql()
