"""Connected components by alternating large-star and small-star.

Before each alternation every partition replaces its edges by stars of its own (a union-find over the
rows of that partition), so long chains shrink at once; partitions hold PART_EDGES edges, however many
there are. The stars then join what the partitions hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Edges that one task contracts: 16 MB and as much again for the union-find.
PART_EDGES = 1_000_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition to edges from each node to the least node of its component there."""
    parts = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:  # hook the greater root of each edge to the lesser, then shorten all paths
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), each once, to what a large-star or small-star makes of them.

    The least neighbours come from partial minima and are joined back, and a join splits a node with
    very many links between tasks.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    joined = around.join(least, F.col("u") == F.col("w")).withColumn("m", F.least("u", "m"))
    if large:
        made = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return made.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) of longs to (id, component): the least id that each linked one reaches; the others are left out."""
    edges = stage(links.where(F.col("u") != F.col("v")).select("u", "v"), "links")
    marks = lambda table: tuple(table.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    n = edges.count()
    while n:
        own = stage(edges.coalesce(-(-n // PART_EDGES)).mapInArrow(contract, "u long, v long"), "contracted")
        edges = stage(star(stage(star(own, True), "large"), False), "small")
        before, now = marks(own), marks(edges)
        if now == before:  # stars already
            break
        n = now[0]
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
