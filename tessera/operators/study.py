"""Studies: the best cell of a grid for each group, by whole scores or by successive halving, then points between the grid's.

rows(by, date, ...) are a group's series, a cell is a struct of doubles, and score(rows with a column cells, an array of
a group's cells) gives by, the cell's fields, score and what else is known of the cell; a cell may be missing. A round scores
the live cells of all groups in one job. Cells of a group are as many as the grid has, so they travel in one row.

With shares of (1.0,) every cell is scored on all dates, and refinement keeps the best so far, so that its answer
is never worse than the grid's. More shares halve: a round scores the live cells on the rows up to that share of the time and keeps
the best part of them, which costs less but may lose the best cell; nothing does so unless it is asked to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.staging import staged


class Axis(NamedTuple):
    """A field of the cells: its range, and the distance of the grid's points."""

    name: str
    low: float
    high: float
    step: float


#: Scores that agree to so many decimals are equal: cells with the same trades may be summed in another order.
DECIMALS = 10


def known(score: str = "score") -> Column:
    """The score, or null where it isn't a number."""
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))


def rank() -> Column:
    """What cells are ordered by: the highest score first, those without one last."""
    return -F.coalesce(F.round(known(), DECIMALS), F.lit(float("-inf")))


def top(scores: DataFrame, by: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """The row of the highest score of each group; of equal ones the first by prefer; a cell without a score comes last."""
    ranked = scores.withColumn("_s", rank())
    rest = [c for c in scores.columns if c not in by]
    found = ranked.groupBy(*by).agg(F.min(F.struct("_s", *(p.alias(f"_p{i}") for i, p in enumerate(prefer)), *rest)).alias("m"))
    return found.select(*by, *(F.col(f"m.{c}").alias(c) for c in rest))


def until(rows: DataFrame, share: float) -> DataFrame:
    """The rows up to a share of the time from the first date to the last."""
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    return rows if first is None else rows.where(F.col("date") <= F.lit(first + (last - first) * share))


def halved(cells: DataFrame, scores: DataFrame, by: Sequence[str], names: Sequence[str], prefer: Sequence[Column], keep: float) -> DataFrame:
    """cells(by, cells) with the best part of each group's cells, one at least; cells without a score come last, by prefer."""
    each = cells.select(*by, F.explode("cells").alias("_c")).select(*by, *(F.col(f"_c.{n}").alias(n) for n in names))
    on = [*by, *names]
    joined = each.join(scores.select(*on, rank().alias("_k")), on, "left")
    order = F.struct(F.coalesce("_k", F.lit(float("inf"))).alias("s"), *(p.alias(f"p{i}") for i, p in enumerate(prefer)), F.struct(*names).alias("c"))
    sorted_ = joined.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("a"))
    return sorted_.select(*by, F.expr(f"slice(a, 1, cast(greatest(1, ceil(size(a) * {keep!r}D)) AS int)).c").alias("cells"))


def around(best: DataFrame, by: Sequence[str], axes: Sequence[Axis], scale: float, reach: int) -> DataFrame:
    """by and cells: the points up to reach steps of the scaled distance from a group's best along all axes, inside their ranges, without the best itself."""
    grid = best
    for axis in axes:
        points = [F.greatest(F.lit(axis.low), F.least(F.lit(axis.high), F.col(axis.name) + k * axis.step * scale)) for k in range(-reach, reach + 1)]
        grid = grid.withColumn(f"_x_{axis.name}", F.explode(F.array_distinct(F.array(*points))))
    moved = " OR ".join(f"_x_{a.name} <> {a.name}" for a in axes)
    cell = F.struct(*(F.col(f"_x_{a.name}").alias(a.name) for a in axes))
    return grid.where(moved).groupBy(*by).agg(F.collect_list(cell).alias("cells"))


def search(
    rows: DataFrame,
    by: Sequence[str],
    grid: Column,
    axes: Sequence[Axis],
    score: Callable[[DataFrame], DataFrame],
    prefer: Sequence[Column],
    shares: Sequence[float] = (1.0,),
    keep: float = 1 / 3,
    rounds: int = 0,
    reach: int = 1,
) -> DataFrame:
    """The best cell of each group that has one, with its score and what else is known of it.

    grid is the array of all cells. Each round of refinement divides the distance of the points by reach + 1. Groups
    without any scored cell are left out; an empty table gives an empty result.
    """
    if not shares or list(shares) != sorted(shares) or shares[0] <= 0 or shares[-1] != 1.0:
        raise ValueError("shares must rise to 1")
    if not 0 < keep <= 1 or rounds < 0 or reach < 1:
        raise ValueError("keep is a share, rounds and reach are whole numbers from 0 and 1 on")
    by, names = list(by), [a.name for a in axes]
    if len(shares) > 1 or rounds:
        rows = staged(rows)
    scores = None
    if len(shares) == 1:
        scores = score(rows.withColumn("cells", grid))
    else:
        cells = staged(rows.select(*by).distinct().withColumn("cells", grid))
        for share in shares[:-1]:
            cells = staged(halved(cells, score(until(rows, share).join(cells, by)), by, names, prefer, keep))
        scores = score(rows.join(cells, by))
    best = top(scores, by, prefer)
    for k in range(rounds):
        best = staged(best)
        near = staged(around(best, by, axes, (reach + 1.0) ** -(k + 1), reach))
        best = top(best.unionByName(score(rows.join(near, by)).select(*best.columns)), by, prefer)
    return best
