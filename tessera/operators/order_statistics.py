"""Rolling median and median absolute deviation by a window that stays sorted.

A series is cut into slices by place; the rows that a slice's first windows reach back to are sent along with it. In a
slice one sorted window moves on row by row: a value goes in, another out. The values nearest to the median are a
contiguous run of it, so the deviation of any rank is found by bisection, whatever the size of the window.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.shipping import ship

#: Rows of a slice at least; it has REACH windows' worth of rows if that is more.
SLICE, REACH = 8192, 8


def nearest(s: list[float], m: float, k: int) -> float:
    """The k-th smallest distance of sorted values to m."""
    a, b = 0, len(s) - k
    while a < b:
        mid = (a + b) // 2
        if m - s[mid] > s[mid + k] - m:
            a = mid + 1
        else:
            b = mid
    return max(m - s[a], s[a + k - 1] - m)


def middles(s: list[float]) -> tuple[float, float]:
    """Median of sorted values and the median of their distances to it."""
    n = len(s)
    m = s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    return m, nearest(s, m, n // 2 + 1) if n % 2 else (nearest(s, m, n // 2) + nearest(s, m, n // 2 + 1)) / 2


def scores(values: list[float | None], n: int, scale: float) -> list[float | None]:
    """(value - median) * scale / deviation over the last n values to each; None where one is missing or all are near the median."""
    window: list[float] = []
    out, missing = [], 0
    for i, x in enumerate(values):
        if i >= n:
            if (old := values[i - n]) is None:
                missing -= 1
            else:
                del window[bisect_left(window, old)]
        if x is None:
            missing += 1
        else:
            insort(window, x)
        z = None
        if x is not None and not missing:
            m, mad = middles(window)
            z = (x - m) / (mad / scale) if mad / scale else None
        out.append(z)
    return out


def robust_zscore(rows: DataFrame, column: str, n: int, scale: float = 1.4826, key: str = "ticker", order: str = "date") -> DataFrame:
    """rows with z: column less its rolling median, by the rolling median absolute deviation / scale, over n rows or those there are.

    Null where the frame has a null or NaN, or no spread.
    """
    size = max(SLICE, REACH * n)
    line = Window.partitionBy(key).orderBy(order)
    rows = rows.drop("z")
    placed = rows.withColumn("_place", F.row_number().over(line) - 1)
    own = F.expr(f"_place div {size}")
    late = F.col("_place") % size > size - n  # the next slice's windows reach back to it
    sliced = placed.withColumn("_slice", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        values = [None if v is None or math.isnan(v) else v for v in table[column].cast(pa.float64()).to_pylist()]
        table = table.append_column("z", pa.array(scores(values, n, scale), pa.float64()))
        mine = pa.compute.greater_equal(table["_place"], table["_slice"][0].as_py() * size)
        return table.filter(mine).drop_columns(["_place", "_slice"])

    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("z", DoubleType())])
    return sliced.groupBy(key, "_slice").applyInArrow(run, schema)
