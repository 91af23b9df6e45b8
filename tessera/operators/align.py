"""Alignment, fills, set operations and removal of repeats on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def before() -> WindowSpec:
    """From a ticker's first row to the current one."""
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def densify(rows: DataFrame) -> DataFrame:
    """Every ticker on every date that any ticker has, nulls where it has none.

    The grid is built by giving each ticker the array of dates, so its size is that of the result.
    """
    dates = rows.agg(F.collect_set("date").alias("dates"))
    grid = rows.select("ticker").distinct().join(F.broadcast(dates)).select("ticker", F.explode("dates").alias("date"))  # one row: a calendar
    return grid.join(rows, ["ticker", "date"], "left")


def fill(rows: DataFrame, column: str) -> DataFrame:
    """Forward, then backward fill of a column: behind a ticker's first value there is one before, ahead of it the first is the next."""
    x, whole = F.col(column), by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(column, F.coalesce(F.last(x, True).over(before()), F.first(x, True).over(whole)))


def keep_one(rows: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One row for each (ticker, date): the first or last by order."""
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("ticker", "date").orderBy(by)))
    return numbered.where("_r = 1").drop("_r")


def overlap(rows: DataFrame, column: str = "adj_close") -> DataFrame:
    """The dates between the latest first and the earliest last valid date on which every ticker is there."""
    valid = rows.where(F.col(column).isNotNull())
    spans = valid.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    bounds = spans.agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("n"))
    inside = valid.join(F.broadcast(bounds)).where("date between a and b")  # one row
    full = inside.groupBy("date").agg(F.count("*").alias("_m"), F.first("n").alias("_n")).where("_m = _n").select("date")
    return inside.join(full, "date", "left_semi").drop("a", "b", "n")


def drop_sparse(rows: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """Tickers whose column isn't null on at least a share of all dates."""
    dates = rows.agg(F.count_distinct("date").alias("d"))
    enough = rows.groupBy("ticker").agg(F.count(column).alias("k")).join(F.broadcast(dates)).where(F.col("k") >= share * F.col("d")).select("ticker")  # one row
    return rows.join(enough, "ticker", "left_semi")


def reindex(rows: DataFrame, grid: DataFrame, on: list[str], column: str, fill_value: float = 0.0) -> DataFrame:
    return grid.join(rows, on, "left").withColumn(column, F.coalesce(column, F.lit(fill_value)))


def align_market(portfolio: DataFrame, market: DataFrame) -> DataFrame:
    """portfolio(date, p) and market(date, m): the market on the portfolio's dates, filled forward; dates before its first are left out."""
    joined = portfolio.join(market, "date", "left")
    return joined.withColumn("m", F.last("m", True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).where("m is not null")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left(ticker, date, ...) with the latest value of right at or before its date."""
    rows = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    both = rows.unionByName(right.select("ticker", "date", value, F.lit(0).alias("_side")), allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(order)).where("_side = 1").drop("_side")
