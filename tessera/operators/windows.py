"""Returns and rolling, expanding and weekly operators over (ticker, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.align import before, by_date


def frame(n: int):
    return by_date().rowsBetween(1 - n, 0)


def gated(value: Column, column: str, n: int, least: int | None = None) -> Column:
    """A rolling value where the frame of n rows has enough values of column, else null."""
    return F.when(F.count(column).over(frame(n)) >= (n if least is None else least), value)


def rolling_mean(column: str, n: int, least: int | None = None) -> Column:
    return gated(F.avg(column).over(frame(n)), column, n, least)


def rolling_std(column: str, n: int, least: int | None = None) -> Column:
    return gated(F.stddev_samp(column).over(frame(n)), column, n, least)


def simple_returns(rows: DataFrame, price: str = "adj_close", carry: bool = True) -> DataFrame:
    """ticker, date, ret; gaps in the returns are filled forward if carry."""
    raw = rows.select("ticker", "date", (F.try_divide(F.col(price), F.lag(price).over(by_date())) - 1).alias("ret"))
    return raw.withColumn("ret", F.last("ret", True).over(before())) if carry else raw


def log_returns(rows: DataFrame, price: str = "adj_close") -> DataFrame:
    x = F.when(F.col(price) > 0, F.ln(price))
    return rows.select("ticker", "date", x.alias("_x")).select("ticker", "date", (F.col("_x") - F.lag("_x").over(by_date())).alias("ret"))


def cumulative(returns: DataFrame) -> DataFrame:
    """cum: the running product of 1 + ret."""
    return returns.withColumn("cum", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(before()))


def drawdowns(returns: DataFrame) -> DataFrame:
    cum = cumulative(returns.where("ret is not null"))
    return cum.withColumn("peak", F.max("cum").over(before())).withColumn("drawdown", (F.col("cum") - F.col("peak")) / F.col("peak"))


def zscore(rows: DataFrame, column: str, n: int, least: int | None = None, small: float = 0.0) -> DataFrame:
    """z by rolling mean and sample deviation; a deviation of 0 gives null unless small is added to it."""
    sd = rolling_std(column, n, least)
    return rows.withColumn("z", F.try_divide(F.col(column) - rolling_mean(column, n, least), sd + small))


def weekly_last(returns: DataFrame) -> DataFrame:
    """The last value of each week, which is labelled by the Sunday that ends it."""
    week = F.next_day(F.date_sub("date", 1), "Sun")
    return returns.groupBy("ticker", week.alias("date")).agg(F.max_by("ret", "date").alias("ret"))


def latest_volatility(returns: DataFrame, n: int = 30, least: int | None = 5) -> DataFrame:
    """One row: the mean over tickers of the rolling deviation on the last date."""
    by_date = returns.withColumn("v", rolling_std("ret", n, least)).groupBy("date").agg(F.avg("v").alias("v"))
    return by_date.agg(F.max_by("v", "date").alias("vol"))


def crash_candidates(prices: DataFrame, lookback: int = 90, crash: int = 30, cut: float = 0.99) -> DataFrame:
    """ticker, drop from the rolling high on its last row, and rise over the look-back; flagged where both are beyond the cut."""
    x = F.col("adj_close")
    rows = prices.withColumn("down", x / gated(F.max("adj_close").over(frame(crash)), "adj_close", crash) - 1).withColumn("up", F.try_divide(x, F.lag(x, lookback).over(by_date())))
    last = rows.groupBy("ticker").agg(F.max_by("down", "date").alias("drawdown"), F.max("up").alias("rise"))
    limit = last.agg(F.percentile("rise", F.lit(cut)).alias("limit"))
    return last.join(F.broadcast(limit)).select("ticker", "drawdown", "rise", (F.col("rise") >= F.col("limit")).alias("flagged"))  # one row
