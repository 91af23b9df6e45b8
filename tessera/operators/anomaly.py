"""Anomaly flags of return series, and the filter that drops tickers with too many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import numerics
from tessera.functions.shipping import ship
from tessera.operators import metrics, windows
from tessera.operators.align import by_date


def whole() -> WindowSpec:
    return Window.partitionBy("ticker")


def fixed_z(returns: DataFrame, limit: float = 3.0) -> DataFrame:
    z = F.try_divide(F.col("ret") - F.avg("ret").over(whole()), F.stddev_samp("ret").over(whole()))
    return returns.withColumn("flag", F.coalesce(F.abs(z) > limit, F.lit(False)))


def features(returns: DataFrame) -> DataFrame:
    """ret, its absolute change (0 to 1) and its rolling z (-5 to 5)."""
    rows = windows.zscore(returns, "ret", 30, 5, 1e-8)
    change = F.abs(F.try_divide(F.col("ret"), F.lag("ret").over(by_date())) - 1)
    within = lambda c, low, high: F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c))).otherwise(0.0)  # noqa: E731  null is 0
    return rows.select("ticker", "date", "ret", within(change, 0.0, 1.0).alias("change"), within(F.col("z"), -5.0, 5.0).alias("z"))


def by_ticker(rows: DataFrame, detect) -> DataFrame:
    """rows with flag by detect(rows of one ticker, by date)."""
    ship(rows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        return part[["ticker", "date", "ret"]].assign(flag=detect(part))

    return rows.groupBy("ticker").applyInPandas(run, "ticker string, date date, ret double, flag boolean")


def forest_scores(part: pd.DataFrame) -> np.ndarray:
    x = part[["ret", "change", "z"]].to_numpy(float)
    sd = x.std(0)
    return numerics.isolation_scores((x - x.mean(0)) / np.where(sd > 0, sd, 1))


def forest_flags(score: np.ndarray, limit: float, deviation: float) -> np.ndarray:
    """Scores far below the median; a tenth of the rows if that finds few in a volatile series."""
    flags = score < np.median(score) - max(limit, 0.1) * score.std()
    return score < np.quantile(score, 0.1) if flags.mean() < 0.05 and deviation > 0.05 else flags


def isolation(returns: DataFrame, limit: float = 1.5) -> DataFrame:
    return by_ticker(features(returns.where("ret is not null")), lambda part: forest_flags(forest_scores(part), limit, part["ret"].to_numpy(float).std()))


#: Rows that a task filters at once, in whole tickers.
ROWS = 100_000


def whole_tickers(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(rows of many whole tickers, in order of ticker and date) for all tickers, about ROWS rows at a time."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= ROWS:
                part = pd.concat(held, ignore_index=True)
                done = (part["ticker"] != part["ticker"].iloc[-1]).to_numpy()
                if done.any():
                    yield work(part[done].reset_index(drop=True))
                held, n = [part[~done]], 0
        part = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(part):
            yield work(part)

    return rows.repartition("ticker").sortWithinPartitions("ticker", "date").mapInPandas(run, schema)


def kalman_ratios(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a column for each ticker) of the tickers with the same number of rows, and their residuals in rolling deviations of 30 rows."""
    ticker, ret = part["ticker"].to_numpy(), part["ret"].to_numpy(float)
    starts = np.flatnonzero(np.append(True, ticker[1:] != ticker[:-1]))
    sizes = np.diff(np.append(starts, len(part)))
    for n in np.unique(sizes):
        at = starts[sizes == n] + np.arange(n)[:, None]
        resid = pd.DataFrame(numerics.kalman_residuals(ret[at]))
        sd = resid.rolling(30, min_periods=10).std()
        yield at, (resid.abs() / sd.fillna(sd.mean())).fillna(0.0).to_numpy()


def kalman(returns: DataFrame, limit: float = 7.0) -> DataFrame:
    def detect(part: pd.DataFrame) -> pd.DataFrame:
        flag = np.zeros(len(part), bool)
        for at, ratio in kalman_ratios(part):
            flag[at] = ratio > limit
        return part[["ticker", "date", "ret"]].assign(flag=flag)

    rows = returns.where("ret is not null").select("ticker", "date", "ret")
    return whole_tickers(rows, detect, "ticker string, date date, ret double, flag boolean")


#: The limits that the threshold study tries, by detector.
STUDY = {"forest": (5.0, 8.0), "kalman": (5.0, 12.0), "z": (3.0, 10.0)}


def threshold_study(returns: DataFrame, method: str) -> DataFrame:
    """ticker, limit and fraction: the lowest limit, in steps of 0.1, with the least share of flags; a detector runs once for all limits."""
    low, high = STUDY[method]
    limits = [round(low + 0.1 * k, 1) for k in range(round((high - low) * 10) + 1)]
    if method == "z":
        return z_grid(returns, limits)
    ship(returns.sparkSession)
    rows = returns.where("ret is not null").select("ticker", "date", "ret")
    schema = "ticker string, limit double, fraction double"

    def filtered(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at, ratio in kalman_ratios(part):
            shares = np.array([(ratio > x).mean(0) for x in limits])
            k = shares.argmin(0)
            out.append(pd.DataFrame({"ticker": part["ticker"].to_numpy()[at[0]], "limit": np.array(limits)[k], "fraction": shares.min(0)}))
        return pd.concat(out)

    if method == "kalman":
        return whole_tickers(rows, filtered, schema)

    def tried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        score, sd = forest_scores(part), part["ret"].to_numpy(float).std()
        shares = [forest_flags(score, x, sd).mean() for x in limits]
        k = int(np.argmin(shares))
        return pd.DataFrame({"ticker": [part["ticker"].iloc[0]], "limit": [limits[k]], "fraction": [float(shares[k])]})

    return features(rows).groupBy("ticker").applyInPandas(tried, schema)


def study_score(flagged: DataFrame, kappa_weight: float = 0.8, stability: float = 0.2) -> DataFrame:
    """flagged(ticker, date, ret, flag) to the score of a detector's limit: kappa, less what is volatile, extreme or flagged, over volatility by its median."""
    rows = windows.zscore(flagged, "ret", 30, 5, 1e-8).withColumn("v", windows.rolling_std("ret", 30, 5))
    moved = rows.withColumn("change", F.abs(F.try_divide(F.col("ret"), F.lag("ret").over(by_date())) - 1))
    far = lambda c: F.percentile(c, F.lit(0.95))
    found = moved.groupBy("ticker").agg(
        F.coalesce(metrics.kappa(F.col("ret")), F.lit(0.0)).alias("k"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("v"), F.median("v").alias("m"),
        F.coalesce(far("change"), F.lit(0.0)).alias("c"), F.coalesce(far(F.abs(F.coalesce("z", F.lit(0.0)))), F.lit(0.0)).alias("z"), F.avg(F.col("flag").cast("double")).alias("fraction"),
    )
    middle = F.when(F.coalesce("m", F.lit(0.0)) == 0, 1.0).otherwise(F.col("m"))
    total = kappa_weight * F.col("k") - stability * 0.05 * F.col("v") - 0.5 * F.col("c") - 1.5 * F.col("z") - 10 * F.col("fraction")
    return found.select("ticker", "fraction", (total / (F.col("v") / middle + 1e-8)).alias("score"))


def spread_outlier(spread: DataFrame, contamination: float = 0.05) -> DataFrame:
    """spread(ticker, date, spread) to ticker and outlier: whether the last value is among the share with the lowest forest scores; one row alone isn't."""
    ship(spread.sparkSession)

    def last(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("date")["spread"].dropna().to_numpy(float)
        score = numerics.isolation_scores(x[:, None]) if len(x) > 1 else np.zeros(1)
        return pd.DataFrame({"ticker": [part["ticker"].iloc[0]], "outlier": [bool(len(x) > 1 and score[-1] < np.quantile(score, contamination))]})

    return spread.groupBy("ticker").applyInPandas(last, "ticker string, outlier boolean")


def flags(returns: DataFrame) -> DataFrame:
    """By the number of tickers: an isolation forest over 20, a Kalman filter over 5, else fixed z."""
    n = returns.select("ticker").distinct().count()
    return isolation(returns) if n > 20 else kalman(returns) if n > 5 else fixed_z(returns)


def keep_calm(flagged: DataFrame, most: float = 0.01) -> DataFrame:
    """ticker, fraction of the tickers whose share of flags is at most most."""
    return flagged.groupBy("ticker").agg(F.avg(F.col("flag").cast("double")).alias("fraction")).where(F.col("fraction") <= most)


def z_grid(returns: DataFrame, limits: list[float]) -> DataFrame:
    """The lowest limit with the least share of flags, for each ticker."""
    z = F.abs(F.try_divide(F.col("ret") - F.avg("ret").over(whole()), F.stddev_samp("ret").over(whole())))
    rows = returns.where("ret is not null").withColumn("a", z).withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    share = rows.groupBy("ticker", "limit").agg(F.avg(F.coalesce((F.col("a") > F.col("limit")).cast("double"), F.lit(0.0))).alias("fraction"))
    return share.groupBy("ticker").agg(F.min(F.struct("fraction", "limit")).alias("m")).select("ticker", "m.limit", "m.fraction")
