"""Risk and return metrics of (ticker, date, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import staged
from tessera.operators.windows import drawdowns

DAYS = 252
#: The weights of the metrics under each objective.
METRICS = ("cumulative_return", "sharpe", "kappa", "omega", "min_vol_tail")
OBJECTIVES = {
    "min_vol_tail": (0, 0, 0, 0, 1),
    "kappa": (0, 0, 1, 0, 0),
    "omega": (0, 0, 0, 1, 0),
    "sk_mix": (0, 0.5, 0.5, 0, 0),
    "so_mix": (0, 0.5, 0, 0.5, 0),
    "sharpe": (0, 1, 0, 0, 0),
    "aggro": (1 / 3, 1 / 3, 1 / 3, 0, 0),
    "yolo": (0.5, 0.5, 0, 0, 0),
}


def sharpe(x: Column, risk_free: float = 0.0, entries: int = DAYS) -> Column:
    """Mean excess over annualised deviation; null without spread."""
    return F.try_divide(F.avg(x) - risk_free, F.stddev_samp(x) * F.sqrt(F.lit(float(entries))))


def kappa(x: Column, order: int = 3, mar: float = 0.0) -> Column:
    """Mean excess over the root of the mean power of shortfalls, over rows that fall short."""
    d = x - mar
    return F.try_divide(F.avg(d), F.pow(F.avg(F.when(d < 0, F.pow(-d, F.lit(float(order))))), F.lit(1.0 / order)))


def lpm(x: Column, target: float = 0.0, order: int = 3) -> Column:
    """Lower partial moment over all rows."""
    return F.avg(F.pow(F.greatest(target - x, F.lit(0.0)), F.lit(float(order))))


def volatility(x: Column, entries: int = DAYS) -> Column:
    return F.stddev_samp(x) * F.sqrt(F.lit(float(entries)))


def omega(returns: DataFrame, threshold: float = 0.0, least: int = 5, trim: float = 0.1) -> DataFrame:
    """Trimmed mean of gains over that of losses, for tickers with enough of both."""
    side = F.when(F.col("ret") > threshold, 1).when(F.col("ret") < threshold, -1)
    rows = returns.withColumn("side", side).where("side is not null")
    by = Window.partitionBy("ticker", "side")
    ranked = rows.withColumn("i", F.row_number().over(by.orderBy("ret"))).withColumn("n", F.count("*").over(by))
    cut = F.floor(F.col("n") * trim)
    inner = ranked.where((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut) & (F.col("n") >= least))
    sides = inner.groupBy("ticker").agg(F.avg(F.when(F.col("side") == 1, F.col("ret"))).alias("gain"), F.avg(F.when(F.col("side") == -1, F.col("ret"))).alias("loss"))
    return sides.select("ticker", (F.col("gain") / F.when(F.col("loss").isNotNull(), F.greatest(-F.col("loss"), F.lit(1e-8)))).alias("omega"))


def cvar(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean of the ceil(alpha n) least returns; null if that is none or all of them."""
    by = Window.partitionBy("ticker")
    ranked = returns.where("ret is not null").withColumn("i", F.row_number().over(by.orderBy("ret"))).withColumn("n", F.count("*").over(by))
    k = F.ceil(alpha * F.col("n"))
    return ranked.groupBy("ticker").agg(F.avg(F.when((F.col("i") <= k) & (k < F.col("n")), F.col("ret"))).alias("cvar"))


def composite(returns: DataFrame, objective: str, risk_free: float = 0.0) -> DataFrame:
    """The weighted score of every ticker: metrics by objective, a tail penalty, and twice any loss."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {sorted(OBJECTIVES)}")
    weights = dict(zip(METRICS, OBJECTIVES[objective]))
    x = F.col("ret")
    base = returns.where("ret is not null").groupBy("ticker").agg(
        (F.product(1 + x) - 1).alias("cumulative_return"), sharpe(x, risk_free).alias("sharpe"), kappa(x).alias("kappa"), F.stddev_samp(x).alias("vol")
    )
    joined = base.join(omega(returns), "ticker", "left") if weights["omega"] else base
    if weights["min_vol_tail"]:
        joined = joined.join(cvar(returns), "ticker", "left").withColumn("min_vol_tail", F.col("cvar") - F.col("vol"))
    total = F.lit(0.0)
    for name, w in weights.items():
        if w:
            total = total + w * F.col(name)
    loss = F.when(F.col("cumulative_return") < 0, 2 * F.abs("cumulative_return")).otherwise(0.0)
    return joined.select("ticker", (total - loss).alias("score"))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret: weights are scaled on every date to the tickers that have a return."""
    joined = returns.where("ret is not null").join(weights, "ticker")
    return joined.groupBy("date").agg(F.try_divide(F.sum(F.col("weight") * F.col("ret")), F.sum("weight")).alias("ret"))


def contributions(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Shares (in percent) of weighted cumulative return and of weighted deviation."""
    x = returns.where("ret is not null").groupBy("ticker").agg((F.product(1 + F.col("ret")) - 1).alias("c"), F.stddev_samp("ret").alias("s")).join(weights, "ticker")
    whole = x.agg(F.sum(F.col("weight") * F.col("c")).alias("tc"), F.sum(F.col("weight") * F.col("s")).alias("ts"))
    joined = x.join(F.broadcast(whole))  # one row
    return joined.select("ticker", (100 * F.try_divide(F.col("weight") * F.col("c"), F.col("tc"))).alias("return_pct"), (100 * F.try_divide(F.col("weight") * F.col("s"), F.col("ts"))).alias("risk_pct"))


def box_stats(returns: DataFrame) -> DataFrame:
    """Quartiles, extremes and the sorted values beyond 1.5 interquartile ranges."""
    q = returns.groupBy("ticker").agg(*(F.percentile("ret", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = (F.col("ret") < F.col("q1") - reach) | (F.col("ret") > F.col("q3") + reach)
    joined = returns.join(q, "ticker")
    return joined.groupBy("ticker", "q1", "median", "q3", "lo", "hi").agg(F.array_sort(F.collect_list(F.when(far, F.col("ret")))).alias("outliers"))


def alpha(portfolio: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """portfolio(date, p, m) to the intercept of p on m, both in excess of the risk-free rate; 0 if there are no rows."""
    return portfolio.agg(F.coalesce(F.regr_intercept(F.col("p") - risk_free, F.col("m") - risk_free), F.lit(0.0)).alias("alpha"))


def report(portfolio: DataFrame, market: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """portfolio(date, ret) and market(date, m) to one row of Sharpe, kappa, volatility, drawdown, time under water, alpha and total.

    The portfolio, a row for each date, is computed once.
    """
    portfolio = staged(portfolio.select("date", "ret"))
    one = portfolio.withColumn("ticker", F.lit("portfolio"))
    x = F.col("ret")
    first = one.agg(sharpe(x, risk_free).alias("sharpe"), kappa(x).alias("kappa"), volatility(x).alias("volatility"), ((F.product(1 + x) - 1) * 100).alias("total_pct"))
    deep = drawdowns(one).agg(F.min("drawdown").alias("max_drawdown"), F.count_if(F.col("cum") < F.col("peak")).alias("under_water"))
    aligned = portfolio.join(market, "date").select(F.col("ret").alias("p"), "m")
    return first.join(deep).join(alpha(aligned, risk_free).select((100 * F.col("alpha")).alias("alpha_pct")))  # three single rows
