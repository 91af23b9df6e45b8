"""Weight algebra on (ticker, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def everywhere() -> WindowSpec:
    return Window.partitionBy(F.lit(0))


def normalize(weights: DataFrame, least: float = 0.0, digits: int = 3) -> DataFrame:
    """Weights of at least least in size (all, if none is), scaled to a sum of 1 and rounded half to even; a sum of 0 is an error."""
    total = lambda rows: rows.agg(F.count_if(F.abs("weight") >= least).alias("big"), F.sum("weight").alias("all"), F.sum(F.when(F.abs("weight") >= least, F.col("weight"))).alias("some"))
    joined = weights.join(F.broadcast(total(weights)))  # one row
    kept = joined.where((F.abs("weight") >= least) | (F.col("big") == 0))
    whole = F.when(F.col("big") == 0, F.col("all")).otherwise(F.col("some"))
    checked = F.when(whole == 0, F.raise_error(F.lit("the weights sum to 0")).cast("double")).otherwise(whole)
    return kept.select("ticker", F.bround(F.col("weight") / checked, digits).alias("weight"))


def stack(portfolios: DataFrame, period_weights: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """portfolios(portfolio, ticker, weight) to their mean; a missing ticker counts as 0; period_weights(portfolio, p) weighs them."""
    if period_weights is None:
        period_weights = portfolios.select("portfolio").distinct().withColumn("p", F.lit(1.0))
    whole = period_weights.agg(F.sum("p").alias("all"))
    summed = portfolios.join(period_weights, "portfolio").groupBy("ticker").agg(F.sum(F.col("weight") * F.col("p")).alias("w"))
    return summed.join(F.broadcast(whole)).select("ticker", F.bround(F.col("w") / F.col("all"), digits).alias("weight"))  # one row


def largest(weights: DataFrame, n: int) -> DataFrame:
    """The n largest, as they are."""
    return weights.orderBy(F.desc("weight"), "ticker").limit(n)


def limit_size(weights: DataFrame, n: int, target: float = 1.0) -> DataFrame:
    """The n largest in size, scaled to the target sum."""
    top = weights.orderBy(F.desc(F.abs("weight")), "ticker").limit(n)
    return top.withColumn("weight", F.col("weight") * target / F.sum("weight").over(everywhere()))


def inverse_volatility(returns: DataFrame) -> DataFrame:
    s = returns.groupBy("ticker").agg(F.coalesce(F.nullif(F.stddev_samp("ret"), F.lit(0.0)), F.lit(1e-6)).alias("s"))
    return s.select("ticker", ((1 / F.col("s")) / F.sum(1 / F.col("s")).over(everywhere())).alias("weight"))


def kelly(returns: DataFrame) -> DataFrame:
    """Mean over variance, scaled to a sum of 1; zero variance gives 0, and so does a zero sum."""
    raw = returns.groupBy("ticker").agg(F.coalesce(F.try_divide(F.avg("ret"), F.var_samp("ret")), F.lit(0.0)).alias("k"))
    return raw.select("ticker", F.coalesce(F.try_divide(F.col("k"), F.sum("k").over(everywhere())), F.lit(0.0)).alias("weight"))


def best_of_clusters(scores: DataFrame) -> DataFrame:
    """scores(ticker, cluster, score): all noise (-1) and small clusters; the better half from 10 tickers on, a third from 20."""
    by = Window.partitionBy("cluster")
    ranked = scores.withColumn("i", F.row_number().over(by.orderBy(F.desc_nulls_last("score"), "ticker"))).withColumn("n", F.count("*").over(by))
    n = F.col("n")
    keep = F.when((F.col("cluster") == -1) | (n < 10), n).when(n < 20, F.floor(0.5 * n)).otherwise(F.floor(0.33 * n))
    return ranked.where(F.col("i") <= F.greatest(keep, F.lit(1))).select("ticker", "cluster", "score")


def adaptive(base: DataFrame, target: DataFrame, volatility: float, alpha: float = 0.2, short: bool = False) -> DataFrame:
    """base tilted to target by alpha / (1 + volatility); a zero base stays 0."""
    a = alpha / (1 + max(volatility, 1e-6))
    joined = target.select("ticker", F.col("weight").alias("r")).join(base, "ticker", "left").na.fill(0.0, ["weight"])
    tilted = F.col("weight") * (1 + F.coalesce(a * (F.try_divide(F.col("r"), F.col("weight")) - 1), F.lit(0.0)))
    moved = joined.select("ticker", (tilted if short else F.greatest(tilted, F.lit(0.0))).alias("w"))
    whole = F.sum("w").over(everywhere())
    return moved.select("ticker", F.when(whole > 0, F.col("w") / whole).otherwise(F.col("w")).alias("weight"))


def distribute(weights: DataFrame, basket: float, hedge: DataFrame) -> DataFrame:
    """weights plus basket times the hedge ratios(ticker, ratio)."""
    return weights.join(hedge, "ticker", "full").select("ticker", (F.coalesce("weight", F.lit(0.0)) + basket * F.coalesce("ratio", F.lit(0.0))).alias("weight"))
