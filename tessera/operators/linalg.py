"""Covariances, correlations and distances as tables of pairs (a, b, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.functions.staging import staged


#: Tickers of a block and dates of a slice: a task holds 2 * BLOCK * DATES doubles.
BLOCK, DATES = 256, 8192
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sqq")


def products(returns: DataFrame) -> DataFrame:
    """a, b (a up to b) and, over the dates that both have, n and the sums of x, y, xx, yy, xy and xxyy.

    Tickers are dealt into blocks, and a task multiplies the matrices of two blocks over a slice of dates; a row is
    sent once for each block, and the sums are added up afterwards. x and y are returns less the ticker's mean.
    """
    ship(returns.sparkSession)
    rows = returns.where("ret is not null").select("date", "ticker", "ret")
    size = rows.agg(F.approx_count_distinct("ticker"), F.approx_count_distinct("date")).first()
    nb, nd = (max(1, -(-int(k) // m)) for k, m in zip(size, (BLOCK, DATES)))
    mine, other = F.pmod(F.hash("ticker"), F.lit(nb)), F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    centred = rows.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy("ticker"))).withColumn("mine", mine).withColumn("other", other)
    dealt = centred.select(F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.pmod(F.hash("date"), F.lit(nd)).alias("part"), "mine", "date", "ticker", "ret")

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        day, at = np.unique(part["date"].to_numpy(), return_inverse=True)
        lo, hi, out = part["lo"].iloc[0], part["hi"].iloc[0], []
        for block in (lo, hi):
            own = (part["mine"] == block).to_numpy()
            names, column = np.unique(part["ticker"].to_numpy()[own].astype(str), return_inverse=True)
            x, m = np.zeros((len(day), len(names))), np.zeros((len(day), len(names)))
            x[at[own], column], m[at[own], column] = part["ret"].to_numpy()[own], 1.0
            out.append((names, x, m))
        (a, x, m), (b, y, k) = out
        sums = [m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y, (x * x).T @ (y * y)]
        i, j = np.nonzero((a[:, None] <= b) & (sums[0] > 0)) if lo == hi else np.nonzero(sums[0] > 0)
        flip = a[i] > b[j]
        made = {"a": np.where(flip, b[j], a[i]), "b": np.where(flip, a[i], b[j])}
        values = dict(zip(SUMS, (s[i, j] for s in sums)))
        for u, v in (("sx", "sy"), ("sxx", "syy")):
            values[u], values[v] = np.where(flip, values[v], values[u]), np.where(flip, values[u], values[v])
        return pd.DataFrame(made | values)

    parts = dealt.groupBy("lo", "hi", "part").applyInPandas(multiply, "a string, b string, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in SUMS)) if nd > 1 else parts


def moment() -> Column:
    """The sum of products about the means of a pair of products()."""
    return F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")


def correlations(returns: DataFrame, absolute: bool = True) -> DataFrame:
    """Pearson, over the dates that both have; null without spread."""
    spread = lambda xx, x: F.col(xx) - F.col(x) * F.col(x) / F.col("n")
    both = spread("sxx", "sx") * spread("syy", "sy")
    c = F.when(both > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moment() / F.sqrt(both))))
    return products(returns).where("a < b").select("a", "b", (F.abs(c) if absolute else c).alias("value"))


def covariances(returns: DataFrame, sample: bool = True) -> DataFrame:
    return products(returns).select("a", "b", F.try_divide(moment(), F.col("n") - (1 if sample else 0)).alias("value"))


def correlation_matrix(returns: DataFrame, threshold: int = 50, absolute: bool = True) -> DataFrame:
    """correlations(), but from shrunk covariances (with their signs) where there are more tickers than threshold."""
    if returns.select("ticker").distinct().count() <= threshold:
        return correlations(returns, absolute)
    return as_correlation(shrunk(returns).select("a", "b", "value")).where("a < b")


def distances(corr: DataFrame, rescaled: bool = False) -> DataFrame:
    """Correlations of pairs to distances; rescaled, the least becomes 0 and the greatest 1 unless all are equal (a diagonal of 0.5 counts)."""
    rows = corr.select("a", "b", distance(F.col("value")).alias("value"))
    if not rescaled:
        return rows
    ends = rows.agg(F.least(F.min("value"), F.lit(0.5)).alias("lo"), F.greatest(F.max("value"), F.lit(0.5)).alias("hi"))
    joined = rows.join(F.broadcast(ends))  # one row
    return joined.select("a", "b", F.when(F.col("hi") - F.col("lo") > 1e-8, (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value")).alias("value"))


def as_correlation(cov: DataFrame) -> DataFrame:
    """Covariances of pairs to correlations, kept within -1 and 1."""
    own = cov.where("a = b").select(F.col("a").alias("t"), F.sqrt("value").alias("s"))
    joined = cov.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    r = F.try_divide(F.col("value"), F.col("sa") * F.col("sb"))
    return joined.select("a", "b", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("value"))


def shrunk(returns: DataFrame) -> DataFrame:
    """Ledoit-Wolf covariance of complete rows, with its shrinkage, all from sums over dates and pairs."""
    n = returns.select("ticker").distinct().count()
    full = returns.where("ret is not null").groupBy("date").agg(F.count("*").alias("k")).where(F.col("k") == n).select("date")
    rows = returns.join(full, "date", "left_semi")
    sums = products(rows.select("date", "ticker", "ret")).select("a", "b", (F.col("sxy") / F.col("n")).alias("s"), (F.col("sqq") / F.col("n")).alias("q"), F.col("n").alias("t"))
    sums = staged(sums)
    both = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    whole = sums.agg(
        (F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))) / n).alias("mu"), F.sum(both * F.col("s") * F.col("s")).alias("s2"), F.sum(both * F.col("q")).alias("q2"), F.max("t").alias("big")
    )
    delta = (F.col("s2") - n * F.col("mu") * F.col("mu")) / n
    beta = F.least(delta, (F.col("q2") - F.col("s2")) / (n * F.col("big")))
    joined = sums.join(F.broadcast(whole.withColumn("shrinkage", F.coalesce(F.try_divide(beta, delta), F.lit(0.0)))))  # one row
    s = F.col("shrinkage")
    return joined.select("a", "b", ((1 - s) * F.col("s") + F.when(F.col("a") == F.col("b"), s * F.col("mu")).otherwise(0.0)).alias("value"), "shrinkage")


def distance(c: Column) -> Column:
    return (1 - c) / 2


def affinity(c: Column) -> Column:
    return (c + 1) / 2


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    joined = cov.join(weights.toDF("a", "wa"), "a").join(weights.toDF("b", "wb"), "b")
    return joined.agg(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("wa") * F.col("wb") * F.col("value")).alias("variance"))
