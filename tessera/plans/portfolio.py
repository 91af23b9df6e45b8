"""Clustering, nested optimisation, baskets and the whole pipeline, composed of the operators."""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import caching, numerics
from tessera.functions.shipping import ship
from tessera.functions.staging import staged
from tessera.operators import align, anomaly, graph, kmeans, linalg, metrics, omega, panel, ratios, series_kmeans, signals, spectral, weights, windows
from tessera.sources import prices as price_sources
from tessera.sources import snapshots

@dataclass(frozen=True)
class Config:
    """What a run does. models: years of history to the names of the optimisers."""

    models: tuple[tuple[float, tuple[str, ...]], ...] = ((1.0, ("nested_clustering",)),)
    objective: str = "sharpe"
    min_weight: float = 0.01
    max_weight: float = 1.0
    max_size: int = 20
    risk_free: float = 0.0
    allow_short: bool = False
    use_anomaly_filter: bool = False
    use_decorrelation: bool = False
    use_reversion: bool = False
    reversion_type: str = "ou"
    visible_pct: float = 1.0
    benchmark: str | None = None
    cache_dir: str | None = None
    data_dir: str | None = None
    watchlists: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, given: dict) -> "Config":
        """From the fields of a configuration file; unknown ones are left out."""
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__}
        if isinstance(known.get("models"), dict):
            known["models"] = tuple((float(y), tuple(m)) for y, m in known["models"].items())
        return cls(**known)

    @classmethod
    def from_yaml(cls, path: str) -> "Config":
        """From a YAML (or JSON) file with the field names of FILE_FIELDS; its folders are made.

        A kind of reversion counts only where reversion is used, a visible share only in test mode.
        """
        with open(path) as given:
            text = given.read()
        try:
            import yaml

            fields = yaml.safe_load(text) or {}
        except ImportError:
            fields = json.loads(text)
        for name in ("data_dir", "input_files"):
            if not fields.get(name):
                raise ValueError(f"{path} has no {name}")
        lists = fields.get("input_files_dir") or "watchlists"
        for folder in (fields["data_dir"], lists):
            os.makedirs(folder, exist_ok=True)
        out = {ours: fields[theirs] for theirs, ours in FILE_FIELDS.items() if fields.get(theirs) is not None}
        out["visible_pct"] = fields.get("test_data_visible_pct", 0.1) if fields.get("test_mode") else 1.0
        out["reversion_type"] = out.get("reversion_type") or "ou"
        return cls.from_dict(out | {"watchlists": tuple(f"{lists}/{x}" for x in fields["input_files"])})


#: The names of fields in a configuration file, and ours.
FILE_FIELDS = {
    "data_dir": "data_dir", "models": "models", "min_weight": "min_weight", "max_weight": "max_weight", "portfolio_max_size": "max_size", "risk_free_rate": "risk_free",
    "allow_short": "allow_short", "use_anomaly_filter": "use_anomaly_filter", "use_decorrelation": "use_decorrelation", "use_reversion": "use_reversion",
    "reversion_type": "reversion_type", "optimization_objective": "objective",
}


def chosen(spark: SparkSession, config: Config, override: list[str] | None = None) -> DataFrame:
    """The tickers of a run: those of override, which must be text, or of the configuration's watchlists."""
    if override:
        if not all(isinstance(x, str) for x in override):
            raise ValueError("all symbols must be text")
        return spark.createDataFrame([(x,) for x in override], "ticker string").distinct()
    return price_sources.watchlist(spark.read.text(list(config.watchlists)))


def holdings_match(held: DataFrame, wanted: DataFrame) -> bool:
    """Whether two tables have the same tickers."""
    apart = lambda a, b: a.select("ticker").join(b.select("ticker"), "ticker", "left_anti").isEmpty()
    return apart(held, wanted) and apart(wanted, held)


def clusters(returns: DataFrame, method: str = "hdbscan", nearby: tuple[float, float, float] | None = None) -> DataFrame:
    """ticker, cluster by hdbscan, kmeans, mst or spectral on correlation distances; one cluster if there are no pairs. nearby: as in density_study()."""
    if method not in ("hdbscan", "kmeans", "mst", "spectral"):
        raise ValueError(f"unknown method {method}")
    returns = staged(returns.select("ticker", "date", "ret"))
    if is_many(returns) if method == "kmeans" else is_wide(returns):
        made = panel.of(returns)
        if not made.full.any():
            return returns.select("ticker", F.lit(0).alias("cluster")).distinct()
        units = panel.units(made, panel.shrunk(made))
        if method == "hdbscan":
            return density_of_series(returns.sparkSession, made, units, nearby)
        if method == "kmeans":
            return series_kmeans.clusters(returns.sparkSession, units, made.n, KMEANS_SIZES)
        if method == "spectral":
            k = tenth(made.n)
            return kmeans.clusters(spectral.embedding_of_series(returns.sparkSession, units, made.n, k), [k])
        return tree_communities(panel.forest(returns.sparkSession, units, lambda c, a, b: [("", 1 - c)]))
    corr = staged(linalg.correlation_matrix(returns, absolute=method == "hdbscan").select("a", "b", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value")))
    if corr.isEmpty():
        return returns.select("ticker", F.lit(0).alias("cluster")).distinct()
    c = F.col("value")
    pairs = lambda value: staged(corr.select("a", "b", value.alias("value")))
    if method == "hdbscan":
        return density_study(pairs((1 - c) / 2), nearby=nearby)
    if method == "kmeans":
        return kmeans.clusters(kmeans.distance_rows(pairs(F.sqrt((1 - c) / 2))), KMEANS_SIZES)
    if method == "mst":
        return tree_communities(pairs(1 - c).withColumn("g", F.lit("")))
    n = corr.select(F.explode(F.array("a", "b"))).distinct().count()
    k = tenth(n)
    return kmeans.clusters(spectral.embedding(pairs(linalg.affinity(c)), k), [k])


def tenth(n: int) -> int:
    """The number of spectral clusters of n tickers."""
    return max(2, -(-n // 10))


#: Tickers up to which correlations aren't shrunk, so that they need the pairs.
FEW = 50


def is_many(returns: DataFrame) -> bool:
    """Whether correlations are shrunk, as linalg.correlation_matrix() and the reference have it."""
    return returns.where("ret is not null").select("ticker").distinct().count() > FEW


def is_wide(returns: DataFrame) -> bool:
    """Whether shrunk correlations are made of series and not of pairs: where there are more tickers than dates."""
    n, days = returns.where("ret is not null").agg(F.count_distinct("ticker"), F.count_distinct("date")).first()
    return n > max(FEW, days)


def tree_communities(edges: DataFrame) -> DataFrame:
    """ticker, cluster: communities of the minimum spanning tree of edges(g, a, b, value), one graph."""
    found = staged(graph.communities(staged(graph.spanning_tree(edges))).select(F.col("node").alias("ticker"), "comp"))
    return with_numbers(found.withColumn("comp", F.min("ticker").over(Window.partitionBy("comp"))))


def with_numbers(rows: DataFrame) -> DataFrame:
    """rows(ticker, comp) to ticker, cluster: comps numbered in their order, null ones -1."""
    names = graph.numbered(rows.where("comp is not null").select("comp").distinct(), "comp", "cluster")
    return rows.join(names, "comp", "left").select("ticker", F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster"))


#: Values that the density study tries: the least and the greatest length at which clusters merge, and the scale of distances; the numbers of clusters that k-means tries.
EPSILONS, EPSILONS_MAX, ALPHAS = (0.15, 0.18, 0.21, 0.24, 0.27, 0.3), (0.3, 0.5, 0.75, 1.0), (0.1, 0.25, 0.5, 1.0, 1.5, 2.0)
KMEANS_SIZES = list(range(2, 11))


#: Steps by which the study moves from its best point, once along each and all axes.
NEARBY = (0.01, 0.1, 0.1)


def density_study(pairs: DataFrame, epsilons=EPSILONS, mosts=EPSILONS_MAX, alphas=ALPHAS, nearby: tuple[float, float, float] | None = NEARBY) -> DataFrame:
    """ticker, cluster (-1: noise) by the point with the best graph.density_scores(), of a grid and then, if nearby is given, of the points around its best.

    Points around it stay inside the grid's ranges and in steps of 0.01. Of equal points the first counts, those of the grid before others.
    """
    tickers = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return density_search(tickers, lambda scales: graph.spanning_tree(graph.reachability(pairs, 2, scales)), lambda labels: graph.mean_silhouettes(pairs, labels), (epsilons, mosts, alphas), nearby)


def density_of_series(spark: SparkSession, made: panel.Panel, units: RDD, nearby: tuple[float, float, float] | None = NEARBY) -> DataFrame:
    """density_study() of the distances (1 - c) / 2 of panel.units(), two blocks of series at a time, so that there is no table of pairs."""
    far = lambda c: (1 - c) / 2
    blocks = panel.with_nearest(units, far)

    known: dict[str, DataFrame] = {}

    def trees(scales: list[float]) -> DataFrame:
        """Up to a scale of 1 a distance by the scale is no less than that to the nearest of either, so these scales have one tree; no tree is made twice."""
        new = [g for g in dict.fromkeys(tree_of(s) for s in scales) if g not in known]
        reach = lambda c, a, b: ((g, np.maximum(np.maximum(a.core[:, None], b.core), far(c) / float(g))) for g in new)
        if new:
            made_now = staged(graph.spanning_tree(staged(panel.merged_forest(spark, made, blocks, reach))))
            known.update({g: made_now.where(F.col("g") == g) for g in new})
        of = lambda s: known[tree_of(s)].select(F.lit(str(s)).alias("g"), "a", "b", F.col("value") if s > 1 else (F.col("value") / s).alias("value"))
        return functools.reduce(DataFrame.unionByName, map(of, scales))

    means = lambda labels: panel.mean_silhouettes(spark, made, blocks, far, labels)
    return density_search(made.names.select(F.col("ticker").alias("node")), trees, means, (EPSILONS, EPSILONS_MAX, ALPHAS), nearby)


def tree_of(scale: float) -> str:
    """The scale whose tree of reachability one has too, but for the lengths."""
    return str(max(scale, 1.0))


def density_search(tickers: DataFrame, trees: Callable[[list[float]], DataFrame], means: Callable[[DataFrame], DataFrame], axes: tuple, nearby: tuple[float, float, float] | None) -> DataFrame:
    """density_study() of tickers(node): trees gives those of reachability at some scales, means is as in graph.scores(), axes are the grid's values."""
    grid = list(itertools.product(*axes))
    ends = [(min(x), max(x)) for x in axes]
    tried: list[tuple[float, DataFrame | None]] = []
    for _ in range(2):
        labels, _like = graph.density_cells(tickers, staged(trees(sorted({c[2] for c in grid}))), grid)
        found = staged(labels)
        top = graph.scores(tickers, found, means).where("score > -1").orderBy(F.desc("score"), "cell").first()
        cell = top["cell"] if top else 0
        tried.append((top["score"] if top else -1.0, found.where(F.col("cell") == cell).select("ticker", F.col("cluster").alias("comp"))))
        if nearby is None:
            break
        near = [sorted({round(min(hi, max(lo, x + k * step)), 2) for k in (-1, 0, 1)}) for x, step, (lo, hi) in zip(grid[cell], nearby, ends)]
        grid = [p for p in itertools.product(*near) if p not in grid] if top else []
        if not grid:
            break
    own = max(tried, key=lambda x: x[0])[1]  # the first of equal ones
    return with_numbers(staged(tickers.select(F.col("node").alias("ticker")).join(own, "ticker", "left")))


def decorrelated(returns: DataFrame, labels: DataFrame, objective: str = "sharpe", risk_free: float = 0.0) -> DataFrame:
    """The best tickers of each cluster."""
    return weights.best_of_clusters(metrics.composite(returns, objective, risk_free).join(labels, "ticker"))


def nested_clustering(returns: DataFrame, objective: str, max_weight: float = 1.0, short: bool = False, floor: float = 0.01) -> DataFrame:
    """Optimal weights within clusters (a task for each), then between the clusters' portfolios; small weights are dropped.

    Both steps use shrunk covariances and mean returns, by the year; the outer ones are those of the clusters' portfolios.
    """
    spark = returns.sparkSession
    ship(spark)
    clean = staged(align.drop_sparse(returns, "ret"))
    made = panel.of(clean)
    if not made.full.any():
        raise ValueError("covariances need a date that all tickers have")
    return nested_series(spark, made, objective, max_weight, short, floor)


def nested_series(spark: SparkSession, made: panel.Panel, objective: str, max_weight: float, short: bool, floor: float) -> DataFrame:
    """nested_clustering() of a panel: covariances are products of its series, so there is no table of pairs."""
    cov = panel.shrunk(made)
    scale, ridge, full = cov.scale * metrics.DAYS, cov.ridge * metrics.DAYS, made.full
    labels = staged(series_kmeans.clusters(spark, panel.units(made, cov), made.n, KMEANS_SIZES))

    def inside(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("ticker").combine_chunks()
        x = part["x"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).T  # a row for each date
        days = ~np.isnan(x).all(1)
        x = np.nan_to_num(x)
        w = np.ones(1) if x.shape[1] == 1 else numerics.best_weights(objective, x[days].mean(0) * metrics.DAYS, panel.Product(x[full] - x[full].mean(0), scale, ridge), x[days], max_weight, short)
        line = [(x @ w).tolist()] + [None] * (len(w) - 1)  # with the first ticker
        return pa.table({"cluster": pa.array([key[0].as_py()] * len(w), pa.int32()), "ticker": part["ticker"], "weight": w, "line": pa.array(line, pa.list_(pa.float64()))})

    rows = panel.series(spark, made).join(labels, "ticker")
    within = staged(rows.groupBy("cluster").applyInArrow(inside, "cluster int, ticker string, weight double, line array<double>"))
    lines = within.groupBy("cluster").agg(F.max("line").alias("line"), F.sum(F.col("weight") * F.col("weight")).alias("q")).toPandas().sort_values("cluster")  # a row for each cluster
    x = np.stack(lines["line"]).T
    held = x[full] - x[full].mean(0)
    m = scale * held.T @ held + ridge * np.diag(lines["q"])
    w = np.ones(1) if len(lines) == 1 else numerics.best_weights(objective, x.mean(0) * metrics.DAYS, m, x, max_weight, short)
    outer = spark.createDataFrame([(int(i), float(v)) for i, v in zip(lines["cluster"], w)], "cluster int, w double")
    return within.join(F.broadcast(outer), "cluster").select("ticker", (F.col("weight") * F.col("w")).alias("weight")).where(F.abs("weight") >= floor)


def best_omega(returns: DataFrame, max_weight: float = 1.0) -> DataFrame:
    """omega.best_weights(), split by tickers where they are more than the dates, and else by dates."""
    returns = staged(returns.select("ticker", "date", "ret"))
    return (ratios.best_omega if is_wide(returns) else omega.best_weights)(returns, max_weight)


def omega_program(returns: DataFrame, objective: str, max_weight: float = 1.0, short: bool = False, floor: float = 0.01) -> DataFrame:
    """The weights of the greatest Omega ratio over all tickers, whatever the objective; small weights are dropped."""
    return best_omega(align.drop_sparse(returns, "ret"), max_weight).where(F.col("weight") >= floor).select("ticker", "weight")


def sharpe_program(returns: DataFrame, objective: str, max_weight: float = 1.0, short: bool = False, floor: float = 0.01) -> DataFrame:
    """The weights of the greatest Sharpe ratio over all tickers by shrunk moments, whatever the objective; small weights are dropped."""
    clean = staged(align.drop_sparse(returns, "ret"))
    if is_wide(clean) and (found := ratios.best_sharpe(clean, metrics.DAYS, max_weight)):
        return found.select("ticker", "weight").where(F.col("weight") >= floor)
    if clean.select("ticker").distinct().count() > omega.MAX_TICKERS:
        raise ValueError(f"more than {omega.MAX_TICKERS} tickers")
    names, cov = square(linalg.shrunk(clean).select("a", "b", (F.col("value") * metrics.DAYS).alias("value")))
    means = {r["ticker"]: r["m"] for r in clean.groupBy("ticker").agg((F.avg("ret") * metrics.DAYS).alias("m")).collect()}  # omega.MAX_TICKERS at most
    found = numerics.sharpe_program(np.array([means[t] for t in names]), cov, max(max_weight, 1 / len(names)))
    return clean.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(names, found) if w >= floor], "ticker string, weight double")


MODELS = {"nested_clustering": nested_clustering, "omega": omega_program, "sharpe": sharpe_program}


def model(name: str):
    """Register a function of (returns, objective, max_weight, short) as a model."""

    def add(f):
        MODELS[name] = f
        return f

    return add


def kept_hash(rows: DataFrame) -> str:
    """A short name of the tickers of rows."""
    return price_sources.symbols_hash(rows.select("ticker").distinct()).first()["hash"]


def optimise(model: str, returns: DataFrame, config: Config) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; there are {sorted(MODELS)}")
    return MODELS[model](returns, config.objective, config.max_weight, config.allow_short)


#: The most series of a basket: three for each are in the moment matrix of its eigenproblem.
MAX_BASKET = 600


def square(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Moments (a, b, value) of a basket to names and a symmetric matrix."""
    rows = pairs.select("a", "b", "value").toArrow()  # (3 * MAX_BASKET) ** 2 / 2 rows at most, as columns
    names, ends = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]).astype(str), return_inverse=True)
    i, j = ends.reshape(2, -1)
    out = np.full((len(names), len(names)), np.nan)
    out[i, j] = out[j, i] = rows["value"].to_numpy()
    return names.tolist(), np.nan_to_num(out)


def johansen(prices: DataFrame) -> DataFrame:
    """ticker, v: the leading cointegration vector of log prices, one lagged difference; the moments are Spark sums."""
    whole = align.overlap(prices)
    n = whole.select("ticker").distinct().count()
    if n < 2:
        raise ValueError("cointegration needs two series or more")
    if n > MAX_BASKET:
        raise ValueError(f"{n} series are too many for a basket")
    if whole.where("adj_close <= 0").limit(1).count():
        raise ValueError("prices must be positive")
    x = F.ln("adj_close")
    rows = whole.select("ticker", "date", x.alias("level"))
    rows = rows.withColumn("l1", F.lag("level").over(align.by_date())).withColumn("l2", F.lag("level", 2).over(align.by_date())).where("l2 is not null")
    parts = rows.select("date", F.explode(F.array(*(F.struct(F.concat(F.lit(k), "ticker").alias("name"), c.alias("ret")) for k, c in (("d", F.col("level") - F.col("l1")), ("e", F.col("l1") - F.col("l2")), ("l", F.col("l1")))))).alias("r"))
    long = parts.select("date", F.col("r.name").alias("ticker"), F.col("r.ret").alias("ret"))
    names, m = square(linalg.covariances(long, sample=False))
    at = lambda k: [i for i, t in enumerate(names) if t[0] == k]
    d, e, lag = at("d"), at("e"), at("l")
    inner = np.linalg.pinv(m[np.ix_(e, e)])
    left = lambda a, b: m[np.ix_(a, b)] - m[np.ix_(a, e)] @ inner @ m[np.ix_(e, b)]
    _, v = numerics.cointegration(left(d, d), left(d, lag), left(lag, lag))
    return prices.sparkSession.createDataFrame([(names[i][1:], float(a)) for i, a in zip(lag, v)], "ticker string, v double")


#: Rounds in which the study of a basket's bounds tries points between those of its grid, at half the distance each. (A
#: single asset's trades enter under and leave over the mean, so none loses, and all scores are 0.)
FINER = 2


def basket(prices: DataFrame, vector: DataFrame | None = None) -> DataFrame:
    """date, ret and position of the cointegrated basket (by vector, or by johansen()), traded between the bounds of the highest Sharpe ratio, of a grid and then of points between."""
    line = staged(signals.spread(align.overlap(prices), johansen(prices) if vector is None else vector))
    top = signals.basket_bounds(line, rounds=FINER).first()
    stop, take = (top["stop"], top["take"]) if top else (-np.inf, np.inf)
    rows = line.withColumn("ticker", F.lit("basket"))
    dev = rows.withColumn("dev", F.col("spread") - F.avg("spread").over(Window.partitionBy("ticker")))
    held = signals.basket_returns(signals.basket_positions(dev, stop, take).join(dev.select("ticker", "date", "spread"), ["ticker", "date"]))
    return held.select("date", "position", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def allocate(returns: DataFrame) -> DataFrame:
    """The best blend of Kelly and inverse-volatility weights on a grid, with leverage up to 1 for a risk of 15 %."""
    k, r = staged(weights.kelly(returns)), staged(weights.inverse_volatility(returns))
    top = signals.blend_grid(k, r, returns).orderBy(F.desc_nulls_last("score"), "a", "b").first()
    a, b = (top["a"], top["b"]) if top else (0.0, 1.0)
    mixed = k.join(r.withColumnRenamed("weight", "w2"), "ticker").select("ticker", ((a * F.col("weight") + b * F.col("w2")) / (a + b)).alias("weight"))
    vol = windows.latest_volatility(returns).first()["vol"]
    return mixed.withColumn("weight", F.col("weight") * F.lit(min(0.15 / vol, 1.0) if vol else 1.0))


#: What the reversion study tries: windows of days and of weeks, and limits of either side.
DAILY, WEEKLY, LIMITS = [5, 10, 15, 20, 25, 30], [1, 5, 10, 15, 20, 25], [round(1 + 0.1 * k, 1) for k in range(21)]


def reversion_parameters(returns: DataFrame, labels: DataFrame, sizes: list[int], objective: str) -> DataFrame:
    """ticker, window, low and high: the best of the grid for the ticker's cluster; 20, 1.5 and 1.5 (or the first window) where none has a score."""
    grid = signals.window_grid(returns.join(labels, "ticker"), sizes, LIMITS, objective, ("cluster",))
    top = signals.best(grid, ["window", "low", "high"], ("cluster",)).drop("score")
    given = {"window": F.lit(20 if 20 in sizes else sizes[0]), "low": F.lit(1.5), "high": F.lit(1.5)}
    return staged(labels.join(top, "cluster", "left").select("ticker", *(F.coalesce(c, v).alias(c) for c, v in given.items())))


#: Columns of a ticker's reversion parameters: the daily window and limits, the weekly ones, and the share of the daily signal.
PARAMETERS = "window int, low double, high double, weekly_window int, weekly_low double, weekly_high double, share double"


def both_signals(whole: DataFrame, weekly: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily and weekly signals with params(ticker, PARAMETERS)."""
    late = params.select("ticker", F.col("weekly_window").alias("window"), F.col("weekly_low").alias("low"), F.col("weekly_high").alias("high"))
    return staged(signals.stateful_by(whole, params.select("ticker", "window", "low", "high"), DAILY)), staged(signals.stateful_by(weekly, late, WEEKLY))


def studied(whole: DataFrame, weekly: DataFrame, labels: DataFrame, objective: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best parameters of each cluster of labels for its tickers (ticker, PARAMETERS), and the signals with them."""
    late = reversion_parameters(weekly, labels, WEEKLY, objective).toDF("ticker", "weekly_window", "weekly_low", "weekly_high")
    params = staged(reversion_parameters(whole, labels, DAILY, objective).join(late, "ticker"))
    daily_s, weekly_s = both_signals(whole, weekly, params)
    grid = signals.weight_grid(daily_s, weekly_s, whole.join(labels, "ticker"), objective=objective, by=("cluster",))
    shares = labels.join(signals.best(grid, ["weight"], ("cluster",)), "cluster", "left").select("ticker", F.coalesce("weight", F.lit(0.7)).alias("share"))
    return staged(params.join(shares, "ticker")), daily_s, weekly_s


def known_parameters(whole: DataFrame, weekly: DataFrame, labels: DataFrame, objective: str, path: str) -> DataFrame:
    """studied() parameters, but a cluster with a ticker whose parameters are in the cache at path, and not stale, has those; new ones are added to it."""
    spark, now = whole.sparkSession, F.current_timestamp()
    like = spark.createDataFrame([], f"ticker string, objective string, {PARAMETERS}, saved_at timestamp")
    names = [f.split()[0] for f in PARAMETERS.split(", ")]
    cached = snapshots.read(spark, path, like=like).where((F.col("objective") == objective) & ~caching.is_stale(F.col("saved_at").cast("string"), now))
    first = labels.join(cached, "ticker").groupBy("cluster").agg(F.min_by(F.struct(*names), "ticker").alias("p"))
    old = staged(labels.join(first, "cluster").select("ticker", "p.*"))
    rest = staged(labels.join(old, "ticker", "left_anti"))
    params = old if rest.isEmpty() else staged(old.unionByName(studied(whole.join(rest, "ticker", "left_semi"), weekly.join(rest, "ticker", "left_semi"), rest, objective)[0].select(*old.columns)))
    fresh = params.join(cached, "ticker", "left_anti").withColumns({"objective": F.lit(objective), "saved_at": now}).select(*like.columns)
    others = lambda stored, rows: stored.join(rows.select("ticker", "objective"), ["ticker", "objective"], "left_anti").select(*like.columns).unionByName(rows)
    snapshots.commit(spark, path, fresh, others)
    return params


def z_overlay(base: DataFrame, returns: DataFrame, objective: str = "sharpe", cache_dir: str | None = None) -> DataFrame:
    """base tilted by mean-reversion signals of every ticker, with parameters of its cluster, spread within the cluster by similarity."""
    labels = staged(signals.own_clusters(clusters(returns)))
    whole = returns.where("ret is not null").select("ticker", "date", "ret")
    weekly = staged(windows.weekly_last(whole))
    if cache_dir:
        params = known_parameters(whole, weekly, labels, objective, f"{cache_dir}/parameters")
        daily_s, weekly_s = both_signals(whole, weekly, params)
    else:
        params, daily_s, weekly_s = studied(whole, weekly, labels, objective)
    both = daily_s.withColumn("freq", F.lit("daily")).unionByName(weekly_s.withColumn("freq", F.lit("weekly")))
    spread = staged(signals.propagate(signals.latest_composite(both, shares=params.select("ticker", "share")), whole, clusters=labels))
    top = signals.best(signals.alpha_grid(base, spread, whole, objective=objective), ["alpha"]).first()
    vol = windows.latest_volatility(returns, 30, None).first()["vol"] or 0.0
    return weights.normalize(signals.tilt(base, spread, (top["alpha"] if top and top["alpha"] else 0.1) / (1 + vol)))


def ou_overlay(base: DataFrame, prices: DataFrame, returns: DataFrame) -> DataFrame:
    """base moved towards the allocation over single-asset strategies and the basket, whose share goes to its hedge ratios."""
    fit = signals.ou_fit(prices)
    rows = prices.join(fit, "ticker").withColumn("price", F.col("adj_close")).withColumn("dev", F.ln("adj_close") - F.col("mu"))
    rows = staged(rows.select("ticker", "date", "price", "dev", "sigma"))
    bounded = rows.join(signals.ou_bounds(rows).select("ticker", "stop", "take"), "ticker")
    trades = signals.ou_trades(bounded, F.col("stop"), F.col("take")).select("ticker", F.col("exit_date").alias("date"), "ret")
    dates = returns.select("ticker", "date")
    single = dates.join(trades, ["ticker", "date"], "left").na.fill(0.0, ["ret"])
    if prices.select("ticker").distinct().count() < 2:  # nothing to hedge with
        target = allocate(staged(single))
    else:
        vector = staged(johansen(prices))
        group = basket(prices, vector).select(F.lit("basket").alias("ticker"), "date", "ret")
        spread = staged(allocate(staged(single.unionByName(group))))
        share = spread.where("ticker = 'basket'").first()
        hedge = vector.select("ticker", F.col("v").alias("ratio"))
        target = weights.distribute(spread.where("ticker <> 'basket'"), share["weight"] if share else 0.0, hedge)
    vol = windows.latest_volatility(returns).first()["vol"] or 0.0
    return weights.normalize(weights.adaptive(base, target, vol))


def visible(rows: DataFrame, share: float) -> DataFrame:
    """The rows of the first floor(share * dates) dates."""
    if share >= 1:
        return rows
    dates = rows.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date"))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))  # a calendar
    return rows.join(dates.where(F.col("_i") <= F.floor(share * F.col("_n"))).select("date"), "date", "left_semi")


def against(lines: DataFrame, own: DataFrame) -> DataFrame:
    """Cumulative lines(ticker, date, ret, cum) and the portfolio's own, with ahead: how far each is ahead of it that day."""
    of = own.select("date", F.col("cum").alias("_own"))
    return lines.unionByName(own).join(of, "date", "left").withColumn("ahead", F.col("cum") - F.col("_own")).drop("_own")


def run(prices: DataFrame, market: DataFrame | None = None, config: Config = Config()) -> dict[str, DataFrame]:
    """Prices (ticker, date, adj_close) to weights, report, contributions, box statistics and plot rows."""
    given = staged(visible(prices.select("ticker", "date", "adj_close"), config.visible_pct))
    filled = staged(align.fill(align.densify(given), "adj_close"))
    returns = staged(windows.simple_returns(filled).where("ret is not null"))
    kept = returns.select("ticker").distinct()
    if config.use_anomaly_filter:
        calm = staged(anomaly.keep_calm(anomaly.flags(returns)).select("ticker"))
        kept = calm if not calm.isEmpty() else kept
    if config.use_decorrelation:
        inside = returns.join(kept, "ticker", "left_semi")
        few = staged(decorrelated(inside, clusters(inside), config.objective, config.risk_free).select("ticker"))
        kept = few if not few.isEmpty() else kept
    logs = staged(windows.log_returns(filled.join(kept, "ticker", "left_semi")))
    last = logs.agg(F.max("date")).first()[0]
    portfolios, base_columns = None, logs.select("ticker", F.col("ret").alias("weight"))
    for years, models in config.models:
        part = logs.where(F.col("date") >= F.date_sub(F.lit(last), round(365 * years)))
        for model in models:
            make = lambda m=model, p=part: weights.limit_size(weights.normalize(optimise(m, p, config), config.min_weight), config.max_size)
            key = f"{model}-{years}-{config.objective}-{last}-{kept_hash(part)}" if config.cache_dir else ""
            w = caching.remembered(config.cache_dir, key, make, base_columns) if config.cache_dir else make()
            named = staged(w.withColumn("portfolio", F.lit(f"{model}{years}")))
            portfolios = named if portfolios is None else portfolios.unionByName(named)
    base = staged(weights.normalize(weights.stack(portfolios), config.min_weight))
    held, chosen = logs.join(base, "ticker", "left_semi"), filled.join(base, "ticker", "left_semi")
    if config.use_reversion:
        final = z_overlay(base, returns.join(base, "ticker", "left_semi"), config.objective, config.cache_dir) if config.reversion_type == "z" else ou_overlay(base, chosen, held)
        final = staged(final)
    else:
        final = base
    own = metrics.portfolio_returns(held, final)
    if market is None and config.benchmark:
        market = price_sources.benchmark(visible(prices, config.visible_pct), config.benchmark)
        market = None if market.isEmpty() else market
    market = market if market is not None else returns.groupBy("date").agg(F.avg("ret").alias("m"))
    line = windows.cumulative(own.withColumn("ticker", F.lit("SIM_PORT")).select("ticker", "date", "ret"))
    return {
        "weights": final, "report": metrics.report(own, market, config.risk_free), "contributions": metrics.contributions(held, final),
        "boxes": metrics.box_stats(held.where("ret is not null")), "cumulative": against(windows.cumulative(held), line),
    }


def iterate(prices: DataFrame, config: Config = Config(), epochs: int = 1) -> dict[str, DataFrame]:
    """Run again on the tickers that got a weight, until they stay the same or are few enough; filters work in the first run only."""
    out, names = {}, None
    for k in range(epochs):
        rows = prices if names is None else prices.join(names, "ticker", "left_semi")
        out = run(rows, None, replace(config, use_anomaly_filter=False, use_decorrelation=False) if k else config)
        now = staged(out["weights"].select("ticker"))
        if now.count() <= config.max_size or names is not None and holdings_match(now, names):
            break
        names = now
    return out
