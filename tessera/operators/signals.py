"""Mean-reversion signals, state machines and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import linalg, metrics, order_statistics, scan, study, windows
from tessera.operators.align import by_date
from tessera.operators.weights import everywhere


def threshold_signal(z: Column, high: Column | float, low: Column | float) -> Column:
    """How far z is beyond its limits, in units of the limit: bought below -low, sold above high."""
    high, low = (x if isinstance(x, Column) else F.lit(float(x)) for x in (high, low))
    return F.when(z < -low, (-z - low) / low).when(z > high, -(z - high) / high).otherwise(F.lit(0.0))


def with_decay(returns: DataFrame, window: int, target: float = 0.5) -> DataFrame:
    """returns with z and decay: target to the power of the rolling deviation over its mean in the whole series."""
    sd = F.nullif(windows.rolling_std("ret", window), F.lit(0.0))
    rows = returns.withColumn("_s", sd).withColumn("z", (F.col("ret") - windows.rolling_mean("ret", window)) / F.col("_s"))
    return rows.withColumn("decay", F.pow(F.lit(target), F.col("_s") / F.avg("_s").over(Window.partitionBy("ticker")))).drop("_s")


def stateful(returns: DataFrame, window: int, high: float, low: float, reset: float = 0.5) -> DataFrame:
    """ticker, date, state and adj: a position is taken beyond a limit, held while it fades, and left below half the limit."""
    rows = with_decay(returns, window).select("ticker", "date", "z", "decay", F.lit(float(high)).alias("high"), F.lit(float(low)).alias("low"))
    return walked(rows, reset)


def stateful_by(returns: DataFrame, params: DataFrame, sizes: list[int], reset: float = 0.5) -> DataFrame:
    """stateful() with params(ticker, window, low, high), a row for each ticker; sizes are all windows that occur."""
    rows = returns.join(params, "ticker")
    parts = [with_decay(rows.where(F.col("window") == n), n).select("ticker", "date", "z", "decay", "high", "low") for n in sizes]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return walked(whole, reset)


def walked(rows: DataFrame, reset: float) -> DataFrame:
    """rows(ticker, date, z, decay, high, low) to ticker, date, state and adj; the first row of a ticker only starts the walk."""
    z, high, low = F.nanvl("z", F.lit(None).cast("double")), F.col("high"), F.col("low")
    first = rows.groupBy("ticker").agg(F.min("date").alias("_first"))
    none = z.isNull() | (F.col("date") == F.col("_first"))
    enter = F.when(z > high, -1).when(z < -low, 1).otherwise(0)
    step = F.when(none, scan.code(0, 0, 0)).otherwise(scan.code(F.when(z < high * reset, 0).otherwise(-1), enter, F.when(z > -low * reset, 0).otherwise(1)))
    done = scan.run(rows.join(first, "ticker"), step)
    state, size = F.col("state"), F.abs("z")
    moved = F.greatest(F.lit(0.0), 1 + state * size * F.pow("decay", F.col("place") - F.col("entered")))
    beyond = (state != 0) & (size >= F.when(state < 0, high).otherwise(low))
    return done.select("ticker", "date", state.cast("int").alias("state"), F.when(beyond, moved).otherwise(F.lit(1.0)).alias("adj"))


def basket_positions(spread: DataFrame, stop: Column | float, take: Column | float) -> DataFrame:
    """spread(ticker, date, dev) to positions: long below stop until 0, short above take until 0; a row that leaves doesn't enter."""
    stop, take = (x if isinstance(x, Column) else F.lit(float(x)) for x in (stop, take))
    dev = F.nanvl("dev", F.lit(None).cast("double"))
    enter = F.when(dev < stop, 1).when(dev > take, -1).otherwise(0)
    step = scan.code(F.when(dev <= 0, 0).otherwise(-1), enter, F.when(dev >= 0, 0).otherwise(1))
    return scan.run(spread.select("ticker", "date", "dev", step.alias("_step")), F.col("_step")).select("ticker", "date", F.col("state").cast("int").alias("position"))


def latest_composite(signals: DataFrame, daily_weight: float = 0.7, shares: DataFrame | None = None) -> DataFrame:
    """signals(ticker, freq, date, adj) to the weighted sum of the latest daily and weekly values; shares(ticker, share) are daily weights of their own."""
    w = F.lit(min(1.0, max(0.0, daily_weight)))
    if shares is not None:
        signals = signals.join(shares, "ticker", "left")
        w = F.coalesce(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share")))), w)
    last = signals.groupBy("ticker", "freq").agg(F.max_by("adj", "date").alias("adj"), *([F.max("share").alias("share")] if shares is not None else []))
    part = lambda freq: F.coalesce(F.max(F.when(F.col("freq") == freq, F.col("adj"))), F.lit(0.0))
    return last.groupBy("ticker").agg((w * part("daily") + (1 - w) * part("weekly")).alias("signal"))


def propagate(signals: DataFrame, returns: DataFrame, dampening: float = 0.5, window: int = 90, clusters: DataFrame | None = None) -> DataFrame:
    """Half the own signal and half the mean of the others, weighted by the positive correlation of rolling mean returns.

    With clusters(ticker, cluster) the others are those of a ticker's own cluster.
    """
    smooth = returns.withColumn("ret", windows.rolling_mean("ret", window))
    near = linalg.correlations(smooth).where("value > 0")
    if clusters is not None:
        of = lambda name: clusters.select(F.col("ticker").alias(name), F.col("cluster").alias(f"_{name}"))
        near = near.join(of("a"), "a").join(of("b"), "b").where("_a = _b").select("a", "b", "value")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = both.join(signals.toDF("b", "s"), "b").groupBy(F.col("a").alias("ticker")).agg((F.sum(F.col("s") * F.col("value")) / F.sum("value")).alias("other"))
    return signals.join(others, "ticker", "left").select("ticker", ((1 - dampening) * F.col("signal") + dampening * F.coalesce("other", F.lit(0.0))).alias("signal"))


def tilt(weights: DataFrame, signals: DataFrame, alpha: float = 0.2, short: bool = False) -> DataFrame:
    """w (1 + alpha signal); without shorts negative results shrink to a tenth; scaled to a sum of 1."""
    raw = weights.join(signals, "ticker", "left").select("ticker", (F.col("weight") * (1 + alpha * F.coalesce("signal", F.lit(0.0)))).alias("w"))
    moved = raw if short else raw.withColumn("w", F.when(F.col("w") < 0, 0.1 * F.col("w")).otherwise(F.col("w")))
    whole = F.sum(F.abs("w") if short else F.col("w")).over(everywhere())
    return moved.select("ticker", F.try_divide(F.col("w"), whole).alias("weight"))


def scored(rows: DataFrame, keys: list[str], objective: str) -> DataFrame:
    """rows(keys, date, ret) to keys and the composite score of each."""
    named = rows.select(F.struct(*keys).alias("ticker"), "date", "ret")
    return metrics.composite(named, objective).select("ticker.*", "score")


def window_grid(returns: DataFrame, window_sizes: list[int], limits: list[float], objective: str = "sharpe", by: tuple[str, ...] = ()) -> DataFrame:
    """window, low, high and score of every cell, for each group of the columns by: the threshold strategy with positions of the day before.

    low and high are the limits of buying and selling. A position depends on one of them only, so each limit's
    daily return is summed once, and cells are put together from daily rows.
    """
    each = F.array(*map(F.lit, limits))
    found, by = None, list(by)
    for n in window_sizes:
        z = F.lag("z").over(by_date())
        marked = order_statistics.robust_zscore(returns, "ret", n).withColumn("before", z).withColumn("limit", F.explode(each))
        gain = lambda p: F.sum(F.coalesce(p * F.col("ret"), F.lit(0.0)))
        none = F.lit(0.0)
        bought = F.when(F.col("before") < -F.col("limit"), (-F.col("before") - F.col("limit")) / F.col("limit")).otherwise(none)
        sold = F.when(F.col("before") > F.col("limit"), -(F.col("before") - F.col("limit")) / F.col("limit")).otherwise(none)
        daily = marked.groupBy(*by, "date", "limit").agg(gain(bought).alias("b"), gain(sold).alias("s"))
        lines = daily.groupBy(*by, "date").agg(F.collect_list(F.struct("limit", "b", "s")).alias("x"))  # a row for each limit
        cells = lines.select(*by, "date", F.explode("x").alias("lo"), "x").select(*by, "date", "lo", F.explode("x").alias("hi"))
        rows = cells.select(*by, F.lit(n).alias("window"), F.col("lo.limit").alias("low"), F.col("hi.limit").alias("high"), "date", (F.col("lo.b") + F.col("hi.s")).alias("ret"))
        found = rows if found is None else found.unionByName(rows)
    return scored(found, [*by, "window", "low", "high"], objective)


def best(grid: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The cell with the highest score of each group; of equal ones the first by keys."""
    known = grid.where("score is not null and not isnan(score)")
    order = F.struct((-F.col("score")).alias("s"), *keys)
    return known.groupBy(*by).agg(F.min(order).alias("m")).select(*by, *(f"m.{k}" for k in keys), (-F.col("m.s")).alias("score"))


def weight_grid(daily: DataFrame, weekly: DataFrame, returns: DataFrame, steps: int = 10, objective: str = "sharpe", by: tuple[str, ...] = ()) -> DataFrame:
    """weight and score for daily weights 1/steps to 1, of an equal-weight base tilted by the latest signals; for each group of the columns by of returns."""
    latest = lambda s, name: s.groupBy("ticker").agg(F.max_by("adj", "date").alias(name))
    rows, by = returns.where("ret is not null"), list(by)
    groups = rows.select(*by, "ticker").distinct()
    both = latest(daily, "d").join(latest(weekly, "w"), "ticker").join(groups, "ticker").withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    mixed = both.withColumn("s", (F.col("g") * F.col("d") + (steps - F.col("g")) * F.col("w")) / steps)
    group = Window.partitionBy(*by, "g")
    top = F.max("s").over(group)
    factor = F.greatest(F.lit(0.0), 1 + F.when(top <= 1, F.col("s") - 1).otherwise((F.col("s") - 1) / (top - 1)))
    weights = mixed.withColumn("f", factor).withColumn("weight", F.try_divide(F.col("f"), F.sum("f").over(group)))
    joined = rows.join(weights.select("g", "ticker", "weight"), "ticker")
    line = joined.groupBy(*by, "g", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    return scored(line, [*by, "g"], objective).select(*by, (F.col("g") / steps).alias("weight"), "score")


def own_clusters(labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """labels(ticker, cluster) to (ticker, cluster as text): known clusters win, a noise ticker (-1) is a cluster of its own."""
    cluster = F.col("cluster")
    if known is not None:
        labels = labels.join(known.select("ticker", F.col("cluster").alias("_known")), "ticker", "left")
        cluster = F.coalesce("_known", "cluster")
    return labels.select("ticker", F.when(cluster == -1, F.col("ticker")).otherwise(cluster.cast("string")).alias("cluster"))


def cluster_parameters(params: DataFrame) -> DataFrame:
    """params(ticker, cluster, ...) to one row for each cluster: its sorted tickers and the parameters of the first."""
    rest = [c for c in params.columns if c not in ("ticker", "cluster")]
    return params.groupBy("cluster").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"), *(F.min_by(c, "ticker").alias(c) for c in rest))


def alpha_grid(weights: DataFrame, signals: DataFrame, returns: DataFrame, low: float = 0.05, high: float = 0.2, steps: int = 8, objective: str = "sharpe") -> DataFrame:
    """alpha and score on a geometric grid.

    Signals are those of the whole sample, so a tilt that is worked out again at every rebalance, each 30 rows,
    comes out the same, and one for all dates says as much.
    """
    grid = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
    both = weights.join(signals, "ticker", "left").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    a = F.get(F.array(*map(F.lit, grid)), F.col("g"))
    raw = F.col("weight") * (1 + a * F.coalesce("signal", F.lit(0.0)))
    moved = both.withColumn("w", F.when(raw < 0, 0.1 * raw).otherwise(raw))
    scaled = moved.withColumn("w", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("g"))))
    joined = returns.where("ret is not null").join(scaled.select("g", "ticker", "w"), "ticker")
    rows = joined.groupBy("g", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    return scored(rows, ["g"], objective).select(F.get(F.array(*map(F.lit, grid)), F.col("g")).alias("alpha"), "score")


def blend_grid(first: DataFrame, second: DataFrame, returns: DataFrame, steps: int = 10) -> DataFrame:
    """a, b and score (half Sharpe, half kappa) of a * first + b * second, scaled to a sum of 1, for scales 1/steps to 1.

    A blend's returns are the blend of both sides' returns, so tickers are added up once for all cells.
    """
    both = first.join(second.withColumnRenamed("weight", "w2"), "ticker").where("weight is not null and w2 is not null")
    sides = ("weight", "w2")
    parts = returns.where("ret is not null").join(both, "ticker").groupBy("date").agg(*(F.sum(F.col(c) * F.col("ret")).alias(f"r_{c}") for c in sides))
    whole = both.agg(*(F.sum(c).alias(c) for c in sides))
    grid = F.sequence(F.lit(1), F.lit(steps))
    cells = parts.join(F.broadcast(whole)).withColumn("i", F.explode(grid)).withColumn("j", F.explode(grid))  # one row; a calendar
    blend = lambda x, y: F.col("i") * F.col(x) + F.col("j") * F.col(y)
    daily = cells.select("i", "j", "date", F.try_divide(blend("r_weight", "r_w2"), blend("weight", "w2")).alias("ret"))
    x = F.col("ret")
    return daily.groupBy("i", "j").agg((0.5 * (metrics.sharpe(x) + metrics.kappa(x))).alias("score")).select((F.col("i") / steps).alias("a"), (F.col("j") / steps).alias("b"), "score")


def ou_fit(prices: DataFrame, dt: float = 1.0) -> DataFrame:
    """ticker, kappa, mu, sigma of an Ornstein-Uhlenbeck process by least squares on log prices."""
    rows = prices.select("ticker", "date", F.ln("adj_close").alias("p")).withColumn("x", F.lag("p").over(by_date())).where("x is not null").withColumn("y", F.col("p") - F.col("x"))
    line = rows.groupBy("ticker").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    spread = rows.join(line, "ticker").groupBy("ticker", "a", "b").agg(F.stddev_pop(F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("s"))
    k = -F.col("b") / dt
    inner = F.try_divide(2 * k, 1 - F.exp(-2 * k * dt))
    return spread.select("ticker", k.alias("kappa"), F.coalesce(F.try_divide(F.col("a"), k), F.lit(0.0)).alias("mu"), F.when(inner >= 0, F.col("s") * F.sqrt(inner)).alias("sigma"))


def ou_trades(rows: DataFrame, stop: Column, take: Column) -> DataFrame:
    """rows(ticker, date, price, dev): each entry (dev under stop) with the next exit (dev over take), without overlaps."""
    buy, sell = F.col("dev") < stop, F.col("dev") > take
    exits = Window.partitionBy("ticker").orderBy("date")
    marked = rows.withColumn("out", F.min(F.when(sell, F.struct("date", "price"))).over(exits.rowsBetween(1, Window.unboundedFollowing)))
    entries = marked.where(buy & F.col("out").isNotNull())
    first = entries.groupBy("ticker", F.col("out.date").alias("exit_date")).agg(F.min(F.struct("date", "price")).alias("e"), F.first("out.price").alias("exit"))
    return first.select("ticker", F.col("e.date").alias("date"), F.col("e.price").alias("entry"), "exit_date", "exit", F.ln(F.col("exit") / F.col("e.price")).alias("ret"))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades(keys, ret) to trades, sharpe, win_rate, kappa and score (their product, with the log of 1 + trades)."""
    x = F.col("ret")
    found = trades.groupBy(*keys).agg(F.count("*").alias("trades"), metrics.sharpe(x).alias("sharpe"), F.avg((x > 0).cast("double")).alias("win_rate"), metrics.kappa(x).alias("kappa"))
    return found.withColumn("score", F.col("sharpe") * F.col("win_rate") * F.ln(F.col("trades") + 1.0) * F.col("kappa"))


def bound_cells(steps: int) -> Column:
    """Array of (stop, take) in deviations: -2 to 0, and 0 to 2, steps of each."""
    ends = [2 * k / steps for k in range(steps + 1)]
    return F.array(*(F.struct(F.lit(-a).alias("stop"), F.lit(b).alias("take")) for a in ends for b in ends))


def bound_axes(steps: int) -> list[study.Axis]:
    return [study.Axis("stop", -2.0, 0.0, 2 / steps), study.Axis("take", 0.0, 2.0, 2 / steps)]


def bound_scores(rows: DataFrame) -> DataFrame:
    """rows(ticker, date, price, dev, sigma, cells) to ticker, stop, take (in deviations), trades and score of the cells that traded; without a score 0."""
    each = rows.withColumn("c", F.explode("cells"))
    keyed = each.select(F.struct("ticker", "c.stop", "c.take").alias("ticker"), "date", "price", "dev", (F.col("c.stop") * F.col("sigma")).alias("stop"), (F.col("c.take") * F.col("sigma")).alias("take"))
    trades = ou_trades(keyed, F.col("stop"), F.col("take")).select("ticker.*", "ret")
    return trade_metrics(trades, ["ticker", "stop", "take"]).select("ticker", "stop", "take", "trades", F.coalesce(study.known(), F.lit(0.0)).alias("score"))


def ou_bounds(rows: DataFrame, steps: int = 8, rounds: int = 0, shares: tuple[float, ...] = (1.0,)) -> DataFrame:
    """rows(ticker, date, price, dev, sigma) to the best stop and take of each ticker, with trades and score.

    Every cell of a grid of -2 sigma to 0 by 0 to 2 sigma is traded; a cell without a score counts as 0, and of
    equal cells the one nearest to 0 wins. Tickers without a trade in any cell get the outermost bounds. rounds and shares
    are those of study.search(): points between the grid's, and halving.
    """
    top = study.search(rows, ["ticker"], bound_cells(steps), bound_axes(steps), bound_scores, [-F.col("stop"), F.col("take")], shares, rounds=rounds)
    sized = rows.groupBy("ticker").agg(F.max("sigma").alias("sigma")).join(top, "ticker", "left")
    bound = lambda c, default: F.coalesce(c, F.lit(default)) * F.col("sigma")
    return sized.select("ticker", bound("stop", -2.0).alias("stop"), bound("take", 2.0).alias("take"), F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("score", F.lit(0.0)).alias("score"))


def basket_returns(held: DataFrame, *keys: str) -> DataFrame:
    """held(keys, ticker, date, spread, position) with ret: the position of the day before times the relative change of the spread."""
    order = Window.partitionBy(*keys, "ticker").orderBy("date")
    last = F.lag("spread").over(order)
    return held.withColumn("ret", F.lag("position").over(order) * (F.try_divide(F.col("spread"), last) - 1))


def basket_scores(rows: DataFrame) -> DataFrame:
    """rows(date, spread, dev, sd, cells) to what every cell comes to: _stop and _take in deviations, stop and take in units of the spread, trades, sharpe, kappa, win_rate and avg_ret."""
    cells = rows.withColumn("c", F.explode("cells")).withColumn("stop", F.col("c.stop") * F.col("sd")).withColumn("take", F.col("c.take") * F.col("sd"))
    cell = F.struct("stop", "take", F.col("c.stop").alias("_stop"), F.col("c.take").alias("_take"))
    keyed = cells.select(F.to_json(cell).alias("ticker"), cell.alias("cell"), "date", "spread", "dev", "stop", "take")
    held = basket_returns(keyed.join(basket_positions(keyed, F.col("stop"), F.col("take")), ["ticker", "date"]), "cell")
    x = F.col("ret")
    found = held.groupBy("cell").agg(
        F.count_if(F.col("position") != 0).alias("trades"), metrics.sharpe(x).alias("sharpe"), metrics.kappa(x).alias("kappa"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("avg_ret")
    )
    return found.select("cell.*", *(c for c in found.columns if c != "cell"))


def deviations(spread: DataFrame) -> DataFrame:
    """spread(date, spread) with its deviation from the mean, dev, and the standard deviation, sd."""
    line = Window.partitionBy(F.lit(0))  # one series, of as many rows as there are dates
    return spread.withColumn("dev", F.col("spread") - F.avg("spread").over(line)).withColumn("sd", F.stddev_samp("spread").over(line))


def basket_grid(spread: DataFrame, steps: int = 8) -> DataFrame:
    """spread(date, spread) to stop, take (in units of the spread), trades, sharpe, kappa, win_rate and avg_ret of every cell of a grid of two deviations either side."""
    return basket_scores(deviations(spread).withColumn("cells", bound_cells(steps))).drop("_stop", "_take")


def basket_bounds(spread: DataFrame, steps: int = 8, rounds: int = 0, shares: tuple[float, ...] = (1.0,)) -> DataFrame:
    """spread(date, spread) to stop, take, trades and sharpe of the cell that trades with the highest Sharpe ratio, the nearest to 0 of equal ones; rounds and shares are those of study.search()."""

    def scores(rows: DataFrame) -> DataFrame:
        found = basket_scores(rows).where("trades > 0 and sharpe is not null and not isnan(sharpe)")
        return found.select(F.lit(0).alias("one"), F.col("_stop").alias("stop"), F.col("_take").alias("take"), F.col("stop").alias("low"), F.col("take").alias("high"), "trades", F.col("sharpe").alias("score"))

    rows = deviations(spread).withColumn("one", F.lit(0))
    best = study.search(rows, ["one"], bound_cells(steps), bound_axes(steps), scores, [-F.col("stop"), F.col("take")], shares, rounds=rounds)
    return best.select(F.col("low").alias("stop"), F.col("high").alias("take"), "trades", F.col("score").alias("sharpe"))


def spread(prices: DataFrame, vector: DataFrame) -> DataFrame:
    """date, spread: the sum of log price times the vector(ticker, v)."""
    return prices.join(vector, "ticker").groupBy("date").agg(F.sum(F.ln("adj_close") * F.col("v")).alias("spread"))


def dynamic_kelly(returns: DataFrame, window: int = 30, least: int = 5) -> DataFrame:
    """Mean over variance, divided by 1 + the latest rolling deviation, within 0 and 1."""
    rolled = returns.withColumn("v", windows.rolling_std("ret", window, least))
    base = rolled.groupBy("ticker").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.max_by("v", F.when(F.col("v").isNotNull(), F.col("date"))).alias("v"))
    raw = F.try_divide(F.col("m"), F.col("s") * F.col("s")) / (1 + F.coalesce("v", "s"))
    return base.select("ticker", F.coalesce(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), F.lit(0.0)).alias("weight"))
