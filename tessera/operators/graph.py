"""Spanning trees, components, density clusters and communities of graphs that are edge tables.

An edge is (g, a, b, value); g tells graphs apart that are worked on together, such as the points of a study. Every
algorithm works in rounds of joins and grouped minima; a round at least halves the nodes that are still open, and
nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import staged


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge (g, u, v, more) also from v to u."""
    return edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"), *more))


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name, their place (from 0) in the order of column: the parts of a sorted table are counted, and each counts on."""
    ordered = staged(rows.orderBy(column).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    parts = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each part
    joined = ordered.join(F.broadcast(before.drop("_n")), "_p")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_i") - F.col("_least")).drop("_p", "_i", "_least", "_before")


def roots(links: DataFrame) -> DataFrame:
    """links(g, u, to), one for each u, whose only cycles are pairs, to (g, u, to): the lesser of the pair that each chain ends in."""
    ahead = lambda rows: rows.select("g", F.col("u").alias("to"), F.col("to").alias("ahead"))
    next_ = F.coalesce("ahead", "to")
    cycle = (next_ == F.col("u")) & (F.col("u") < F.col("to"))
    now = links.join(ahead(links), ["g", "to"], "left").select("g", "u", F.when(cycle, F.col("u")).otherwise(F.col("to")).alias("to"))
    while True:
        after = staged(now.join(ahead(now), ["g", "to"], "left").select("g", "u", next_.alias("to"), (next_ != F.col("to")).alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def renamed(rows: DataFrame, root: DataFrame, *columns: str) -> DataFrame:
    """rows with the nodes in columns replaced by their roots."""
    for c in columns:
        rows = rows.join(root.select("g", F.col("u").alias(c), F.col("to").alias("_to")), ["g", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows


def spanning(edges: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A minimum spanning forest of edges(g, a, b, value) by Borůvka's rounds, and labels(g, node, comp) with the nodes' components.

    Each round every component takes its least edge to another, by value and then by names, and what these edges
    join is contracted; of the edges between two components only the least goes on.
    """
    tree = edges.select("g", "a", "b", "value").limit(0)
    now = edges.where("a <> b").select("g", F.col("a").alias("u"), F.col("b").alias("v"), F.struct("value", "a", "b").alias("e"))
    while True:
        now = staged(now)
        if now.isEmpty():
            return tree, labels
        least = staged(both_ways(now, "e").groupBy("g", "u").agg(F.min(F.struct("e", "v")).alias("m")))
        tree = tree.unionByName(least.select("g", "m.e.a", "m.e.b", "m.e.value").distinct())
        root = roots(least.select("g", "u", F.col("m.v").alias("to")))
        if labels is not None:
            labels = staged(renamed(labels, root, "comp"))
        ends = renamed(now, root, "u", "v").where("u <> v")
        now = ends.groupBy("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The tree edges of edges(g, a, b, value); of equal lengths the first by a and b counts."""
    return spanning(edges)[0]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(g, node) with comp, a node of the component that edges(g, a, b) make."""
    return spanning(edges.select("g", "a", "b", F.lit(0.0).alias("value")), nodes.select("g", "node", F.col("node").alias("comp")))[1]


def core_distances(pairs: DataFrame, least: int) -> DataFrame:
    """ticker, core: the distance to the least-th nearest of pairs(a, b, value), each ticker itself the first."""
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    if least < 2:
        return sides.select(F.col("a").alias("ticker"), F.lit(0.0).alias("core")).distinct()
    if least == 2:
        return sides.groupBy(F.col("a").alias("ticker")).agg(F.min("value").alias("core"))
    near = sides.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("value"))).where(F.col("_r") < least)
    return near.groupBy(F.col("a").alias("ticker")).agg(F.max("value").alias("core"))


def each(values: list) -> Column:
    """A row for each of a study's few values."""
    return F.explode(F.array(*map(F.lit, values)))


def reachability(pairs: DataFrame, least: int, alphas: list[float]) -> DataFrame:
    """Mutual reachability (g, a, b, value) of pairs for each scale, which is g as text."""
    core = core_distances(pairs, least)
    of = lambda side: core.select(F.col("ticker").alias(side), F.col("core").alias(f"_{side}"))
    far = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("g", each([str(x) for x in alphas]))
    return far.select("g", "a", "b", F.greatest("_a", "_b", F.col("value") / F.col("g").cast("double")).alias("value"))


def first_groups(nodes: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """(g, node, leaf, length): the groups that single linkage makes of least nodes or more out of two smaller ones, and at which length.

    Edges merge in order of length. A group's next merge is its least outgoing edge, so two groups that have the same one are
    merged by it; a group whose next edge leads into a large one founds nothing. Rounds go on while two
    groups make another that is still small.
    """
    small = nodes.select("g", "node", F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"))
    now, found = tree.select("g", F.col("a").alias("u"), F.col("b").alias("v"), F.struct("value", "a", "b").alias("e")), None
    while True:
        small, now = staged(small), staged(now)
        sizes = small.select("g", F.col("comp").alias("u"), "size").distinct()
        next_ = both_ways(now, "e").groupBy("g", "u").agg(F.min("e").alias("e"))
        pairs = next_.join(sizes, ["g", "u"]).groupBy("g", "e").agg(F.min("u").alias("to"), F.max("u").alias("u"), F.count("*").alias("k"), F.sum("size").alias("both"))
        merged = staged(pairs.where("k = 2").select("g", F.explode(F.array("u", "to")).alias("u"), "to", "both", F.col("e.value").alias("length")))
        large = merged.where(F.col("both") >= least)
        new = small.join(large, (small["comp"] == large["u"]) & (small["g"] == large["g"])).select(small["g"], "node", F.col("to").alias("leaf"), "length")
        found = new if found is None else found.unionByName(new)
        grown = merged.where(F.col("both") < least)
        if grown.isEmpty():
            return staged(found)
        kept = small.join(large.select("g", F.col("u").alias("comp")), ["g", "comp"], "left_anti")
        joined = kept.join(grown.select("g", F.col("u").alias("comp"), "to", "both"), ["g", "comp"], "left")
        small = joined.select("g", "node", F.coalesce("to", "comp").alias("comp"), F.coalesce("both", "size").alias("size"))
        now = renamed(now, merged.select("g", "u", "to"), "u", "v").where("u <> v")


def density_cells(tickers: DataFrame, tree: DataFrame, cells: list[tuple[float, float, float]], least: int = 2) -> tuple[DataFrame, list[int]]:
    """density_clusters() of tickers(node) by their trees (g, a, b, value), g a scale as text, but only in the first of cells with the same clusters; and the first for each cell.

    A tree's edges below a length are a beginning of it in order, so cells of one scale that have as many edges and lengths below their bounds have the same ones.
    """
    spark, alphas = tree.sparkSession, sorted({c[2] for c in cells})
    points = spark.createDataFrame([(i, float(e), float(m), str(a)) for i, (e, m, a) in enumerate(cells)], "cell int, epsilon double, most double, g string")
    at, short = F.col("cell").cast("string").alias("g"), (F.col("value") < F.col("epsilon")) & (F.col("value") <= F.col("most"))
    nodes = lambda keys: tickers.select(each(keys).alias("g"), "node")
    groups = first_groups(nodes([str(x) for x in alphas]), tree, least)
    edges = {r["cell"]: r["n"] for r in tree.join(F.broadcast(points), "g").where(short).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    lengths = {r["cell"]: (r["x"], r["y"]) for r in groups.join(F.broadcast(points), "g").groupBy("cell").agg(F.count_if(F.col("length") < F.col("epsilon")).alias("x"), F.count_if(F.col("length") <= F.col("most")).alias("y")).collect()}
    seen: dict[tuple, int] = {}
    like = [seen.setdefault((c[2], edges.get(i, 0), lengths.get(i, (0, 0))), i) for i, c in enumerate(cells)]
    first = sorted(seen.values())
    points = points.where(F.col("cell").isin(first))
    joined = components(nodes([str(i) for i in first]), tree.join(F.broadcast(points), "g").where(short).select(at, "a", "b"))
    whole = joined.withColumn("n", F.count("*").over(Window.partitionBy("g", "comp"))).where(F.col("n") >= least)
    leaves = groups.join(F.broadcast(points), "g").where("length between epsilon and most")
    found = whole.select(F.col("g").cast("int").alias("cell"), "node", "comp").unionByName(leaves.select("cell", "node", F.col("leaf").alias("comp")))
    return found.select("cell", F.col("node").alias("ticker"), F.min("node").over(Window.partitionBy("cell", "comp")).alias("cluster")), like


def density_clusters(pairs: DataFrame, cells: list[tuple[float, float, float]], least: int = 2) -> DataFrame:
    """cell, ticker and cluster (its first ticker) of the clustered tickers of pairs(a, b, value), for each of cells (epsilon, most, alpha).

    The hierarchy is single linkage over mutual reachability at scale alpha. Its leaves are clusters: the groups of least tickers or
    more that merge below epsilon, and those that are first that large between epsilon and most. The rest is noise.
    """
    tickers = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    tree = staged(spanning_tree(reachability(pairs, least, sorted({c[2] for c in cells}))))
    found, like = density_cells(tickers, tree, cells, least)
    of = pairs.sparkSession.createDataFrame(list(enumerate(like)), "own int, cell int")
    return found.join(F.broadcast(of), "cell").select(F.col("own").alias("cell"), "ticker", "cluster")


def silhouettes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, ticker, silhouette of labels(cell, ticker, cluster) under the distances of pairs(a, b, value): from sums by ticker and cluster; alone: 0."""
    of = labels.select("cell", F.col("ticker").alias("b"), F.col("cluster").alias("other"))
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    sums = sides.join(of, "b").groupBy("cell", "a", "other").agg(F.avg("value").alias("mean"))
    own = sums.join(labels.withColumnRenamed("ticker", "a"), ["cell", "a"])
    same = F.col("other") == F.col("cluster")
    means = own.groupBy("cell", F.col("a").alias("ticker")).agg(F.max(F.when(same, F.col("mean"))).alias("x"), F.min(F.when(~same, F.col("mean"))).alias("y"))
    value = (F.col("y") - F.col("x")) / F.greatest("x", "y", F.lit(1e-12))
    return means.select("cell", "ticker", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), value).otherwise(F.lit(0.0)).alias("silhouette"))


def mean_silhouettes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, s: the mean of silhouettes()."""
    return silhouettes(pairs, labels).groupBy("cell").agg(F.avg("silhouette").alias("s"))


def density_scores(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """scores() under the distances of pairs(a, b, value)."""
    tickers = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return scores(tickers, labels, lambda apart: mean_silhouettes(pairs, apart))


def scores(tickers: DataFrame, labels: DataFrame, means: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cell and score of the cells with any cluster: the silhouette of the clustered, less penalties for one large or for few clusters; -1 for fewer than two clusters.

    Cells with the same clusters are worked out once, in the first of them. means gives the mean silhouettes (cell, s) of labels.
    """
    mark = labels.groupBy("cell").agg(F.bit_xor(F.xxhash64("ticker", "cluster")).alias("h"), F.count("*").alias("n"))
    first = mark.groupBy("h", "n").agg(F.min("cell").alias("first"))
    same = staged(mark.join(first, ["h", "n"]).select("cell", "first"))
    apart = staged(labels.join(same.select(F.col("first").alias("cell")).distinct(), "cell", "left_semi"))
    total = tickers.agg(F.count("*").alias("total"))
    sizes = apart.groupBy("cell", "cluster").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("big"), F.count("*").alias("k"))
    zero = F.lit(0.0)
    many = 0.5 * F.greatest(zero, F.col("big") / F.col("total") - 0.05) + 0.5 * F.greatest(zero, F.ceil(F.sqrt("total")) - F.col("k"))
    joined = sizes.join(means(apart), "cell", "left").join(F.broadcast(total))  # one row
    scored = joined.select(F.col("cell").alias("first"), F.when(F.col("k") < 2, -1.0).otherwise(F.col("s") - many).alias("score"))
    return same.join(scored, "first").select("cell", "score")


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels(node, comp) in the graph links(a, b, value)."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    ends = links.join(of("a"), "a").join(of("b"), "b")
    mass = ends.select(F.explode(F.array("_a", "_b")).alias("c"), "value").groupBy("c").agg(F.sum("value").alias("m"))
    inside = ends.agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("value")).otherwise(0.0)).alias("i"), F.sum("value").alias("w"))
    squares = mass.agg(F.sum(F.col("m") * F.col("m")).alias("q"))
    return inside.join(squares).select((F.col("i") / F.col("w") - F.col("q") / (4 * F.col("w") * F.col("w"))).alias("modularity"))  # one row each


def communities(links: DataFrame) -> DataFrame:
    """node, comp: communities of the weighted graph links(a, b, value), one link for each pair, by greedy modularity.

    Each round joins the pairs of communities that are each other's best, if modularity rises, and contracts them. Merges of others
    don't change what a pair gains, and in a tree they only lower what its ends gain elsewhere, so there the result is that of
    merging one best pair after another. Of equal gains the first names count.
    """
    now = links.select(F.lit("").alias("g"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("value").alias("w"))
    labels = staged(links.select(F.lit("").alias("g"), F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    now = staged(now)
    mass = staged(both_ways(now, "w").groupBy("g", "u").agg(F.sum("w").alias("m")))
    whole = mass.agg(F.sum("m")).first()[0]
    while True:
        m = lambda c: mass.select("g", F.col("u").alias(c), F.col("m").alias(f"m{c}"))
        gain: Column = F.col("w") / whole - F.col("mu") * F.col("mv") / (whole * whole)
        gains = now.join(m("u"), ["g", "u"]).join(m("v"), ["g", "v"]).select("g", "u", "v", (-gain).alias("loss")).where("loss < -1e-15")
        edge = F.struct("loss", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
        best = both_ways(gains, "loss").groupBy("g", "u").agg(F.min(edge).alias("e"))
        pairs = best.groupBy("g", "e").agg(F.count("*").alias("k")).where("k = 2")
        root = staged(pairs.select("g", F.col("e.q").alias("u"), F.col("e.p").alias("to")))
        if root.isEmpty():
            return labels.select("node", "comp")
        labels = staged(renamed(labels, root, "comp"))
        mass = staged(renamed(mass, root, "u").groupBy("g", "u").agg(F.sum("m").alias("m")))
        ends = renamed(now, root, "u", "v").where("u <> v")
        now = staged(ends.groupBy("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w")))
