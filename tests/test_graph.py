"""Graph algorithms in rounds against the dense ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tests import dense

NAMES = [f"t{i:02d}" for i in range(24)]


def distances(n, seed):
    """Distances between points of a line with two digits, so many are equal."""
    made = np.random.default_rng(seed)
    x = made.random((n, 2)) if seed % 2 else np.round(made.random((n, 2)), 1)
    d = np.abs(x[:, None] - x).sum(2)
    return np.round(d, 2 if seed % 2 else 1)


def pairs(spark, d):
    rows = [(NAMES[i], NAMES[j], float(d[i, j])) for i, j in itertools.combinations(range(len(d)), 2)]
    return spark.createDataFrame(rows, "a string, b string, value double")


def labels_of(rows, n):
    """Clusters as dense.canonical numbers them."""
    got = {r["ticker"]: r["cluster"] for r in rows}
    order = sorted(set(got.values()), key=lambda c: min(NAMES.index(t) for t in got if got[t] == c))
    return [order.index(got[t]) if t in got else -1 for t in NAMES[:n]]


def test_tree_is_that_of_kruskal_with_ties(spark):
    edges, want = None, {}
    for g, seed in (("x", 1), ("y", 2), ("z", 4)):
        d = distances(14, seed)
        rows = pairs(spark, d).withColumn("g", F.lit(g))
        edges = rows if edges is None else edges.unionByName(rows)
        want[g] = dense.kruskal(d)
    got = {g: set() for g in want}
    for r in graph.spanning_tree(edges).collect():
        got[r["g"]].add((r["value"], NAMES.index(r["a"]), NAMES.index(r["b"])))
    assert got == {g: set(tree) for g, tree in want.items()}


def test_empty_graph_has_no_tree(spark):
    assert graph.spanning_tree(spark.createDataFrame([], "g string, a string, b string, value double")).collect() == []


def test_components_of_a_chain_a_star_and_lone_nodes(spark):
    edges = [("g", f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("g", "s", f"s{i}") for i in range(9)] + [("h", "c000", "s")]
    nodes = sorted({(g, x) for g, a, b in edges for x in (a, b)} | {("g", "alone")})
    found = graph.components(spark.createDataFrame(nodes, "g string, node string"), spark.createDataFrame(edges, "g string, a string, b string")).collect()
    groups = {}
    for r in found:
        groups.setdefault((r["g"], r["comp"]), set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [1, 2, 10, 41]


@pytest.mark.parametrize("least", [2, 3])
def test_density_clusters_are_those_of_the_sequential_walk(spark, least):
    cells = [(0.0, 9.0, 1.0), (0.1, 0.5, 1.0), (0.2, 0.3, 0.5), (0.3, 0.25, 1.0), (0.15, 0.15, 2.0)]
    for seed in (1, 3)[: 4 - least]:
        d = distances(20, seed)
        rows = graph.density_clusters(pairs(spark, d), cells, least).collect()
        for i, (epsilon, most, alpha) in enumerate(cells):
            assert labels_of([r for r in rows if r["cell"] == i], 20) == dense.hdbscan(d, least, epsilon, alpha, most).tolist(), (seed, i)


def test_density_scores_are_silhouettes_with_penalties(spark):
    d, cells = distances(20, 3), [(0.0, 9.0, 1.0), (0.1, 0.5, 1.0), (0.1, 0.6, 1.0), (9.0, 9.0, 1.0)]
    table = pairs(spark, d)
    labels = graph.density_clusters(table, cells)
    got = {r["cell"]: r["score"] for r in graph.density_scores(table, labels).collect()}
    for i, (epsilon, most, alpha) in enumerate(cells):
        assert got.get(i, -1.0) == pytest.approx(dense.density_score(d, dense.hdbscan(d, 2, epsilon, alpha, most)))


def test_communities_of_a_tree_are_the_greedy_ones_and_raise_modularity(spark):
    for seed in (1, 3):
        d = distances(18, seed) + 0.01 + np.random.default_rng(seed).random((18, 18)) * 1e-4
        d = np.triu(d, 1) + np.triu(d, 1).T
        tree = dense.kruskal(d)
        links = spark.createDataFrame([(NAMES[a], NAMES[b], v) for v, a, b in tree], "a string, b string, value double")
        found = graph.communities(links)
        got = {r["node"]: r["comp"] for r in found.collect()}
        want = dense.communities(18, [(v, a, b) for v, a, b in tree])
        assert len(set(got.values())) == len(set(want)) and all((got[NAMES[i]] == got[NAMES[j]]) == (want[i] == want[j]) for i in range(18) for j in range(18))
        alone = found.select("node", found["node"].alias("comp"))
        assert graph.modularity(links, found).first()[0] > graph.modularity(links, alone).first()[0]
        assert graph.modularity(links, found).first()[0] == pytest.approx(dense.modularity(18, tree, want))


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).cast("string").alias("x")).repartition(7)
    got = [r["x"] for r in graph.numbered(rows, "x", "i").orderBy("i").collect()]
    assert got == sorted(got) and graph.numbered(rows, "x", "i").agg(F.min("i"), F.max("i")).first() == (0, 999)


def gaps(x):
    return np.sqrt(((x[:, None] - x) ** 2).sum(2))


def test_spanning_tree_is_the_shortest_of_all(spark):
    d = np.random.default_rng(1).random((6, 6))
    d = (d + d.T) / 2
    edges = list(itertools.combinations(range(6), 2))

    def connected(tree):
        root = list(range(6))
        for a, b in tree:
            root = [root[a] if r == root[b] else r for r in root]
        return len(set(root)) == 1

    best = min(sum(d[e] for e in tree) for tree in itertools.combinations(edges, 5) if connected(tree))
    assert sum(x for x, _, _ in dense.spanning_tree(d)) == pytest.approx(best) == sum(x for x, _, _ in dense.kruskal(d))
    assert graph.spanning_tree(pairs(spark, d).withColumn("g", F.lit(""))).agg(F.sum("value")).first()[0] == pytest.approx(best)


def test_silhouette_equals_its_definition(spark):
    made = np.random.default_rng(2)
    x, labels, total = np.concatenate([made.normal(c, 0.1, (8, 2)) for c in ((0, 0), (5, 0), (0, 5))]), np.repeat([0, 1, 2], 8), []
    d = gaps(x)
    for i in range(len(x)):
        own = [d[i, j] for j in range(len(x)) if labels[j] == labels[i] and j != i]
        others = [np.mean([d[i, j] for j in range(len(x)) if labels[j] == c]) for c in set(labels) - {labels[i]}]
        total.append((min(others) - np.mean(own)) / max(min(others), np.mean(own)))
    assert dense.silhouette(d, labels) == pytest.approx(np.mean(total))
    table = spark.createDataFrame([(0, NAMES[i], str(c)) for i, c in enumerate(labels)], "cell int, ticker string, cluster string")
    assert [r["silhouette"] for r in graph.silhouettes(pairs(spark, d), table).orderBy("ticker").collect()] == pytest.approx(total)


def test_density_clusters_and_noise(spark):
    d = gaps(np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [50.0]]))
    assert dense.hdbscan(d, 2, epsilon=1.0, epsilon_max=10.0).tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert labels_of(graph.density_clusters(pairs(spark, d), [(1.0, 10.0, 1.0)]).collect(), 7) == [0, 0, 0, 1, 1, 1, -1]


def test_communities_of_two_groups(spark):
    d = np.full((6, 6), 0.95)
    d[:3, :3] = d[3:, 3:] = 0.1
    near = graph.spanning_tree(pairs(spark, d).withColumn("g", F.lit(""))).withColumn("value", 1 - F.col("value"))
    groups = {}
    for r in graph.communities(near).collect():
        groups.setdefault(r["comp"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [NAMES[:3], NAMES[3:6]]


def test_study_takes_the_best_point_of_grid_and_neighbours(spark):
    from tessera.plans import portfolio

    d = distances(20, 3) / 2
    epsilons, mosts, alphas, step = (0.05, 0.1), (0.3, 0.4), (0.5, 1.0), (0.01, 0.1, 0.1)
    score = lambda p: dense.density_score(d, dense.hdbscan(d, 2, p[0], p[2], p[1]))
    grid = list(itertools.product(epsilons, mosts, alphas))
    top = max(grid, key=score)  # the first of equal ones
    around = itertools.product(*([round(min(max(r), max(min(r), x + k * s)), 2) for k in (-1, 0, 1)] for x, s, r in zip(top, step, (epsilons, mosts, alphas))))
    best = max([score(top), *map(score, around)])
    found = portfolio.density_study(pairs(spark, d), epsilons, mosts, alphas, step)
    labels = {r["ticker"]: r["cluster"] for r in found.collect()}
    assert dense.density_score(d, np.array([labels[t] for t in NAMES[:20]])) == pytest.approx(best)
