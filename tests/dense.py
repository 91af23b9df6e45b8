"""Dense and sequential versions of the clustering algorithms, to compare with."""

import numpy as np


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of labels under distances d."""
    ids = np.unique(labels)
    if len(ids) < 2:
        return -1.0
    member = (labels[:, None] == ids).astype(float)
    sums, sizes = d @ member, member.sum(0)
    own = member.argmax(1)
    n = sizes[own]
    a = sums[np.arange(len(d)), own] / np.maximum(n - 1, 1)
    means = sums / sizes
    means[np.arange(len(d)), own] = np.inf
    b = means.min(1)
    return float(np.where(n > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def canonical(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered by first appearance; -1 stays."""
    seen: dict[int, int] = {}
    return np.array([-1 if v < 0 else seen.setdefault(int(v), len(seen)) for v in labels])


def spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (length, a, b) of a minimum spanning tree, shortest first."""
    n, near, to, out = len(d), d[0].copy(), np.zeros(len(d), int), []
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, near).argmin())
        out.append((float(near[j]), int(to[j]), j))
        inside[j] = True
        closer = d[j] < near
        near[closer], to[closer] = d[j][closer], j
    return sorted(out)


def hdbscan(d: np.ndarray, least: int = 2, epsilon: float = 0.0, alpha: float = 1.0, epsilon_max: float = np.inf) -> np.ndarray:
    """Leaf clusters of the density hierarchy over mutual reachability; -1 is noise."""
    n = len(d)
    if n < least:
        return np.full(n, -1)
    d = d.copy()
    np.fill_diagonal(d, 0)
    core = np.sort(d, 1)[:, min(least, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d / alpha)
    group: dict[int, list[int]] = {i: [i] for i in range(n)}
    of, leaves, birth = list(range(n)), {}, {}
    for length, a, b in kruskal(reach):
        x, y = of[a], of[b]
        big = [g for g in (x, y) if len(group[g]) >= least]
        merged = group[x] + group[y]
        key = min(x, y)
        below = [v for g in big for v in leaves.pop(g, [])]
        if len(big) == 2 and length >= epsilon:
            now = below
        elif below and length >= epsilon:
            now = below
        else:
            now = [merged] if len(merged) >= least and length <= epsilon_max else below
        if not big and len(merged) >= least and length <= epsilon_max:
            now = [merged]
        group.pop(x), group.pop(y)
        group[key], leaves[key], birth[key] = merged, now, length
        for i in merged:
            of[i] = key
    labels = np.full(n, -1)
    for k, leaf in enumerate(v for vs in leaves.values() for v in vs):
        labels[leaf] = k
    return canonical(labels)


def kruskal(d):
    """Edges (length, a, b) of the spanning tree that takes edges in order of length and names."""
    n, root, out = len(d), list(range(len(d))), []
    for length, a, b in sorted((float(d[i, j]), i, j) for i in range(n) for j in range(i + 1, n)):
        if root[a] != root[b]:
            out.append((length, a, b))
            root = [root[a] if r == root[b] else r for r in root]
    return out


def density_score(d, labels):
    """Silhouette of the clustered, less penalties for one large or for few clusters; -1 for fewer than two."""
    inside = labels >= 0
    k = len(np.unique(labels[inside]))
    if k < 2:
        return -1.0
    most = np.bincount(labels[inside]).max() / len(d)
    return silhouette(d[np.ix_(inside, inside)], labels[inside]) - 0.5 * max(0.0, most - 0.05) - 0.5 * max(0.0, np.ceil(np.sqrt(len(d))) - k)


def modularity(n, edges, labels):
    whole = 2 * sum(w for w, _, _ in edges)
    mass = [0.0] * n
    for w, a, b in edges:
        mass[a] += w
        mass[b] += w
    return sum((2 * w / whole if labels[a] == labels[b] else 0.0) for w, a, b in edges) - sum(sum(mass[i] for i in range(n) if labels[i] == c) ** 2 for c in set(labels)) / whole**2


def communities(n, edges):
    """One best merge after another, while modularity rises."""
    labels = list(range(n))
    while True:
        now, tried = modularity(n, edges, labels), []
        for a, b in {tuple(sorted((labels[a], labels[b]))) for _, a, b in edges if labels[a] != labels[b]}:
            tried.append((modularity(n, edges, [a if x == b else x for x in labels]) - now, a, b))
        if not tried or max(tried)[0] <= 1e-12:
            return labels
        _, a, b = max(tried)
        labels = [a if x == b else x for x in labels]
