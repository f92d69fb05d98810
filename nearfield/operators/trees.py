"""Search trees over the points of one shard: k-means, pivot, randomized and single k-d trees as flat node rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.vectors import Metric


@dataclass
class Params:
    """Build and search settings of all kinds of index; each kind reads its own."""

    algorithm: str = "kmeans"  # linear, kdtree, kdtree_single, kmeans, hierarchical, composite, lsh, autotuned
    metric: str = "l2"
    p: float = 2.0
    trees: int = 4
    branching: int = 32
    iterations: int = 11
    centers: str = "random"  # random, gonzales, kmeanspp, groupwise
    cb_index: float = 0.2
    leaf_size: int = 10
    tables: int = 12
    key_size: int = 20
    probe_level: int = 2
    target_precision: float = 0.8
    sample_fraction: float = 0.1
    build_weight: float = 0.01
    memory_weight: float = 0.0
    seed: int = 0


@dataclass
class Node:
    parent: int
    depth: int
    rows: np.ndarray
    pivot: np.ndarray
    radius: float
    variance: float
    low: np.ndarray
    high: np.ndarray
    children: list[int] = field(default_factory=list)


class Tree:
    """Nodes from the root on; a leaf's ``rows`` are its points, an inner node's are dropped after its children exist."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []

    def add(self, parent: int, rows: np.ndarray, data: np.ndarray, pivot: np.ndarray | None, block: Callable) -> int:
        part = data[rows]
        pivot = part.mean(axis=0) if pivot is None else pivot
        dist = block(pivot[None, :], part)[0]
        node = Node(parent, 0 if parent < 0 else self.nodes[parent].depth + 1, rows, pivot, float(dist.max()), float(dist.mean()), part.min(axis=0), part.max(axis=0))
        self.nodes.append(node)
        if parent >= 0:
            self.nodes[parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1


def pick_centers(data: np.ndarray, k: int, how: str, block: Callable, rng: np.random.Generator) -> np.ndarray:
    """Places of up to k distinct points to start clusters from."""
    first = int(rng.integers(len(data)))
    if how == "random":
        order, chosen = rng.permutation(len(data)), []
        for i in order:
            if not chosen or block(data[i][None, :], data[chosen])[0].min() > 1e-16:
                chosen.append(int(i))
            if len(chosen) == k:
                break
        return np.array(chosen)
    chosen = [first]
    near = block(data[first][None, :], data)[0]
    while len(chosen) < k and near.max() > 0:
        if how == "gonzales":
            new = int(near.argmax())
        elif how == "groupwise":  # of a few far points the one that lowers the sum of distances most
            tries = np.argsort(-near)[: 1 + len(data) // 10]
            tries = rng.choice(tries, min(16, len(tries)), replace=False)
            new = int(min(tries, key=lambda t: np.minimum(near, block(data[t][None, :], data)[0]).sum()))
        else:  # kmeanspp: in proportion to the (squared) distance
            new = int(rng.choice(len(data), p=near / near.sum()))
        chosen.append(new)
        near = np.minimum(near, block(data[new][None, :], data)[0])
    return np.array(chosen)


def lloyd(data: np.ndarray, k: int, how: str, iterations: int, block: Callable, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Centers and assignment, or None where the points have fewer than k distinct values. No cluster stays empty."""
    start = pick_centers(data, k, how, block, rng)
    if len(start) < k:
        return None
    centers, of = data[start].copy(), None
    for _ in range(iterations if iterations >= 0 else 1000):
        new = block(centers, data).argmin(axis=0)
        for c in np.flatnonzero(np.bincount(new, minlength=k) == 0):
            large = np.bincount(new, minlength=k).argmax()
            members = np.flatnonzero(new == large)
            new[members[block(centers[large][None, :], data[members])[0].argmax()]] = c
        if of is not None and (new == of).all():
            break
        of = new
        centers = np.stack([data[of == c].mean(axis=0) for c in range(k)])
    if of is None:
        of = block(centers, data).argmin(axis=0)
    return centers, of


def kmeans_tree(data: np.ndarray, params: Params, metric: Metric, rng: np.random.Generator, least: int = 0) -> Tree:
    """Nodes of up to ``least`` points aren't split, here and in the other trees."""
    tree = Tree()
    todo = [tree.add(-1, np.arange(len(data)), data, None, metric.block)]
    while todo:
        at = todo.pop()
        rows = tree.nodes[at].rows
        if len(rows) < params.branching or len(rows) <= least:
            continue
        found = lloyd(data[rows], params.branching, params.centers, params.iterations, metric.block, rng)
        if found is None or len(np.unique(found[1])) < 2:
            continue
        for c, center in enumerate(found[0]):
            if (own := rows[found[1] == c]).size:
                todo.append(tree.add(at, own, data, center, metric.block))
        tree.nodes[at].rows = rows[:0]
    return tree


def pivot_tree(data: np.ndarray, params: Params, metric: Metric, rng: np.random.Generator, least: int = 0) -> Tree:
    """Children are given by chosen points and one assignment; any distance will do."""
    tree = Tree()
    todo = [tree.add(-1, np.arange(len(data)), data, data[0], metric.block)]
    while todo:
        at = todo.pop()
        rows = tree.nodes[at].rows
        if len(rows) <= max(params.leaf_size, 2, least):
            continue
        start = pick_centers(data[rows], min(params.branching, len(rows)), params.centers, metric.block, rng)
        if len(start) < 2:
            continue
        of = metric.block(data[rows][start], data[rows]).argmin(axis=0)
        if len(np.unique(of)) < 2:
            continue
        for c in np.unique(of):
            todo.append(tree.add(at, rows[of == c], data, data[rows][start[c]], metric.block))
        tree.nodes[at].rows = rows[:0]
    return tree


def kd_tree(data: np.ndarray, params: Params, metric: Metric, rng: np.random.Generator, randomized: bool, least: int = 0) -> Tree:
    """Splits at the mean of a random high-variance dimension, or in the middle of the widest one."""
    tree = Tree()
    todo = [tree.add(-1, np.arange(len(data)), data, None, metric.block)]
    while todo:
        at = todo.pop()
        node = tree.nodes[at]
        rows = node.rows
        if len(rows) <= max(least, 1 if randomized else params.leaf_size) or (node.low == node.high).all():
            continue
        if randomized:
            sample = data[rows if len(rows) <= 100 else rng.choice(rows, 100, replace=False)]
            top = np.argsort(-sample.var(axis=0), kind="stable")[:5]
            dim = int(rng.choice(top))
            cut = sample[:, dim].mean()
        else:
            dim = int((node.high - node.low).argmax())
            cut = (node.low[dim] + node.high[dim]) / 2
        left = data[rows, dim] < cut
        if left.all() or not left.any():
            order = np.argsort(data[rows, dim], kind="stable")
            left = np.zeros(len(rows), bool)
            left[order[: len(rows) // 2]] = True
        for side in (left, ~left):
            todo.append(tree.add(at, rows[side], data, None, metric.block))
        node.rows = rows[:0]
    return tree


def build(data: np.ndarray, params: Params, metric: Metric, exact: bool = False) -> list[tuple[str, Tree]]:
    """Trees of the asked kind, each with the kind of bound that its search uses.

    ``exact``: only what the exact search looks at, the first tree down to nodes of ``DENSE`` points, which it measures whole.
    """
    rng = np.random.default_rng(params.seed)
    kind, least = params.algorithm, DENSE if exact else 0
    if kind in ("kdtree", "kdtree_single", "composite", "autotuned") and not metric.kd:
        raise ValueError(f"{kind} needs a distance that adds up over dimensions")
    if kind in ("kmeans", "composite", "autotuned") and not metric.vector_space:
        raise ValueError(f"{kind} needs a vector space distance")
    if kind == "kmeans" or kind == "composite" and exact:
        return [("ball", kmeans_tree(data, params, metric, rng, least))]
    many = range(1 if exact else params.trees)
    if kind == "hierarchical":
        return [("ball", pivot_tree(data, params, metric, rng, least)) for _ in many]
    if kind == "kdtree":
        return [("box", kd_tree(data, params, metric, rng, True, least)) for _ in many]
    if kind == "kdtree_single":
        return [("box", kd_tree(data, params, metric, rng, False, least))]
    if kind == "composite":
        return [("ball", kmeans_tree(data, params, metric, rng)), *(("box", kd_tree(data, params, metric, rng, True)) for _ in many)]
    raise ValueError(f"no such index: {kind}")


#: How distances become a metric, for which the triangle inequality bounds a ball.
_ROOT = {"l2": np.sqrt, "l1": float, "max": float, "hamming": float}


def search(trees: list[tuple[str, Tree]], data: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, params: Params, metric: Metric, checks: int = 32, eps: float = 0.0, radius: float = np.inf) -> tuple[list[tuple[float, int]], int]:
    """The k nearest (distance, id) that the search meets, and the number of distances it computed.

    Branches of all trees wait in one queue. With ``checks`` below 0 the order is by lower bound and the search ends
    when no branch can hold a better point (to a factor 1 + eps); otherwise it ends after ``checks`` points once k are
    known, and a ball waits by center distance less ``cb_index`` times its variance.
    """
    root = _ROOT.get(params.metric)
    if checks < 0:
        trees = trees[:1]  # each tree holds all points
    seen = np.zeros(len(data), bool)
    best: list[tuple[float, int]] = []  # negated, worst first
    computed = 0
    q = query[None, :]

    def worst() -> float:
        return -best[0][0] if len(best) == k else radius

    def bounds(kind: str, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal computed
        if kind == "box":
            low, high = np.stack([n.low for n in nodes]), np.stack([n.high for n in nodes])
            closest = np.clip(q, low, high)
            lower = np.array([metric.block(q, c[None, :])[0, 0] for c in closest])
            return lower, lower
        dist = metric.block(q, np.stack([n.pivot for n in nodes]))[0]
        computed += len(nodes)
        lower = np.zeros(len(nodes))
        if root is not None:
            gap = np.array([max(0.0, root(d) - root(n.radius)) for d, n in zip(dist, nodes)])
            lower = gap**2 if params.metric == "l2" else gap
        return lower, dist - params.cb_index * np.array([n.variance for n in nodes])

    queue: list[tuple[float, int, int, int]] = [(0.0, t, 0, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    lowers = {(t, 0): 0.0 for t in range(len(trees))}
    met = 0
    while queue:
        _, t, _, at = heapq.heappop(queue)
        lower = lowers.pop((t, at))
        if checks >= 0 and met >= checks and len(best) == k:
            break
        if lower * (1 - 1e-12) * (1 + eps) > worst():
            continue
        kind, tree = trees[t]
        node = tree.nodes[at]
        if node.children:
            low, order = bounds(kind, [tree.nodes[c] for c in node.children])
            for c, lo, o in zip(node.children, low, order):
                lowers[t, c] = lo
                heapq.heappush(queue, (float(lo if checks < 0 else o), t, -tree.nodes[c].depth, c))
            continue
        rows = node.rows[~seen[node.rows]]
        if not len(rows):
            continue
        seen[rows] = True
        dist = metric.block(q, data[rows])[0]
        computed += len(rows)
        met += len(rows)
        for d, i in zip(dist.tolist(), ids[rows].tolist()):
            if d < radius and (len(best) < k or (-d, -i) > best[0]):
                (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (-d, -i))
    return sorted((-d, -i) for d, i in best), computed


#: Below so many points a node's points are measured together, which costs less than bounding its children one by one.
DENSE = 64
#: Numbers of one intermediate matrix.
CELLS = 4 << 20


def search_many(trees: list[tuple[str, Tree]], data: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, params: Params, metric: Metric, checks: int = 32, eps: float = 0.0, radius: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for many queries: place of the query, distance and id of each hit (by query, best first), and the
    number of distances for each query.

    The exact search takes all queries down a tree together. A search with a budget orders balls by matrix products;
    boxes, or a radius beside a budget, go query by query.
    """
    if checks < 0:
        return _exact(*trees[0], data, ids, queries, k, params, metric, eps, radius)
    if radius == np.inf and all(kind == "ball" for kind, _ in trees):
        return _budgeted([tree for _, tree in trees], data, ids, queries, k, params, metric, checks, eps)
    found = [search(trees, data, ids, q, k, params, metric, checks, eps, radius) for q in queries]
    hits = [(i, d, at) for i, (best, _) in enumerate(found) for d, at in best]
    place, dist, at = zip(*hits) if hits else ((), (), ())
    return np.array(place, np.int64), np.array(dist, float), np.array(at, np.int64), np.array([c for _, c in found], np.int64)


def none(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k best hits of queries that have none yet."""
    return np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)


def search_shards(shards: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, k: int, params: Params, metric: Metric, eps: float = 0.0, radius: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The exact search through several shards (points and ids), one after another, as of ``search_many``: what it looks
    at of a shard's trees is built here, and the best hits so far bound the search of the next shard."""
    known, computed = none(len(queries), k), np.zeros(len(queries), np.int64)
    for data, ids in shards:
        computed += _exact(*build(data, params, metric, exact=True)[0], data, ids, queries, k, params, metric, eps, radius, known)[3]
    return *_flat(*known), computed


def _flat(best: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, at = np.nonzero(best < np.inf)
    return place, best[place, at], names[place, at]


def _exact(kind: str, tree: Tree, data: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, params: Params, metric: Metric, eps: float, radius: float, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The queries that a node may still serve go down to its children, those with the least bounds first.

    ``known``: distances and ids of the best hits so far, from other points; they bound the search and are replaced in place.
    """
    nodes, root = tree.nodes, _ROOT.get(params.metric)
    size = [len(n.rows) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    best, names = known or none(len(queries), k)
    computed = np.zeros(len(queries), np.int64)

    def open_(who: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return lower * (1 - 1e-12) * (1 + eps) <= np.minimum(best[who, -1], radius)

    def lowers(n: Node, who: np.ndarray) -> np.ndarray:
        q = queries[who]
        if kind == "box":
            return metric.paired(q, np.clip(q, n.low, n.high))
        computed[who] += 1
        if root is None:
            return np.zeros(len(who))
        gap = np.maximum(0.0, root(metric.block(n.pivot[None, :], q)[0]) - root(n.radius)) if root is np.sqrt else np.maximum(0.0, metric.block(n.pivot[None, :], q)[0] - n.radius)
        return gap**2 if params.metric == "l2" else gap

    def below(i: int) -> np.ndarray:
        return np.concatenate([nodes[i].rows, *map(below, nodes[i].children)])

    def measure(who: np.ndarray, rows: np.ndarray) -> None:
        worst = np.minimum(best[who, -1], radius)
        if metric.rough is None:
            first, off = metric.block(queries[who], data[rows]), 0.0
        else:
            first, off = metric.rough(queries[who], data[rows])
        computed[who] += len(rows)
        if len(rows) > k:
            worst = np.minimum(worst, np.partition(first, k - 1, axis=1)[:, k - 1] + off)
        at, col = np.nonzero(first <= worst[:, None] + 2 * off)
        if not len(at):
            return
        dist = first[at, col] if metric.rough is None else metric.paired(queries[who[at]], data[rows[col]])
        some, at, many = np.unique(at, return_inverse=True, return_counts=True)
        width = int(many.max())
        col_of = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        d, i = np.full((len(some), k + width), np.inf), np.full((len(some), k + width), np.iinfo(np.int64).max)
        some = who[some]
        d[:, :k], i[:, :k] = best[some], names[some]
        d[at, k + col_of], i[at, k + col_of] = np.where(dist < radius, dist, np.inf), ids[rows[col]]
        order = np.lexsort((i, d), axis=1)[:, :k]
        best[some], names[some] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        i, who, lower = todo.pop()
        who = who[open_(who, lower)]
        if not len(who) or not size[i]:
            continue
        if not nodes[i].children or size[i] <= DENSE:
            rows = below(i)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                for some in np.array_split(who, -(-len(who) * len(part) // CELLS)):
                    measure(some, part)
            continue
        bounds = [(c, lowers(nodes[c], who)) for c in nodes[i].children]
        todo += [(c, who, b) for c, b in sorted(bounds, key=lambda x: -x[1].mean())]
    return *_flat(best, names), computed


def _budgeted(trees: list[Tree], data: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, params: Params, metric: Metric, checks: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of balls without a queue.

    A queue gives a node after all those of which the greatest key on the way from the root is less. So points sorted
    by that key stand in the order of the search; only those that share the key at which the budget ends (below one
    ancestor) need a queue. Branches that the hits so far rule out are left out, and their share of the budget goes to
    the next ones; so the hits are at least as good as those of ``search``. Keys come from matrix products; ``computed`` counts what the search would measure.
    """
    first = np.concatenate([[0], np.cumsum([len(t.nodes) for t in trees])]).astype(np.int64)
    nodes = [n for t in trees for n in t.nodes]
    parent = np.concatenate([[n.parent + at if n.parent >= 0 else -1 for n in t.nodes] for t, at in zip(trees, first)]).astype(np.int64)
    depth, children = np.array([n.depth for n in nodes]), np.array([len(n.children) for n in nodes])
    pivots, slack = np.stack([n.pivot for n in nodes]), params.cb_index * np.array([n.variance for n in nodes])
    radii, root = np.array([n.radius for n in nodes]), {"l2": np.sqrt, "l1": np.array, "max": np.array, "hamming": np.array}.get(params.metric)
    below = [[c + at for c in n.children] for t, at in zip(trees, first) for n in t.nodes]
    leaf = np.zeros((len(trees), len(data)), np.int64)
    for t, (tree, at) in enumerate(zip(trees, first)):
        for i, n in enumerate(tree.nodes):
            leaf[t, n.rows] = at + i
    levels = [np.flatnonzero(depth == x) for x in range(1, depth.max(initial=0) + 1)]
    most = min(len(data), max(checks, k))
    far = lambda q, p: metric.rough(q, p) if metric.rough else (metric.block(q, p), 0.0)
    best, names = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    computed = np.zeros(len(queries), np.int64)
    step = max(1, CELLS // max(len(data), len(nodes), 1))
    for at in range(0, len(queries) if len(data) else 0, step):
        some = queries[at : at + step]
        dist, apart = far(some, pivots)
        own = np.ascontiguousarray((dist - slack).T)
        way = own.copy()
        way[parent < 0] = -np.inf
        for x in levels:
            way[x] = np.maximum(way[x], way[parent[x]])
        met = np.ascontiguousarray(np.minimum.reduce([way[of] for of in leaf]).T)
        rough, off = far(some, data)

        def look() -> None:
            met = way[leaf[0]]
            for of in leaf[1:]:
                met = np.minimum(met, way[of])
            met = np.ascontiguousarray(met.T)
            edge = np.partition(met, most - 1, axis=1)[:, most - 1]
            for j, q in enumerate(some):
                taken = met[j] < (edge[j] if edge[j] == np.inf else np.nextafter(edge[j], np.inf))
                if np.count_nonzero(taken) > most:  # below the last ancestor, a queue of its own until the budget is spent
                    taken = met[j] < edge[j]
                    last = way[:, j] == edge[j]
                    queue = [(own[x, j], -depth[x], x) for x in np.flatnonzero(last) if parent[x] < 0 or not last[parent[x]]]
                    heapq.heapify(queue)
                    left = most - np.count_nonzero(taken)
                    while left > 0:
                        x = heapq.heappop(queue)[2]
                        for c in below[x]:
                            if last[c]:
                                heapq.heappush(queue, (own[c, j], -depth[c], c))
                        new = nodes[x].rows[~taken[nodes[x].rows]]
                        taken[new] = True
                        left -= len(new)
                rows = np.flatnonzero(taken)
                d = rough[j, rows]
                if len(rows) > k:
                    rows = rows[d <= np.partition(d, k - 1)[k - 1] + 2 * off]
                d = metric.block(q[None, :], data[rows])[0]
                order = np.lexsort((ids[rows], d))[:k]
                best[at + j, : len(order)], names[at + j, : len(order)] = d[order], ids[rows][order]
                computed[at + j] = np.count_nonzero(taken)
            computed[at : at + step] += children @ (way <= np.minimum(edge, np.finfo(float).max))

        look()
        if root is not None:  # what can't hold a better point leaves its share of the budget to others
            bound = np.maximum(0.0, root(np.maximum(0.0, dist - apart)) - root(radii))
            bound = np.ascontiguousarray((bound**2 if params.metric == "l2" else bound).T)
            for x in levels:
                bound[x] = np.maximum(bound[x], bound[parent[x]])
            shut = bound * (1 - 1e-12) * (1 + eps) > best[at : at + step, -1]
            if shut[leaf].any():
                way[shut] = np.inf
                look()
    return *_flat(best, names), computed


def cut(tree: Tree, clusters: int) -> np.ndarray:
    """Centers of a cut of the tree into at most ``clusters`` parts, splitting first what lowers the variance most."""
    nodes = tree.nodes

    def size(n: int) -> int:
        node = nodes[n]
        return len(node.rows) if not node.children else sum(map(size, node.children))

    weight = [size(n) * nodes[n].variance for n in range(len(nodes))]
    parts = [0]
    while True:
        options = [(weight[n] - sum(weight[c] for c in nodes[n].children), n) for n in parts if nodes[n].children and len(parts) - 1 + len(nodes[n].children) <= clusters]
        if not options:
            return np.stack([nodes[n].pivot for n in parts])
        n = max(options, key=lambda o: (o[0], -o[1]))[1]
        parts = [x for x in parts if x != n] + nodes[n].children
