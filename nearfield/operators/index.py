"""Indexes as tables: a shard's points get their trees in one task, queries meet all shards, the best hits win."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import metric
from . import lsh, trees
from .knn import alive, knn_join, matrix, query_blocks, ranked
from .ranking import neighbor_precision
from .trees import Params

#: Points of one shard, whose trees one task builds and searches in memory.
SHARD_ROWS = 50_000
#: Queries that make it worth while to hand a shard to one more task.
PART_QUERIES = 256
#: Queries that show where a target precision may be reached, before all are measured.
FIRST_QUERIES = 512

NODES = "shard int, tree int, kind string, node int, parent int, depth int, is_leaf boolean, pivot array<double>, radius double, variance double, low array<double>, high array<double>, members array<bigint>"
HITS = "qid bigint, id bigint, dist double, n_distances bigint"


def _rows(shard: int, forest: list[tuple[str, trees.Tree]], ids: np.ndarray) -> list[dict]:
    return [
        {"shard": shard, "tree": t, "kind": kind, "node": i, "parent": n.parent, "depth": n.depth, "is_leaf": not n.children, "pivot": n.pivot.tolist(), "radius": n.radius, "variance": n.variance, "low": n.low.tolist(), "high": n.high.tolist(), "members": ids[n.rows].tolist()}
        for t, (kind, tree) in enumerate(forest)
        for i, n in enumerate(tree.nodes)
    ]


def _forest(nodes: pa.Table, ids: np.ndarray) -> list[tuple[str, trees.Tree]]:
    """Trees from node rows; members that aren't among ``ids`` (removed since) are left out."""
    order = np.argsort(ids)
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")]).combine_chunks()
    of, kinds, parents, depths, radii, variances = (nodes[c].to_pylist() for c in ("tree", "kind", "parent", "depth", "radius", "variance"))
    pivots, lows, highs = (matrix(nodes[c].combine_chunks()) for c in ("pivot", "low", "high"))
    members = nodes["members"].combine_chunks()
    ends = np.cumsum(members.value_lengths().to_numpy())
    members = members.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.searchsorted(ids, members, sorter=order).clip(max=max(0, len(ids) - 1))
    rows = order[at] if len(ids) else np.zeros(len(members), np.int64)
    alive_ = ids[rows] == members if len(ids) else np.zeros(len(members), bool)
    made: dict[int, tuple[str, trees.Tree]] = {}
    for i, t in enumerate(of):
        tree = made.setdefault(t, (kinds[i], trees.Tree()))[1]
        own = slice(ends[i - 1] if i else 0, ends[i])
        tree.nodes.append(trees.Node(parents[i], depths[i], rows[own][alive_[own]], pivots[i], radii[i], variances[i], lows[i], highs[i]))
        if parents[i] >= 0:
            tree.nodes[parents[i]].children.append(len(tree.nodes) - 1)
    return [made[t] for t in sorted(made)]


def _dtype(points: DataFrame) -> type:
    return np.int64 if points.schema["vec"].dataType.elementType.simpleString() == "bigint" else np.float64


@dataclass
class Index:
    """Handle of an index: its settings, its points (``id, vec, shard``), its nodes, later additions and tombstones."""

    params: Params
    points: DataFrame
    nodes: DataFrame | None
    size_at_build: int
    shards: int
    delta: DataFrame | None = None
    removed: DataFrame | None = None
    #: Whether nobody keeps the nodes, so that each search would build them anew.
    passing: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def size(self) -> int:
        """Number of points, without removed ones."""
        return alive(self._all(), self.removed).count()

    def veclen(self) -> int:
        return self.points.select(F.size("vec")).first()[0]

    def get_point(self, id_: int) -> DataFrame:
        return alive(self._all(), self.removed).where(F.col("id") == id_)

    def used_memory(self) -> int:
        """Bytes of the vectors and node rows, estimated from their lengths."""
        rows, width = self.points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        nodes = self.nodes.agg(F.sum(24 * F.size("pivot") + 8 * F.size("members") + 64)).first()[0] if self.nodes is not None else 0
        return rows * (width or 0) * 8 + (nodes or 0)

    def _all(self) -> DataFrame:
        base = self.points.select("id", "vec")
        return base if self.delta is None else base.unionByName(self.delta.select("id", "vec"))

    def add_points(self, more: DataFrame, rebuild_threshold: float = 2.0) -> Index:
        """The index with more points: searched linearly beside the trees until the rebuild threshold is passed."""
        delta = more.select("id", "vec") if self.delta is None else self.delta.unionByName(more.select("id", "vec"))
        grown = replace(self, delta=delta)
        if rebuild_threshold > 1 and self.size_at_build * rebuild_threshold < self.size_at_build + delta.count():
            return build_index(alive(grown._all(), self.removed), self.params)
        return grown

    def remove_points(self, gone: DataFrame) -> Index:
        """The index without the points of ``gone`` (column id); ids of the others stay."""
        return replace(self, removed=gone.select("id") if self.removed is None else self.removed.unionByName(gone.select("id")))

    def search(self, queries: DataFrame, k: int, checks: int = 32, eps: float = 0.0, radius: float = float("inf")) -> DataFrame:
        """``qid, rank, id, dist``: the k nearest that the search meets within the radius; checks < 0 is exact."""
        return ranked(self.hits(queries, k, checks, eps, radius).select("qid", "id", "dist"), k)

    def hits(self, queries: DataFrame, k: int, checks: int = 32, eps: float = 0.0, radius: float = float("inf")) -> DataFrame:
        """k hits of each query in each shard, with the number of distances that the shard computed for the query.

        The exact search of an index whose nodes aren't kept builds in the task that searches it what it looks at of the
        trees, and takes some shards at once, whose k best hits and sum of distances it returns.
        """
        params, name = self.params, self.params.metric
        if params.algorithm == "linear" or self.nodes is None and params.algorithm != "lsh":
            n = self.size()
            return knn_join(queries, alive(self._all(), self.removed), k, name, params.p).where(F.col("dist") < radius).select("qid", "id", "dist", F.lit(n).cast("long").alias("n_distances"))
        if params.algorithm == "lsh":
            data = alive(self._all(), self.removed)
            places = lsh.sampled_bits(64 * self.veclen(), params.tables, params.key_size, params.seed)
            found = lsh.search(queries, data, lsh.buckets(data, places), places, k, params.probe_level)
            met = lsh.candidates(queries, lsh.buckets(data, places), places, params.probe_level).groupBy("qid").agg(F.count(F.lit(1)).alias("n_distances"))
            return found.where(F.col("dist") < radius).join(met, "qid").select("qid", "id", "dist", "n_distances")
        m, kind = metric(name, params.p), _dtype(self.points)
        found = None
        data = alive(self.points, self.removed)

        def looker(qids: np.ndarray, vecs: np.ndarray, parts: int):
            def look(nodes: pa.Table, points: pa.Table) -> pa.Table:
                if not points.num_rows or not nodes.num_rows:
                    return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names)
                part = points["part"][0].as_py()
                ids, rows = points["id"].to_numpy(), matrix(points["vec"].combine_chunks(), kind)
                place, dist, at, computed = trees.search_many(_forest(nodes, ids), rows, ids, vecs[part::parts], k, params, m, checks, eps, radius)
                return pa.table([pa.array(c) for c in (qids[part::parts][place], at, dist, computed[place])], names)

            return look

        def exact(qids: np.ndarray, vecs: np.ndarray, parts: int):
            def look(points: pa.Table) -> pa.Table:
                part = points["part"][0].as_py()
                points = points.sort_by([("shard", "ascending"), ("id", "ascending")])
                ids, rows, of = points["id"].to_numpy(), matrix(points["vec"].combine_chunks(), kind), points["shard"].to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
                shards = [(rows[a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                place, dist, at, computed = trees.search_shards(shards, vecs[part::parts], k, params, m, eps, radius)
                return pa.table([pa.array(c) for c in (qids[part::parts][place], at, dist, computed[place])], names)

            return look

        names = ["qid", "id", "dist", "n_distances"]
        cores = self.spark.sparkContext.defaultParallelism
        # Shards that one task searches together, of bounded rows: its best hits of all of them leave it.
        together = max(1, min(SHARD_ROWS * self.shards // max(1, self.size_at_build), -(-self.shards // cores)))
        nodes = self.nodes.where("tree = 0") if checks < 0 else self.nodes  # each tree holds all points
        for qids, vecs in query_blocks(queries.where("vec IS NOT NULL")):
            # Where shards are fewer than cores, some tasks share a shard and deal its queries among them.
            parts = max(1, min(cores // self.shards, len(qids) // PART_QUERIES))
            split = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
            if checks < 0 and self.passing:
                bundles = data.select("*", split, (F.col("shard") / together).cast("int").alias("bundle")).groupBy("bundle", "part")
                part = bundles.applyInArrow(exact(qids, vecs, parts), HITS)
                found = part if found is None else found.unionByName(part)
                continue
            part = nodes.select("*", split).groupBy("shard", "part").cogroup(data.select("*", split).groupBy("shard", "part")).applyInArrow(looker(qids, vecs, parts), HITS)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], HITS)
        if self.delta is not None:
            late = knn_join(queries, alive(self.delta, self.removed), k, name, params.p).where(F.col("dist") < radius)
            n = alive(self.delta, self.removed).count()
            found = found.unionByName(late.select("qid", "id", "dist", F.lit(n).cast("long").alias("n_distances")))
        return found

    def save(self, path: str) -> None:
        """Points, nodes and tombstones as Parquet, and the settings beside them."""
        self.points.write.mode("overwrite").option("compression", "lz4").parquet(f"{path}/points")
        if self.nodes is not None:
            self.nodes.write.mode("overwrite").option("compression", "lz4").parquet(f"{path}/nodes")
        for name, df in (("delta", self.delta), ("removed", self.removed)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = asdict(self.params) | {"size_at_build": self.size_at_build, "shards": self.shards, "parts": [n for n in ("nodes", "delta", "removed") if getattr(self, n) is not None], "element": self.points.schema["vec"].dataType.elementType.simpleString(), "version": 1}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def load_index(spark: SparkSession, path: str) -> Index:
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    names = Params.__dataclass_fields__
    part = lambda n: spark.read.parquet(f"{path}/{n}") if n in meta["parts"] else None
    points = spark.read.parquet(f"{path}/points")
    if points.schema["vec"].dataType.elementType.simpleString() != meta["element"]:
        raise ValueError("the saved points aren't of the saved index's element type")
    return Index(Params(**{k: v for k, v in meta.items() if k in names}), points, part("nodes"), meta["size_at_build"], meta["shards"], part("delta"), part("removed"))


def build_index(points: DataFrame, params: Params, shard_rows: int = SHARD_ROWS) -> Index:
    """Trees of the points (``id, vec``), shard by shard; a shard is a hash class of about ``shard_rows`` ids."""
    if params.algorithm == "autotuned":
        return autotune(points, params)[0]
    n = points.count()
    shards = max(1, -(-n // shard_rows))
    dealt = points.where("vec IS NOT NULL").select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    if params.algorithm in ("linear", "lsh"):
        return Index(params, dealt, None, n, shards)
    m, kind = metric(params.metric, params.p), _dtype(points)
    trees_ok = params
    shape = pa.schema([("shard", pa.int32()), ("tree", pa.int32()), ("kind", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("is_leaf", pa.bool_()), *((c, pa.list_(pa.float64())) if c in ("pivot", "low", "high") else (c, pa.float64()) for c in ("pivot", "radius", "variance", "low", "high")), ("members", pa.list_(pa.int64()))])

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        data = matrix(table["vec"].combine_chunks(), kind)
        return pa.Table.from_pylist(_rows(table["shard"][0].as_py(), trees.build(data, trees_ok, m), table["id"].to_numpy()), shape)

    return Index(params, dealt, dealt.groupBy("shard").applyInArrow(make, NODES), n, shards, passing=True)


def autotune(points: DataFrame, params: Params, k: int = 5, n_queries: int = 50) -> tuple[Index, int]:
    """The cheapest index that reaches ``target_precision`` on a sample, and its ``checks``; cost counts distances.

    The sample is the fraction of lowest id digests, its first ``n_queries`` are the test queries. Fewer than 10 of
    those give linear search.
    """
    order = F.xxhash64("id", F.lit(params.seed))
    n = points.count()
    sample = points.select("id", "vec").orderBy(order, "id").limit(max(1, int(n * params.sample_fraction))).persist()
    queries = sample.orderBy(order, "id").limit(min(n_queries, sample.count() // 10)).select(F.col("id").alias("qid"), "vec").persist()
    if queries.count() < 10:
        return build_index(points, replace(params, algorithm="linear")), -1
    truth = knn_join(queries, sample, k, params.metric, params.p, skip=1).persist()
    best: tuple[float, Params, int] | None = None
    options = [replace(params, algorithm="kmeans", branching=b, iterations=i) for b in (16, 32) for i in (1, 5)] + [replace(params, algorithm="kdtree", trees=t) for t in (1, 4)]
    for option in options:
        index = build_index(sample, option)
        index.nodes = index.nodes.persist()
        checks = 16
        while checks < 4096:
            hits = index.hits(queries, k + 1, checks).persist()
            found = ranked(hits.where("qid != id").select("qid", "id", "dist"), k)
            reached = neighbor_precision(found, truth, k).agg(F.avg("precision")).first()[0] or 0.0
            cost = hits.groupBy("qid").agg(F.max("n_distances").alias("c")).agg(F.avg("c")).first()[0] or 0.0
            hits.unpersist()
            if reached >= params.target_precision:
                total = cost + params.build_weight * index.nodes.count()
                if best is None or total < best[0]:
                    best = total, option, checks
                break
            checks *= 2
        index.nodes.unpersist()
    for df in (sample, queries, truth):
        df.unpersist()
    if best is None:
        return build_index(points, replace(params, algorithm="linear")), -1
    return build_index(points, best[1]), best[2]


def search_reaching(built: Index, queries: DataFrame, truth: DataFrame, target: float, k: int, checks: int) -> tuple[DataFrame, int]:
    """``qid, rank, id, dist`` of a search whose mean precision against ``truth`` (the exact hits) is ``target`` at least,
    and its checks: the given ones, doubled until they suffice. A budget as large as the index gives way to the exact
    search (checks -1)."""
    nodes, built = built.nodes, replace(built, nodes=built.nodes.persist(), passing=False) if built.nodes is not None else built
    size = built.size()
    while True:
        found = built.search(queries, k, checks).persist()
        precision = neighbor_precision(found, truth, k).agg(F.avg("precision")).first()[0]
        if checks < 0 or precision is None or precision >= target:
            break
        found.unpersist()
        checks = 2 * checks if 2 * checks < size else -1
    if nodes is not None:
        nodes.unpersist()
    return found, checks


def checks_for(built: Index, queries: DataFrame, points: DataFrame, targets: list[float], k: int, most: int = 1 << 16) -> DataFrame:
    """``target, checks, precision, n_distances``: for each target the fewest checks, by doubling and then halving the
    gap, whose mean precision reaches it; the exact search (checks -1) where none up to ``most`` does.

    The ``FIRST_QUERIES`` of least digests say where to look; the checks and precision returned are those of all queries.
    """
    truth = knn_join(queries, points, k, built.params.metric, built.params.p).persist()
    if built.nodes is not None:
        built = replace(built, nodes=built.nodes.persist(), passing=False)  # else each measurement builds the trees again
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(FIRST_QUERIES).persist()
    known: dict[tuple[bool, int], tuple[float, float]] = {}
    all_ = queries.count() <= FIRST_QUERIES

    def measure(checks: int, few: bool = False) -> tuple[float, float]:
        few = few or all_
        if (few, checks) not in known:
            hits = built.hits(some if few else queries, k, checks).persist()
            wanted = truth.join(F.broadcast(some.select("qid")), "qid") if few else truth
            precision = neighbor_precision(ranked(hits.select("qid", "id", "dist"), k), wanted, k).agg(F.avg("precision")).first()[0]
            known[few, checks] = precision or 0.0, hits.groupBy("qid").agg(F.sum("n_distances").alias("c")).agg(F.avg("c")).first()[0] or 0.0
            hits.unpersist()
        return known[few, checks]

    def near(high: int) -> int:
        return max(8, high // 8)

    def between(low: int, high: int, few: bool, target: float) -> int:
        while high <= most and high - low > near(high):
            middle = (low + high) // 2
            low, high = (low, middle) if measure(middle, few)[0] >= target else (middle, high)
        return high

    rows = []
    for target in targets:
        high = 16
        while high <= most and measure(high, True)[0] < target:
            high *= 2
        high = between(high // 2, high, True, target)
        if not all_:  # all queries decide, from there on in growing steps
            high = min(high, most)
            step, low = near(high), high
            if measure(high)[0] >= target:
                while low > 8 and measure(low)[0] >= target:
                    high, low, step = low, max(8, low - step), 2 * step
            else:
                while high <= most and measure(high)[0] < target:
                    low, high, step = high, high + step, 2 * step
            high = between(low, high, False, target)
        checks = high if high <= most else -1
        rows.append((float(target), checks, *map(float, measure(checks))))
    some.unpersist()
    truth.unpersist()
    if built.nodes is not None:
        built.nodes.unpersist()
    return built.spark.createDataFrame(rows, "target double, checks int, precision double, n_distances double")
