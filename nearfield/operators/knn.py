"""Exact nearest-neighbour and radius joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, metric

#: Queries that one pass sends to every task; more queries are searched in several passes over the points.
BLOCK_ROWS = 20_000
BLOCK_BYTES = 64 << 20
#: Elements up to which a distance by expressions is one sum over columns; more don't fit a compiled method.
UNROLLED = 128
PAIRS_PER_TASK = 20_000_000

HITS = "qid bigint, id bigint, dist double"


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column as a matrix (a view where the layout allows it)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries in blocks of bounded size, cut by id hash so that no block outgrows memory."""
    kind = np.int64 if queries.schema["vec"].dataType.elementType.simpleString() == "bigint" else np.float64
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    parts = max(1, -(-n // BLOCK_ROWS), -(-n * (width or 1) * 8 // BLOCK_BYTES))
    for k in range(parts):
        rows = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k)).select("qid", "vec").toArrow()
        if rows.num_rows:
            yield rows["qid"].to_numpy(), matrix(rows["vec"].combine_chunks(), kind)


def nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least distances of a row, ties by id."""
    if len(dist) > 4 * k:
        edge = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= edge)
    else:
        near = np.arange(len(dist))
    return near[np.lexsort((ids[near], dist[near]))[:k]]


class Pick(NamedTuple):
    """Which points of a task a query takes: ``of(distances, ids)``; none lies above ``limit(distances)``."""

    of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    limit: Callable[[np.ndarray], float]


def _least(k: int) -> Callable[[np.ndarray], float]:
    return lambda d: np.partition(d, k - 1)[k - 1] if 0 < k <= len(d) else np.inf


def _search(points: DataFrame, qids: np.ndarray, vecs: np.ndarray, name: str, p: float, pick: Pick) -> DataFrame:
    """A matrix product finds the points that a query may take, where the metric has one; only these are measured."""
    block, rough = metric(name, p).block, metric(name, p).rough

    def taken(q: np.ndarray, data: np.ndarray, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = block(q[None, :], data[near])[0]
        x = pick.of(d, ids[near])
        return ids[near[x]], d[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            data = matrix(batch.column("vec"), vecs.dtype.type)
            if not len(ids):
                continue
            step = max(1, (4 << 20) // max(1, data.size))
            for at in range(0, len(qids), step):
                some = vecs[at : at + step]
                if rough is None:
                    found = ((ids[x], d[x]) for d in block(some, data) for x in (pick.of(d, ids),))
                else:
                    first, off = rough(some, data)
                    found = (taken(q, data, ids, np.flatnonzero(d <= pick.limit(d) + 2 * off)) for q, d in zip(some, first))
                out = [(np.full(len(i), q), i, d) for q, (i, d) in zip(qids[at : at + step], found) if len(i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["qid", "id", "dist"])

    return points.where("vec IS NOT NULL").select("id", "vec").mapInArrow(run, HITS)


def _all_blocks(queries: DataFrame, points: DataFrame, name: str, p: float, pick: Pick) -> DataFrame:
    found = None
    for qids, vecs in query_blocks(queries.where("vec IS NOT NULL")):
        part = _search(points, qids, vecs, name, p, pick)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else points.sparkSession.createDataFrame([], HITS)


def ranked(hits: DataFrame, k: int | None = None, skip: int = 0) -> DataFrame:
    """``qid, rank, id, dist``: hits by distance and id; the ``skip`` nearest are left out, ``k`` of the rest stay."""
    order = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    made = hits.withColumn("rank", order)
    made = made.where(F.col("rank") > skip) if skip else made
    made = made.where(F.col("rank") <= k + skip) if k is not None else made
    return made.select("qid", (F.col("rank") - skip).alias("rank"), "id", "dist")


def alive(points: DataFrame, removed: DataFrame | None) -> DataFrame:
    """The points that aren't in the tombstone table ``removed`` (column id)."""
    return points if removed is None else points.join(removed.select("id").distinct(), "id", "left_anti")


def knn_join(queries: DataFrame, points: DataFrame, k: int, name: str = "l2", p: float = 2.0, skip: int = 0, removed: DataFrame | None = None) -> DataFrame:
    """The k nearest points of each query: ``qid, rank, id, dist`` (queries ``qid, vec``, points ``id, vec``).

    Blocks of queries go to every task of the points; a task sends on its own k best for each query, and one shuffle
    by query picks the k best of these. The points are never shuffled, and never paired in full. Null vectors aren't
    found; ties rank by id; fewer than k points give fewer rows.
    """
    most = k + skip
    return ranked(_all_blocks(queries, alive(points, removed), name, p, Pick(lambda d, ids: nearest(d, ids, most), _least(most))), k, skip)


def radius_join(queries: DataFrame, points: DataFrame, radius: float, max_neighbors: int = -1, name: str = "l2", p: float = 2.0, removed: DataFrame | None = None) -> DataFrame:
    """Points with a distance strictly below ``radius``; 0 ``max_neighbors`` counts them, a positive number bounds them.

    The radius is in the metric's own unit (squared for l2). Counting gives ``qid, n``, also for queries without hits.
    """
    data = alive(points, removed)
    if max_neighbors == 0:
        hits = _all_blocks(queries, data, name, p, Pick(lambda d, ids: np.flatnonzero(d < radius), lambda d: radius)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        return queries.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def pick(d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(d < radius)
        return near if max_neighbors < 0 else near[nearest(d[near], ids[near], max_neighbors)] if len(near) else near

    return ranked(_all_blocks(queries, data, name, p, Pick(pick, lambda d: radius)), None if max_neighbors < 0 else max_neighbors)


def _spread(df: DataFrame, key: str, width: int, as_: str) -> DataFrame:
    """The vector's elements as double columns without nulls, which the engine reads without a call for each."""
    return df.select(key, *(c for c in df.columns if c not in (key, "vec")), *(F.coalesce(F.get("vec", F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"{as_}{i}") for i in range(width)))


def _term(name: str, i: int) -> Column:
    gap = F.col(f"q{i}") - F.col(f"x{i}")
    return gap * gap if name == "l2" else F.abs(gap)


def knn_expressions(queries: DataFrame, points: DataFrame, k: int, name: str = "l2", p: float = 2.0) -> DataFrame:
    """The same as ``knn_join`` by column expressions only; the queries must be few, they are paired with all points.

    A first pass over about the root of ``k`` times the points gives each query a distance that its k-th hit can't exceed, so that of all pairs
    only few go on to be ranked. Squared L2 and L1 of up to ``UNROLLED`` elements are sums over columns; other
    distances fold the arrays.
    """
    points = points.where("vec IS NOT NULL").select("id", "vec")
    n, n_queries, width = points.count(), *queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    unrolled = name in ("l2", "l1") and 0 < (width or 0) <= UNROLLED
    if unrolled:
        dist = reduce(lambda s, i: s + _term(name, i), range(width), F.lit(0.0))
        points, asked = _spread(points, "id", width, "x"), _spread(queries.select("qid", "vec"), "qid", width, "q")
    else:
        dist, asked = distance(F.col("qvec"), F.col("vec"), name, p), queries.select("qid", F.col("vec").alias("qvec"))
    share = max(1, math.isqrt(n // max(1, k)))
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).join(F.broadcast(asked), F.lit(True)).select("qid", "id", dist.alias("dist"))
    limit = ranked(some, k).where(F.col("rank") == k).select("qid", F.col("dist").alias("most"))
    few = asked.join(limit, "qid", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    dealt = points.repartition(max(points.sparkSession.sparkContext.defaultParallelism, -(-n * n_queries // PAIRS_PER_TASK)))
    hits = dealt.join(F.broadcast(few), dist <= F.col("most")).select("qid", "id", dist.alias("dist"))
    return ranked(hits, k)


def as_matrix(hits: DataFrame, k: int) -> DataFrame:
    """``qid, indices, dists``: one row for each query, padded to k with -1 and infinity."""

    def padded(name: str, pad: Column) -> Column:
        found = F.transform(F.col("rows"), lambda r: r[name])
        return F.concat(found, F.array_repeat(pad, F.lit(k) - F.size("rows")))

    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("rows"))
    return rows.select("qid", padded("id", F.lit(-1).cast("long")).alias("indices"), padded("dist", F.lit(float("inf"))).alias("dists"))
