"""Pooling vectors of a group into one: mean, sum, multi-scale sum, generalized max; statistics of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import normalize
from .knn import matrix


def _by_element(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return vectors.where("vec IS NOT NULL").select(*keys, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def _gather(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``keys, dim, x`` put together to ``keys, vec``; a group has one row for each dimension."""
    rows = elements.groupBy(*keys) if keys else elements.groupBy()
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


#: Groups whose sums a task holds at once.
HELD_GROUPS = 4096


def _sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dim, x, n``: sums of the vectors of each group, and how many they are.

    Each task adds up its rows by group and sends one vector for each, so that no vector is cut into rows before.
    """
    need = vectors.where("vec IS NOT NULL").select(*keys, "vec")
    kept = [need.schema[k] for k in keys]
    shape = T.StructType([*kept, T.StructField("_total", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])
    arrow = to_arrow_schema(shape)

    def flush(held: dict) -> pa.RecordBatch:
        columns = [pa.array([g[i] for g in held], arrow.field(i).type) for i in range(len(kept))]
        totals = pa.array([t for t, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())
        return pa.RecordBatch.from_arrays([*columns, *(t.cast(arrow.field(len(kept) + i).type) for i, t in enumerate(totals))], arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data = matrix(batch.column(len(kept)))
            named = list(zip(*[batch.column(i).to_pylist() for i in range(len(kept))])) if kept else [()] * batch.num_rows
            place: dict = {}
            rows = np.array([place.setdefault(g, len(place)) for g in named])
            order = np.argsort(rows, kind="stable")
            counts = np.bincount(rows)
            totals = np.add.reduceat(data[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
            for g, total, n in zip(place, totals, counts.tolist()):
                before = held.get(g)
                held[g] = (total, n) if before is None else (before[0] + total, before[1] + n)
            if len(held) > HELD_GROUPS:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    parts = need.mapInArrow(run, shape).select(*keys, "_n", F.posexplode("_total").alias("dim", "x"))
    return parts.groupBy(*keys, "dim").agg(F.sum("x").alias("x"), F.sum("_n").alias("n"))


def mean_pool(vectors: DataFrame, keys: list[str], unit: bool = True) -> DataFrame:
    """Element-wise mean of the vectors of each group, then of unit length: ``keys, vec``."""
    made = _gather(_sums(vectors, keys).withColumn("x", F.col("x") / F.col("n")), keys)
    return made.withColumn("vec", normalize(F.col("vec"))) if unit else made


def sum_pool(vectors: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """Element-wise sum of the vectors of each group: ``keys, vec``."""
    made = _gather(_sums(vectors, keys), keys)
    return made.withColumn("vec", normalize(F.col("vec"))) if unit else made


def squared_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def multi_scale(scales: list[DataFrame], key: str = "id") -> DataFrame:
    """Sum of a row's vectors at several scales, of unit length."""
    both = scales[0].select(key, "vec")
    for s in scales[1:]:
        both = both.unionByName(s.select(key, "vec"))
    return sum_pool(both, [key], unit=True)


def column_mean(vectors: DataFrame) -> DataFrame:
    """One row: ``vec``, the mean vector."""
    return mean_pool(vectors, [], unit=False)


def center_all(vectors: DataFrame, mean: DataFrame, unit: bool = True) -> DataFrame:
    """Each vector less the mean, and of unit length if asked. The mean is one row and so is broadcast."""
    moved = vectors.join(F.broadcast(mean.select(F.col("vec").alias("_mean"))), F.lit(True), "left")
    moved = moved.withColumn("vec", F.zip_with("vec", "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")
    return moved.withColumn("vec", normalize(F.col("vec"))) if unit else moved


def gmp_pool(vectors: DataFrame, key: str, ridge: float = 1.0) -> DataFrame:
    """Generalized max pooling: ``key, vec``, the unit vector along ``(X'X + ridge I)^-1 X'1`` of each group.

    X'X and X'1 are sums over rows, so each task adds up its own share of a group and sends one matrix on.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups = np.array(batch.column(key).to_pylist(), dtype=object)
            data = matrix(batch.column("vec"))
            for g in dict.fromkeys(groups.tolist()):
                x = data[groups == g]
                gram, total = x.T @ x, x.sum(axis=0)
                if g in held:
                    gram, total = gram + held[g][0], total + held[g][1]
                held[g] = gram, total
            if len(held) > 64:
                yield from flush(held)
                held = {}
        yield from flush(held)

    kind = vectors.schema[key].dataType.simpleString()
    own = to_arrow_schema(T.StructType([vectors.schema[key]])).field(0).type
    shape = f"{key} {kind}, gram array<double>, total array<double>"

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), own), pa.array([g.ravel() for g, _ in held.values()], pa.list_(pa.float64())), pa.array([t for _, t in held.values()], pa.list_(pa.float64()))], [key, "gram", "total"])

    def final(table: pa.Table) -> pa.Table:
        total = matrix(table["total"].combine_chunks()).sum(axis=0)
        gram = matrix(table["gram"].combine_chunks()).sum(axis=0).reshape(len(total), len(total))
        v = np.linalg.solve(gram + ridge * np.eye(len(total)), total)
        return pa.table({key: table[key].slice(0, 1), "vec": pa.array([v / np.linalg.norm(v)], pa.list_(pa.float64()))})

    sums = vectors.where("vec IS NOT NULL").select(key, "vec").mapInArrow(partial, shape)
    return sums.groupBy(key).applyInArrow(final, f"{key} {kind}, vec array<double>")


def column_statistics(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounding box, mean and population variance of each dimension: ``keys, dim, low, high, mean, variance``."""
    keys = keys or []
    return _by_element(vectors, keys).groupBy(*keys, "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def from_mean(rows: DataFrame, key: str) -> DataFrame:
    """``key, dist``: the squared distance of each row's vector to the mean of its group, which are few beside the rows."""
    means = mean_pool(rows, [key], unit=False).withColumnRenamed("vec", "_mean")
    return rows.where("vec IS NOT NULL").join(means, key).select(key, squared_gap(F.col("vec"), F.col("_mean")).alias("dist"))


def node_statistics(members: DataFrame, key: str) -> DataFrame:
    """``key, size, radius, variance`` of nodes: greatest and mean squared distance of the members to their mean."""
    return from_mean(members, key).groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("radius"), F.avg("dist").alias("variance"))
