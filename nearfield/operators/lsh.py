"""Bit-sampling hash tables for binary descriptors, with multi-probe search."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import ranked


def sampled_bits(n_bits: int, tables: int = 12, key_size: int = 20, seed: int = 0) -> list[list[int]]:
    """The bit places that each table's key takes; within a table all differ."""
    rng = random.Random(seed)
    return [sorted(rng.sample(range(n_bits), min(key_size, n_bits))) for _ in range(tables)]


def key_of(bits: Column, places: list[int]) -> Column:
    """Chosen bits of a descriptor (array of longs), packed into a long."""
    key = F.lit(0).cast("long")
    for i, place in enumerate(places):
        word = F.element_at(bits, place // 64 + 1)
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, place % 64).bitwiseAND(F.lit(1).cast("long")), i))
    return key


def buckets(points: DataFrame, places: list[list[int]]) -> DataFrame:
    """The index: ``table_no, key, id``."""
    keys = F.array(*[F.struct(F.lit(t).alias("table_no"), key_of(F.col("vec"), p).alias("key")) for t, p in enumerate(places)])
    return points.where("vec IS NOT NULL").select("id", F.explode(keys).alias("b")).select("b.table_no", "b.key", "id")


def probe_masks(key_size: int, level: int) -> list[int]:
    """All masks of up to ``level`` bits."""
    return [sum(1 << b for b in c) for n in range(level + 1) for c in combinations(range(key_size), n)]


def candidates(queries: DataFrame, index: DataFrame, places: list[list[int]], level: int = 2) -> DataFrame:
    """``qid, id`` of the points that share a bucket with a query, or a bucket within ``level`` bits; each pair once."""
    keys = buckets(queries.withColumnRenamed("qid", "id"), places).withColumnRenamed("id", "qid")
    masks = probe_masks(len(places[0]), level)
    probes = keys.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select("qid", "table_no", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    return probes.join(index, ["table_no", "key"]).select("qid", "id").distinct()


def search(queries: DataFrame, points: DataFrame, index: DataFrame, places: list[list[int]], k: int, level: int = 2) -> DataFrame:
    """k nearest by Hamming distance among the candidates: ``qid, rank, id, dist``."""
    met = candidates(queries, index, places, level).join(queries.select("qid", F.col("vec").alias("qvec")), "qid").join(points.select("id", "vec"), "id")
    dist = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return ranked(met.select("qid", "id", dist.cast("double").alias("dist")), k)


def bucket_statistics(index: DataFrame) -> DataFrame:
    """For each table: number of buckets and the mean, median, least and greatest size."""
    sizes = index.groupBy("table_no", "key").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("table_no").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.avg("size").alias("mean_size"),
        F.percentile("size", 0.5).alias("median_size"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
    )


def bucket_histogram(index: DataFrame, width: int = 20) -> DataFrame:
    """``table_no, low, n``: buckets by size, in steps of ``width``."""
    sizes = index.groupBy("table_no", "key").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("table_no", (F.floor(F.col("size") / width) * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))
