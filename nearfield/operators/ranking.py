"""Scores of ranked lists: dedup by first occurrence, average precision, precision and recall of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(ranked: DataFrame, item: str = "pano") -> DataFrame:
    """``qid, item, rank``: each item at its first rank, ranked anew without gaps."""
    firsts = ranked.groupBy("qid", item).agg(F.min("rank").alias("_first"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("_first", item))
    return firsts.withColumn("rank", order).select("qid", item, "rank")


def average_precision(ranked: DataFrame, truth: DataFrame, item: str = "pano") -> DataFrame:
    """``qid, ap`` of each query with truth: area under precision over recall by trapezoids.

    The i-th match at rank j adds ``((i - 1) / (j - 1) + i / j) / 2 / positives``, the first part being 1 at rank 1.
    Queries without a positive have no truth rows and no result; without matches the value is 0.
    """
    positives = truth.select("qid", item).distinct()
    number = positives.groupBy("qid").agg(F.count(F.lit(1)).alias("_p"))
    matched = ranked.select("qid", item, "rank").join(positives, ["qid", item])
    i = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    j = F.col("rank")
    before = F.when(j == 1, F.lit(1.0)).otherwise((F.col("_i") - 1) / F.when(j > 1, j - 1))
    areas = matched.withColumn("_i", i).groupBy("qid").agg(F.sum((before + F.col("_i") / j) / 2).alias("_area"))
    return number.join(areas, "qid", "left").select("qid", (F.coalesce("_area", F.lit(0.0)) / F.col("_p")).alias("ap"))


def precision_at(ranked: DataFrame, truth: DataFrame, k: int, item: str = "pano") -> DataFrame:
    """``qid, p_at_k``: matches among the first k, over k even where fewer are ranked."""
    positives = truth.select("qid", item).distinct().withColumn("_hit", F.lit(1))
    near = ranked.where(F.col("rank") <= k).join(positives, ["qid", item], "left")
    hits = near.groupBy("qid").agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.lit(float(k))).alias("_p"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("_p", F.lit(0.0)).alias("p_at_k"))


def summary(ap: DataFrame, p1: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """One row: mean average precision and precision at 1 in percent, and the mean number of distances if given."""
    joined = ap.join(p1, "qid")
    wanted = [(F.avg("ap") * 100).alias("map"), (F.avg("p_at_k") * 100).alias("p_at_1")]
    if distances is not None:
        joined = joined.join(distances, "qid")
        wanted.append(F.avg("n_distances").alias("n_distances"))
    return joined.agg(*wanted)


def weighted_map(splits: DataFrame) -> DataFrame:
    """Mean average precision over splits (``map, n``), each weighted by its number of queries."""
    return splits.agg((F.sum(F.col("n") * F.col("map")) / F.sum("n")).alias("map"))


def neighbor_precision(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``qid, precision``: share of the true k neighbours that were found, by id."""
    want = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = found.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    return want.join(hits, ["qid", "id"], "left").groupBy("qid").agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.lit(float(k))).alias("precision"))


def distance_precision(found: DataFrame, truth: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``qid, precision``: share of the true k distances that the found ones match one by one (ties forgiven)."""

    def numbered(df: DataFrame) -> DataFrame:
        d = df.where(F.col("rank") <= k).select("qid", F.round("dist", digits).alias("d"))
        return d.withColumn("o", F.row_number().over(Window.partitionBy("qid", "d").orderBy("d")))

    hits = numbered(found).withColumn("_hit", F.lit(1))
    return numbered(truth).join(hits, ["qid", "d", "o"], "left").groupBy("qid").agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.lit(float(k))).alias("precision"))


def distance_ratio(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``qid, ratio``: mean of found over true distance at equal rank; 0 over 0 counts as 1."""
    a = found.where(F.col("rank") <= k).select("qid", "rank", F.col("dist").alias("f"))
    b = truth.where(F.col("rank") <= k).select("qid", "rank", F.col("dist").alias("t"))
    ratio = F.when((F.col("t") == 0) & (F.col("f") == 0), 1.0).otherwise(F.col("f") / F.nullif(F.col("t"), F.lit(0.0)))
    return a.join(b, ["qid", "rank"]).groupBy("qid").agg(F.avg(ratio).alias("ratio"))
