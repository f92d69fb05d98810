"""Groups of linked rows without all pairs: candidate buckets, verified links, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, reliable, settled, small

#: In a bucket of up to so many rows, every pair that may still tell something new is joined; larger ones go by blocks.
FEW = 16


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs); root is the least node of its component.

    Large-star and small-star steps by turns (Kiveris et al., 2014): each is an aggregate and a join, and the number
    of rounds grows with the logarithm of the nodes. Stops when a round changes nothing; a round's table goes once the
    next one is stored.
    """
    edges, rows = settled(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while rows:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small(least, 2 * rows), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small(least, rows), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made, rows = settled(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(made)
        forget(edges)
        edges = made
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def shared_buckets(members: DataFrame) -> DataFrame:
    """The distinct ``bucket, node`` of the buckets that have two nodes or more.

    Almost all buckets have one, and the first aggregate, which is combined before its shuffle, finds the others; a
    bucket that very many rows share is one row of each task there.
    """
    several = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("bucket")
    several, n = settled(several)
    return reliable(members.join(small(several, n), "bucket").select("bucket", "node").distinct())


def link_groups(shared: DataFrame, info: DataFrame, may: Callable[[Column, Column], Column], verify: Callable[[DataFrame, int], DataFrame], compare: Callable[[DataFrame, DataFrame], DataFrame], few: int = FEW) -> DataFrame:
    """Components of the links among nodes that share a bucket: ``node, root`` of every node that has a link.

    ``shared``: ``bucket, node``; ``info``: ``node, weight, mark`` of these nodes. ``may(mark, mark)`` is an exact
    bound that a link must meet; ``verify`` keeps the linked ones of the counted pairs ``a, b``.

    Links within one component tell nothing new. So at first each node is compared with the hub of each of its
    buckets, the node of greatest weight (copies vary about what stands most often). Then, in buckets whose nodes fell
    into several components, every pair across two components is compared: joined in buckets of up to ``few``
    nodes, a bounded number for each row, while ``compare`` gets the larger ones as ``bucket, node, part, main, mark``
    (``main``: the hub's component), and the pairs that are known, and returns links ``a, b``.
    """
    info, n_info = settled(info)
    rows, n_rows = settled(shared.join(small(info, n_info), "node"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("weight", "node", "mark")).alias("top"), F.count(F.lit(1)).alias("size"))
    tops, n_tops = settled(tops)
    star = rows.join(small(tops, n_tops), "bucket").where((F.col("node") != F.col("top.node")) & may(F.col("mark"), F.col("top.mark")))
    star, n_star = settled(star.select(F.col("node").alias("a"), F.col("top.node").alias("b")).distinct())
    joined, n_joined = settled(components(verify(star, n_star)))
    parts = rows.join(small(joined, n_joined), "node", "left").select("bucket", "node", "mark", F.coalesce("root", "node").alias("part"))
    # Of two rows the one pair has been compared above.
    open_ = parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high AND size > 2").select("bucket", "size")
    open_, n_open = settled(open_)
    if not n_open:
        return joined
    left, n_left = settled(parts.join(small(open_, n_open), "bucket"))
    found = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    some = left.where(F.col("size") <= few)
    pairs = some.select("bucket", F.col("node").alias("a"), F.col("part").alias("p"), F.col("mark").alias("am")).join(some.select("bucket", F.col("node").alias("b"), F.col("part").alias("q"), F.col("mark").alias("bm")), "bucket")
    known = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & may(F.col("am"), F.col("bm"))).select("a", "b").distinct()
    later, n_later = settled(pairs.join(known, ["a", "b"], "left_anti"))
    more = False
    if n_later:
        found, more = found.unionByName(verify(later, n_later).select("a", "b")), True
    many = left.where(F.col("size") > few)
    if not many.isEmpty():
        main = tops.select("bucket", F.col("top.node").alias("node")).join(small(joined, n_joined), "node", "left").select("bucket", F.coalesce("root", "node").alias("main"))
        found, more = found.unionByName(compare(many.join(small(main, n_tops), "bucket").select("bucket", "node", "part", "main", "mark"), known).select("a", "b")), True
    made = settled(components(found))[0] if more else joined
    for done in (rows, left, star):
        forget(done)
    return made
