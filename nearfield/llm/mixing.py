"""Mixing sources to target weights: a low-discrepancy schedule joined with shuffled blocks of equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, small, word_count

#: Fixed value: 2**32 divided by the golden ratio, made odd; its multiples modulo 2**32 fill the interval evenly.
GOLDEN = 2654435769
SPAN = 1 << 32
SLOTS = 1 << 16
BUCKET_ROWS = 4096
#: A source of fewer blocks is taken by words instead of by slots, which are too coarse for it.
FEW_BLOCKS = 512


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sid, source, rows, source_size, weight, target`` of each source.

    Sources stand in code point order, null last, with the weights in turn. They share all words by weight; a source
    stops at ``max_repeats`` times its size. With the sources sorted by cap per weight, the first whose share of what
    the earlier caps leave is within its cap sets the share of all later ones.
    """
    by = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("sid", place.cast("long")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    earlier = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest))
    by = by.withColumn("share", F.first(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("share")), ignorenulls=True).over(everything))
    by = by.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))))
    return by.select("sid", "source", "rows", "source_size", "weight", "target")


def schedule(sources: DataFrame, block: int, n_slots: int, max_repeats: int = 3) -> DataFrame:
    """``slot, sid, block, epoch``: which block of which source stands in each slot of the mix.

    Slot i has the point ``i * GOLDEN mod 2**32``; the source whose stretch of cumulative target holds it gets the slot.
    A source's slots, ranked in order, take its blocks in turn, at most ``max_repeats`` times each.
    """
    spark = sources.sparkSession
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    high = F.floor(F.sum("target").over(upto) / F.sum("target").over(everything) * F.lit(float(SPAN))).cast("long")
    marked = sources.where("target > 0").withColumn("high", high)
    marked = marked.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0)))
    # Stretches are cut at multiples of 2**16, which makes the search of a point's stretch an equality join.
    bins = marked.where("high > low").withColumn("bin", F.explode(F.sequence(F.expr("low >> 16"), F.expr("(high - 1) >> 16"))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % F.lit(SPAN)).alias("point")).withColumn("bin", F.expr("point >> 16"))
    taken = slots.join(bins, "bin").where("point >= low AND point < high")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1
    taken = taken.withColumn("rank", rank.cast("long")).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    return taken.select("slot", "sid", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch")).where(F.col("epoch") < max_repeats)


def shuffled(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Each document with its place ``first`` (words before it) in its source's shuffled order, found in buckets.

    A source has a bucket for each ``BUCKET_ROWS`` rows; sums of buckets give where each begins, and only within a
    bucket are rows sorted. So a source with a third of all rows is spread like the others.
    """
    need = F.col("need")
    put = sized.join(small(sources.select("sid", F.col("source").alias("s"), "source_size", "target", F.expr(f"(rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}").alias("need")), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    put = put.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * need / F.lit(float(SPAN))).cast("long"))
    begins = put.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("sid", "bucket").orderBy("h", "size")
    put = put.withColumn("n", F.row_number().over(inner)).withColumn("inside", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return put.join(begins, ["sid", "bucket"]).withColumn("first", F.col("begin") + F.col("inside"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, slots: int = SLOTS, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and the mix itself: ``slot, sid, bucket, n, begin_word, end_word``.

    The block is as many words as make about ``slots`` slots (at least 512 for each source), so the taken words of a
    source differ from its target by a few blocks at most. A source of fewer than ``FEW_BLOCKS`` blocks is taken by
    words instead and meets its target exactly.
    """
    sized = reliable(docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.lit("mix"), F.col(id_col).cast("string"), F.col("text"))).alias("h")))
    sources = reliable(targets(sized, weights, max_repeats))
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    block = max(1, -(-total // max(slots, 512 * n_sources)))
    n_slots = -(-total // block)
    placed = shuffled(sized, sources, n_sources)
    plan = schedule(sources, block, n_slots, max_repeats)
    few = F.col("source_size") < (FEW_BLOCKS * block if block > 1 else 0)
    pieces = placed.where((F.col("size") > 0) & ~few).withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
    taken = pieces.join(small(plan.select("slot", F.col("sid").alias("p_sid"), F.col("block").alias("p_block"), "epoch"), n_slots), (F.col("sid") == F.col("p_sid")) & (F.col("block") == F.col("p_block")), "left")
    taken = taken.withColumn("begin_word", F.greatest(F.col("first"), F.col("block") * block) - F.col("first")).withColumn("end_word", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.col("first"))
    if block > 1:
        taken = taken.unionByName(exactly(placed.where((F.col("size") > 0) & few), n_slots, max_repeats), allowMissingColumns=True)
    return placed, taken


def exactly(placed: DataFrame, n_slots: int, max_repeats: int) -> DataFrame:
    """The pieces of small sources: whole epochs in their shuffled order up to the target, spread over all slots."""
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("before", F.col("epoch") * F.col("source_size") + F.col("first"))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("before"))).cast("long")
    each = each.withColumn("begin_word", F.lit(0).cast("long")).withColumn("end_word", words)
    slot = F.least(F.lit(n_slots - 1), F.floor(F.col("before") / F.col("target") * F.lit(n_slots))).cast("long")
    return each.withColumn("slot", F.when(words > 0, slot)).drop("before")


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of each document.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last; repeated rows keep their
    own places; an empty table gives no rows; other columns play no part. The order is a digest of id and text, so
    reruns agree.
    """
    placed, taken = mix(docs, weights, max_repeats, slots, id_col)
    keys = ["sid", "bucket", "n", "doc_id", "source", "size", "source_size", "target"]
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("end_word") - F.col("begin_word")).otherwise(F.lit(0)))
    some = taken.groupBy(*keys).agg(words.alias("taken")).select(*keys[3:], "taken")
    none = placed.where("size = 0").select(*keys[3:], F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), text)) AS h FROM documents),
by0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
by1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM by0),
by2 AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM by1),
by3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM by2),
lam AS (SELECT arg_min(share, cap / weight) AS share FROM by3 WHERE share * weight <= cap),
src AS (SELECT sid, source, source_size, least(cap, coalesce((SELECT share FROM lam) * weight, cap)) AS target FROM by3),
cfg0 AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, greatest(65536, 512 * count(*)) AS slots FROM src),
cfg AS (SELECT total, greatest(1, (total + slots - 1) // slots) AS block FROM cfg0),
stretch AS (SELECT *, CAST(floor(sum(target) OVER (ORDER BY sid) / sum(target) OVER () * 4294967296.0) AS BIGINT) AS high FROM src WHERE target > 0),
stretch2 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM stretch),
slots AS (SELECT i AS slot, ((i + 1) * 2654435769) % 4294967296 AS point FROM cfg, range(0, (total + block - 1) // block) t(i)),
ranked AS (SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY slot) - 1) AS r, (source_size + block - 1) // block AS blocks FROM slots, stretch2, cfg WHERE point >= low AND point < high),
plan AS (SELECT sid, r % blocks AS block, count(*) AS times FROM ranked WHERE r // blocks < 3 GROUP BY ALL),
placed AS (SELECT s.doc_id, s.source, s.size, src.sid, src.source_size, src.target, row_number() OVER w AS n, CAST(coalesce(sum(s.size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
           FROM sized s JOIN src ON s.source IS NOT DISTINCT FROM src.source WINDOW w AS (PARTITION BY src.sid ORDER BY s.h, s.size)),
piece AS (SELECT p.*, unnest(range(first // block, (first + size - 1) // block + 1)) AS b, block AS bs FROM placed p, cfg WHERE size > 0),
got AS (SELECT piece.sid, n, sum((least(first + size, (b + 1) * bs) - greatest(first, b * bs)) * times) AS taken FROM piece JOIN plan ON piece.sid = plan.sid AND piece.b = plan.block GROUP BY piece.sid, n)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN got ON placed.sid = got.sid AND placed.n = got.n
"""
