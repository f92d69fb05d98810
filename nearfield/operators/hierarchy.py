"""Group keys of views, stages of groups, and the tables that the groups refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pooling import mean_pool


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the place of the column's value among its sorted distinct values, from 0.

    Distinct values are numbered apart (they are few beside the rows) and joined back.
    """
    numbered = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(numbered, column, "left")


def rel_yaw(filename: Column) -> Column:
    """Third part from the end of a name parted by underscores, as a number; 0 where there are fewer parts."""
    parts = F.split(filename, "_")
    return F.when(F.size(parts) < 3, F.lit(0.0)).otherwise(F.try_element_at(parts, F.lit(-3)).try_cast("double"))


def pitch(filename: Column) -> Column:
    """Last part without its four-character extension, as a number."""
    last = F.element_at(F.split(filename, "_"), -1)
    return last.substr(F.lit(1), F.greatest(F.length(last) - 4, F.lit(0))).try_cast("double")


def pitch_bin(value: Column) -> Column:
    return F.when(value < -10, 0).when(value > 10, 2).otherwise(1)


def yaw_bin(value: Column, bins: Column | int) -> Column:
    return F.floor(value * (F.lit(bins) if isinstance(bins, int) else bins) / 360).cast("int")


def panorama_offset(pano: Column, seed: int = 0) -> Column:
    """Angle in [0, 360) drawn for each panorama; the same in every run with the same seed."""
    return F.pmod(F.xxhash64(pano, F.lit(seed)), F.lit(36_000_000)) / 100_000.0


def quaternion_yaw(q: Column) -> Column:
    """Yaw of a rotation (x, y, z, w)."""
    x, y, z, w = (F.element_at(q, i + 1) for i in range(4))
    return F.atan2(2 * (y * z + x * w), w * w - x * x - y * y + z * z)


def equal_bin(angle: Column, bins: Column) -> Column:
    """Bin of an angle among equal parts of [-pi, pi); values outside fall out of range and are for the caller to drop."""
    return F.floor((angle + F.pi()) * bins / (2 * F.pi())).cast("int")


def group_none(views: DataFrame) -> DataFrame:
    """Membership where each view is a group: ``stage, cluster, image_id``."""
    return views.select(F.lit("none").alias("stage"), F.col("image_id").cast("string").alias("cluster"), "image_id")


def group_room(views: DataFrame) -> DataFrame:
    return views.select(F.lit("room").alias("stage"), F.col("room").alias("cluster"), "image_id")


def group_yaw(views: DataFrame, bins: int = 1, adaptive: bool = False) -> DataFrame:
    """Per room and part of the circle (``yaw`` in radians); adaptive: ``bins`` parts for each panorama of the room."""
    if adaptive:
        panos = views.groupBy("room").agg(F.countDistinct("pano").alias("_panos"))
        views = views.join(panos, "room").withColumn("_bins", F.col("_panos") * bins)
    else:
        views = views.withColumn("_bins", F.lit(bins))
    parted = views.withColumn("_bin", equal_bin(F.col("yaw"), F.col("_bins"))).where("_bin >= 0 AND _bin < _bins")
    return parted.select(F.lit(f"yawadap_{bins}" if adaptive else f"yaw_{bins}").alias("stage"), F.concat_ws("_", "room", "_bin").alias("cluster"), "image_id")


def group_pano(views: DataFrame, yaw_bins: int = 1, pitch_bins: int = 1, offset_seed: int | None = None) -> DataFrame:
    """Per panorama, part of the circle and pitch band (1 or 3); angles come from the view's file name."""
    angle = rel_yaw(F.col("filename"))
    if offset_seed is not None:
        angle = (angle + panorama_offset(F.col("pano"), offset_seed)) % 360
    band = pitch_bin(pitch(F.col("filename"))) if pitch_bins == 3 else F.lit(0)
    key = F.format_string("%s_%d_%d", F.col("pano"), yaw_bin(angle, yaw_bins), band)
    return views.select(F.lit(f"pano_{yaw_bins}_{pitch_bins}").alias("stage"), key.alias("cluster"), "image_id")


def group_custom(views: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups from a table ``room, ids``, numbered within the room by their ids; ids that no view has are left out."""
    place = F.row_number().over(Window.partitionBy("room").orderBy("ids")) - 1
    listed = clusters.select(place.alias("c"), "room", "ids").select("c", "room", F.explode("ids").alias("image_id"))
    named = listed.select(F.lit("custom").alias("stage"), F.concat_ws("_", "room", "c").alias("cluster"), "image_id")
    return named.join(views.select("image_id"), "image_id", "left_semi").select("stage", "cluster", "image_id")


def stages(memberships: list[DataFrame]) -> DataFrame:
    """One membership table of several stages, ``level`` 0 the topmost; groups without members don't arise."""
    both = None
    for level, m in enumerate(memberships):
        m = m.withColumn("level", F.lit(level))
        both = m if both is None else both.unionByName(m)
    return both


def pool_stages(membership: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of the member vectors of each group of each stage: ``level, stage, cluster, vec``."""
    return mean_pool(membership.join(vectors.select("image_id", "vec"), "image_id"), ["level", "stage", "cluster"])


def links(membership: DataFrame) -> DataFrame:
    """``level, parent, child``: groups of neighbouring levels that share an image."""
    upper = membership.select("level", F.col("cluster").alias("parent"), "image_id")
    lower = membership.select((F.col("level") - 1).alias("level"), F.col("cluster").alias("child"), "image_id")
    return upper.join(lower, ["level", "image_id"]).select("level", "parent", "child").distinct()


def pano_frequency(membership: DataFrame, views: DataFrame) -> DataFrame:
    """Panoramas of each group by how many of its images they have: ``stage, cluster, pano, n, pos``; ties by name."""
    counted = membership.join(views.select("image_id", "pano"), "image_id").groupBy("stage", "cluster", "pano").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stage", "cluster").orderBy(F.desc("n"), "pano")
    return counted.withColumn("pos", F.row_number().over(order))


def pano_table(views: DataFrame) -> DataFrame:
    """``pano, room, first_image, location, n_images``: a panorama has the room and place of its first image."""
    return views.groupBy("pano").agg(
        F.min_by("room", "image_id").alias("room"),
        F.min("image_id").alias("first_image"),
        F.min_by("location", "image_id").alias("location"),
        F.count(F.lit(1)).alias("n_images"),
    )


def ground_truth(queries: DataFrame, panos: DataFrame, threshold: float, ignore_rooms: bool = False) -> DataFrame:
    """``qid, pano, dist``: panoramas of the query's rooms nearer than ``threshold``, else the nearest one alone.

    ``queries``: ``qid, location, rooms``. With rooms it is an equality join on the room; without, the panorama table
    (one row for each panorama) meets every query.
    """
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    if ignore_rooms:
        met = queries.select("qid", F.col("location").alias("at")).join(panos, F.lit(True))
    else:
        met = queries.select("qid", F.col("location").alias("at"), F.explode("rooms").alias("room")).join(panos, "room")
    met = met.select("qid", "pano", apart(F.col("at"), F.col("location")).alias("dist"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("dist"), "pano"))
    met = met.withColumn("place", order)
    return met.where((F.col("dist") < threshold) | (F.col("place") == 1)).select("qid", "pano", "dist")
