"""Preparing view datasets: unions with offsets, label joins, sampling, view grids, camera poses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PITCHES = (-15.0, 0.0, 15.0)


def consecutive_violations(images: DataFrame, column: str = "id") -> DataFrame:
    """One row ``violations``: how far the ids are from 0..n-1, each once (0: fine)."""
    return images.agg((F.count(F.lit(1)) - F.countDistinct(F.when((F.col(column) >= 0), F.col(column))) + F.greatest(F.max(column) + 1 - F.count(F.lit(1)), F.lit(0))).alias("violations"))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of ``a`` whose id is also in ``b``; a valid split has none."""
    return a.join(b.select(column).distinct(), column, "left_semi")


def unknown(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of ``a`` whose id ``b`` doesn't have."""
    return a.join(b.select(column).distinct(), column, "left_anti")


def union_with_offsets(parts: list[tuple[str, DataFrame]], id_col: str = "id", room_col: str | None = "room", others: tuple[str, ...] = ()) -> DataFrame:
    """Datasets under one id space: each is moved behind those before; rooms get the dataset's name in front.

    ``others`` are further id columns that are moved alike within their own spaces; nulls stay null.
    """
    both = None
    base = dict.fromkeys((id_col, *others), 0)
    for name, df in parts:
        most = df.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in base]).first()
        moved = df.withColumns({c: F.col(c) + F.lit(n) for c, n in base.items()}).withColumn("dataset", F.lit(name))
        if room_col and room_col in df.columns:
            moved = moved.withColumn(room_col, F.concat_ws("_", F.lit(name), room_col))
        both = moved if both is None else both.unionByName(moved)
        base = {c: n + most[c] for c, n in base.items()}
    return both


def stem(filename: Column) -> Column:
    """The name without its extension."""
    return F.regexp_replace(filename, r"(?<=[^/.])\.[^./]*$", "")


def label_rooms(images: DataFrame, labels: DataFrame, line: str | None = None) -> DataFrame:
    """``images`` with the ``label`` of their file stem; of several label rows of a stem the last (by ``line``) wins."""
    last = labels.groupBy("stem").agg(F.max_by("label", line).alias("label") if line else F.first("label").alias("label"))
    return images.withColumn("stem", stem(F.col("filename"))).join(last, "stem", "left")


def without_blocked(scans: DataFrame, blocked: DataFrame) -> DataFrame:
    """Scans whose three-character number (before a three-character suffix with its dot and class) isn't blocked."""
    number = F.col("filename").substr(F.length("filename") - 10, F.lit(3))
    return scans.withColumn("number", number).join(blocked.select("number"), "number", "left_anti")


def resample(views: DataFrame, yaws: int, pitches: int, all_yaws: int = 48) -> DataFrame:
    """Every so many yaws, and the middle or all three pitches, of views in rendering order (``pos`` from 0)."""
    step = all_yaws // yaws
    kept = views.where(F.pmod(F.expr("pos div 3"), F.lit(step)) == 0)
    return kept if pitches == 3 else kept.where(F.pmod("pos", F.lit(3)) == 1)


def sample_rows(df: DataFrame, n: int, seed: int = 0, column: str = "id") -> tuple[DataFrame, DataFrame]:
    """n rows without replacement, by id digest, and the rest."""
    taken = df.orderBy(F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed)))), column).limit(n)
    return taken, df.join(taken.select(column), column, "left_anti")


def yaw_union(rates: list[int]) -> list[float]:
    """Distinct angles, in order, of several even divisions of the circle."""
    return sorted({round(i * 360 / n, 6) for n in rates for i in range(n)})


def view_grid(panos: DataFrame, yaws: int = 48) -> DataFrame:
    """Every view of each panorama: ``pano, ind_yaw, yaw_deg, pitch_deg, filename``."""
    turned = panos.select("pano", F.explode(F.sequence(F.lit(0), F.lit(yaws - 1))).alias("ind_yaw"))
    tilted = turned.select("pano", "ind_yaw", (F.col("ind_yaw") * 360.0 / yaws).alias("yaw_deg"), F.explode(F.array(*[F.lit(p) for p in PITCHES])).alias("pitch_deg"))
    return tilted.withColumn("filename", view_name(F.col("pano"), F.col("yaw_deg"), F.col("pitch_deg")))


def view_name(pano: Column, yaw: Column, pitch: Column) -> Column:
    return F.format_string("%s_yaw_%.1f_pitch_%.1f.png", pano, wrap_degrees(yaw), pitch)


def wrap_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def wrap_radians(angle: Column) -> Column:
    """Remainder by a full turn, with the sign of the angle."""
    return angle % F.lit(2 * math.pi)


def rotation(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Row-major 3 x 3 matrix of the turns about z, y and x (radians)."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two row-major 3 x 3 matrices."""
    return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: sum((F.element_at(a, (k - k % 3 + i + 1).cast("int")) * F.element_at(b, (k % 3 + 3 * i + 1).cast("int")) for i in range(3)), F.lit(0.0)))


def orthonormal_error(r: Column) -> Column:
    """Sum of the absolute differences of R R' from the identity; a rotation has at most about 2e-3."""
    total = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            product = sum((F.element_at(r, 3 * i + k + 1) * F.element_at(r, 3 * j + k + 1) for k in range(3)), F.lit(0.0))
            total = total + F.abs(F.lit(1.0 if i == j else 0.0) - product)
    return total


def camera_position(r: Column, t: Column) -> Column:
    """-R't, where the camera with the projection [R | t] stands."""
    return F.array(*[-sum((F.element_at(r, 3 * k + i + 1) * F.element_at(t, k + 1) for k in range(3)), F.lit(0.0)) for i in range(3)])


def rotation_quaternion(r: Column) -> Column:
    """Quaternion (w, x, y, z) of a rotation matrix with a positive real part."""
    e = lambda i, j: F.element_at(r, 3 * i + j + 1)
    w = F.sqrt(F.greatest(1 + e(0, 0) + e(1, 1) + e(2, 2), F.lit(1e-12))) / 2
    return F.array(w, (e(2, 1) - e(1, 2)) / (4 * w), (e(0, 2) - e(2, 0)) / (4 * w), (e(1, 0) - e(0, 1)) / (4 * w))


def pixel_direction(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Unit vector to which a pixel of an equirectangular panorama points."""
    lon = (x / width - 0.5) * (2 * math.pi)
    lat = (F.lit(0.5) - y / height) * math.pi
    return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def direction_pixel(v: Column, width: Column, height: Column) -> Column:
    """Pixel of an equirectangular panorama to which a unit vector points: inverse of ``pixel_direction``."""
    x, y, z = (F.element_at(v, i + 1) for i in range(3))
    return F.array((F.atan2(y, x) / (2 * math.pi) + 0.5) * width, (F.lit(0.5) - F.asin(z) / math.pi) * height)


def average_locations(views: DataFrame) -> DataFrame:
    """``pano, location``: mean place of a panorama's views."""
    elements = views.select("pano", F.posexplode("location").alias("dim", "x")).groupBy("pano", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return elements.groupBy("pano").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("location"))


def region_grid(width: int, height: int, levels: int, overlap_share: float = 0.4) -> list[tuple[int, int, int, int]]:
    """Square regions (x, y, w, h) of an image at several scales, spaced so that neighbours overlap by about the share.

    At level l the side is ``2 * short / (l + 1)``; the longer side has as many more regions as come nearest to the
    wanted overlap.
    """
    short, long_ = min(width, height), max(width, height)
    extra = 0
    if long_ > short:
        steps = range(2, 8)
        gap = {s: (long_ - short) / (s - 1) for s in steps}
        extra = min(steps, key=lambda s: abs((short**2 - short * gap[s]) / short**2 - overlap_share)) - 1
    found = []
    for level in range(1, levels + 1):
        across, down = (level + extra, level) if width >= height else (level, level + extra)
        side = math.floor(2 * short / (level + 1))
        xs = [math.floor(i * (width - side) / (across - 1)) if across > 1 else (width - side) // 2 for i in range(across)]
        ys = [math.floor(i * (height - side) / (down - 1)) if down > 1 else (height - side) // 2 for i in range(down)]
        found += [(x, y, side, side) for y in ys for x in xs]
    return found


def corners(regions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Regions as their first and last corners."""
    return [(x, y, x + w - 1, y + h - 1) for x, y, w, h in regions]


def missing_rows(ids: DataFrame, stored: DataFrame, column: str = "id") -> DataFrame:
    """Ids whose vector isn't stored yet (no row, or a null vector)."""
    return ids.join(stored.where("vec IS NOT NULL").select(column), column, "left_anti")


def running_offsets(parts: DataFrame) -> DataFrame:
    """``parts`` (``part, n``) with ``begin``: the number of rows of the parts before."""
    return parts.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
