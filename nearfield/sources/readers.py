"""Readers and writers of the metadata and vector files that retrieval datasets come in."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<id:bigint,filename:string,room:string,source_pano_filename:string,camera_location:array<double>,final_camera_rotation:array<double>,ind_yaw:int>"
VIEW = "struct<id:bigint,filename:string,room_labels:array<string>>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a metadata document, by id, with the camera's size and calibration: one row for each image."""
    raw = spark.read.schema(f"images array<{IMAGE}>, image_width int, image_height int, calibration_matrix array<double>").json(path, multiLine=True)
    return raw.select(F.explode("images").alias("i"), "image_width", "image_height", "calibration_matrix").select("i.*", "image_width", "image_height", "calibration_matrix").orderBy("id")


def read_views(spark: SparkSession, path: str | None, kind: str, images: DataFrame | None = None) -> DataFrame:
    """``query`` or ``db`` views of a split document; without a document no queries, and all images as database."""
    if path is None:
        if kind == "db" and images is not None:
            return images.select("id", "filename", F.lit(None).cast("array<string>").alias("room_labels"))
        return spark.createDataFrame([], "id bigint, filename string, room_labels array<string>")
    raw = spark.read.schema(f"{kind}_views array<{VIEW}>").json(path, multiLine=True)
    return raw.select(F.explode(f"{kind}_views").alias("v")).select("v.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Room labels of a two-column file without a header: ``line, stem, label``; later lines win where stems repeat."""
    return spark.read.schema("stem string, label string").csv(path).withColumn("line", F.monotonically_increasing_id())


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``room, ids`` of a document that maps rooms to lists of id lists; values that aren't lists are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rooms = raw.select(F.explode("m").alias("room", "value")).where(F.col("value").startswith("["))
    return rooms.select("room", F.explode(F.from_json("value", "array<struct<ids:array<bigint>>>")).alias("c")).select("room", "c.ids")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose documents of a folder, one for each panorama, named by their file."""
    raw = spark.read.schema("camera_location array<double>, final_camera_rotation array<double>, camera_rt_matrix array<array<double>>, room string, image_width int, image_height int").json(path, multiLine=True)
    return raw.withColumn("pano", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """4 x 4 matrices of text files: ``name, matrix`` (row by row)."""
    raw = spark.read.text(path, wholetext=True)
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), numbers.alias("matrix")).where(F.size("matrix") == 16)


def read_pano_rooms(spark: SparkSession, path: str) -> DataFrame:
    """``pano, room`` of space-separated lines ``id pano room_id label``: room is ``label_roomid``, the first line wins."""
    raw = spark.read.option("sep", " ").schema("id string, pano string, room_id string, label string").csv(path).withColumn("line", F.monotonically_increasing_id())
    return raw.where("label IS NOT NULL").groupBy("pano").agg(F.min_by(F.concat_ws("_", "label", "room_id"), "line").alias("room"))


def list_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg}") -> DataFrame:
    """Image files below a folder: ``path, length``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``id, vec`` of a NumPy matrix whose rows are vectors by id; a row of NaN is a vector not computed yet (null)."""
    content = spark.read.format("binaryFile").load(path)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for c in batch.column("content").to_pylist():
                data = np.load(io.BytesIO(c)).astype(np.float32)
                vecs = [None if np.isnan(v[0]) else v for v in data]
                for at in range(0, len(vecs), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 10_000, len(vecs))), pa.int64()), pa.array(vecs[at : at + 10_000], pa.list_(pa.float32()))], ["id", "vec"])

    return content.select("content").mapInArrow(rows, "id bigint, vec array<float>")


def write_vectors(vectors: DataFrame, path: str, partitions: int | None = None) -> None:
    """Vectors as Parquet; with a number of partitions in ranges of the id, so that a reader of a range opens few files."""
    (vectors.repartitionByRange(partitions, "id") if partitions else vectors).write.mode("overwrite").parquet(path)


def read_shard(spark: SparkSession, path: str, rank: int, size: int) -> DataFrame:
    """The rank-th of ``size`` equal id ranges of stored vectors; the filter reaches the scan."""
    data = spark.read.parquet(path)
    low, high = data.agg(F.min("id"), F.max("id")).first()
    step = -(-(high - low + 1) // size)
    return data.where((F.col("id") >= low + rank * step) & (F.col("id") < low + (rank + 1) * step))


def write_document(images: DataFrame, path: str) -> None:
    """Image metadata as JSON lines."""
    images.write.mode("overwrite").json(path)
