"""Shared pieces of the corpus operators: reading, word counts, durable intermediates, bounded batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A small side is broadcast up to this many narrow rows (tens of MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder that all machines share; on one machine any folder is shared.

    Without ``spark.checkpoint.dir`` a cluster has no such folder, and its name can't be guessed, so that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or "spark-warehouse/checkpoints")


def reliable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder, so that lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, rows_per_task: int = 100_000) -> tuple[DataFrame, int]:
    """``reliable(df)`` in no more tasks than its rows are worth, and the number of rows."""
    made = reliable(df)
    rows = made.count()
    return made.coalesce(max(1, -(-rows // rows_per_task))), rows


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df``, written as Parquet beside the checkpoints, and what deletes it; for large tables that are read in parts."""
    spark = df.sparkSession
    shared_dir(spark)
    where = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)

    def delete() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(where), delete


def forget(df: DataFrame) -> None:
    """Deletes the checkpoint of a table that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    while plan.children().size():
        plan = plan.children().head()
    where = plan.rdd().getCheckpointFile()
    if where.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of ``rows`` counted rows) marked for broadcast if it is small enough, else left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, and of bounded bytes where Spark has that setting: long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception:  # older Spark: no such setting
        pass


def map_texts(df: DataFrame, start: Callable[[], Callable], schema: T.StructType, text: str = "text", also: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One output row for each row of ``df``: its other columns, and then what ``start()(text, *also)`` gives.

    ``start`` runs once per task and returns the function; that one takes a str (null: empty) and the values of the
    columns ``also``, and returns a tuple.
    """
    bounded_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in also and (keep_text or f.name != text)]
    columns = [f.name for f in schema.fields]
    arrow = [_arrow(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            more = [batch.column(c).to_pylist() for c in also]
            rows = [of(t or "", *x) for t, *x in zip(batch.column(text).to_pylist(), *more)]
            made = list(zip(*rows)) if rows else [()] * len(columns)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(v, k) for v, k in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + columns)

    return df.mapInArrow(run, T.StructType(kept + schema.fields))


def filter_texts(df: DataFrame, start: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """The rows of ``df``, with all columns, whose text (null: empty) ``start()`` says true of."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            yield batch.filter(pa.array([of(t or "") for t in batch.column(text).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind.simpleString()]
