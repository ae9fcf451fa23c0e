"""What jobs share: the folder that the driver and all executors see, tables kept in it, and small sides of joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join goes to all tasks only up to so many rows, and so many bytes of their values.
SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="brandweave-"))
    return named or context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; on one machine without it, under a new local folder."""
    return f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder: for tables that a job uses several times.

    They are a checkpoint, so Spark drops the files once nothing refers to them
    (spark.cleaner.referenceTracking.cleanCheckpoints), and executors that are lost lose nothing.
    """
    _folder(frame.sparkSession)
    return frame.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes what is in a path, by Hadoop's file systems: what Spark can write to, they can delete from."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(field: T.StructField):
    """About what a value takes."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * 8 + 16
    return F.lit(16)


def is_small(frame: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether the frame holds no more than so many rows and bytes; no more than ``rows`` + 1 are counted."""
    total = sum((_bytes(f) for f in frame.schema.fields), F.lit(0))
    found = frame.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def beside(frame: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """The frame as a side of a join: sent to all tasks if it ``is_small``, else merged by key.

    Without a hint Spark knows no size of a table made on the driver, and may send the other side round.
    """
    return F.broadcast(frame) if is_small(frame, rows, size) else frame.hint("merge")
