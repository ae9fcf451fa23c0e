"""Event jobs. Each is a function of a DataFrame with ``ts`` as a timestamp, streaming or not.

State is bounded by the watermark; ``user_id`` and ``event_type`` are the keys, so no state is held
in one place. ``run_stream`` drives a streaming DataFrame to the end of what is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from brandweave.functions.shared import drop_folder, fresh_path, kept
from brandweave.sources.tables import SCHEMAS


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream, with ``ts`` as a timestamp."""
    reader = spark.readStream.schema(SCHEMAS["events"]).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_stream(frame: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives until its input is used up.

    Each batch has a folder of its own, which a repeated batch overwrites, so that a restart after a
    lost driver or executor neither loses nor doubles rows. In complete mode the last batch holds. At the end
    the rows are kept as a checkpoint, which Spark drops when nothing refers to it, and the batches and the
    stream's state go.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, "stream")
    spark.createDataFrame([], frame.schema).write.parquet(f"{path}/out/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*frame.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch", "left_semi")
    rows = kept(rows.drop("batch"))
    drop_folder(spark, path)
    return rows


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type."""
    return sliding_counts(events, size, size, late)


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """The same over windows that overlap."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("value")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("value").cast("double").alias("value")
    )


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """A user's sessions: events no further apart than the gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def attributed_purchases(events: DataFrame, within: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Each purchase with each earlier view of the same user within the given time."""
    kept = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late)
    views, purchases = kept("view", "view"), kept("purchase", "purchase")
    on = (F.col("view_user") == F.col("purchase_user")) & (F.col("view_ts") <= F.col("purchase_ts")) & (F.col("view_ts") >= F.col("purchase_ts") - F.expr(f"interval {within}"))
    return purchases.join(views, on).select("purchase_id", "view_id", F.col("purchase_user").alias("user_id"))


def last_view_before(events: DataFrame) -> DataFrame:
    """The latest view before each purchase of the same user, if any (batch).

    One pass in time order over each user's events, in place of an as-of join; a purchase at the
    same time as a view comes after it.
    """
    order = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    view = F.when(F.col("event_type") == "view", F.struct("event_id", "ts"))
    rows = events.where(F.col("event_type").isin("view", "purchase")).withColumn("view", F.last(view, ignorenulls=True).over(order))
    return rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("view.event_id").alias("view_id"), F.col("view.ts").cast("timestamp_ntz").alias("view_ts"))


def dedupe_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def spikes(events: DataFrame, z: float = 2.0, size: str = "1 day", least: int = 3) -> DataFrame:
    """Windows whose count is over the mean + z deviations of the type's earlier windows (batch).

    Windows without events do not count; at least ``least`` earlier windows are needed.
    """
    counts = events.groupBy(F.window("ts", size).start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("event_type").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    rows = counts.select("*", F.count("n").over(before).alias("seen"), F.avg("n").over(before).alias("mean"), F.stddev_pop("n").over(before).alias("deviation"))
    return rows.where((F.col("seen") >= least) & (F.col("n") > F.col("mean") + z * F.col("deviation"))).select(
        F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")
    )


class _Judge(StatefulProcessor):
    """Holds the closed windows of one type: their number, the sum and the sum of squares of counts."""

    def __init__(self, z: float, least: int):
        self.z, self.least = z, least

    def init(self, handle) -> None:
        self.state = handle.getValueState("closed", "seen long, total double, squares double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen, total, squares = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        out = []
        closed = pd.concat([f[["start", "n"]] for f in rows]).sort_values("start")
        for start, n in zip(closed["start"], closed["n"], strict=True):
            if seen >= self.least:
                mean = total / seen
                deviation = max(0.0, squares / seen - mean * mean) ** 0.5
                if n > mean + self.z * deviation:
                    out.append((start, key[0], n, round(mean, 6), round(deviation, 6)))
            seen, total, squares = seen + 1, total + float(n), squares + float(n) ** 2
        self.state.update((seen, total, squares))
        yield pd.DataFrame(out, columns=["start", "event_type", "n", "mean", "deviation"])


def spike_stream(events: DataFrame, z: float = 2.0, size: str = "1 day", least: int = 3, late: str = "1 hour") -> DataFrame:
    """The same over a stream, in append mode: a window is judged once the watermark has passed it.

    Spark counts the events by window and type; only the counts of closed windows, one row for each,
    reach the state function. It needs the RocksDB state store, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    closed = counts.select(F.col("window.start").alias("start"), "event_type", "n")
    rows = T.StructType.fromDDL("start timestamp, event_type string, n long, mean double, deviation double")
    return closed.groupBy("event_type").transformWithStateInPandas(_Judge(z, least), rows, "Append", "None")
