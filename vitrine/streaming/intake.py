"""Streams of updates and source attempts: intake once, routing, counters, windows and sessions.

Event time is a ``timestamp`` column; a watermark says how long a key is remembered. The delay is a
decision of this library: rows later than it are dropped by windows and forgotten by deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.session import folder_exists, shared_dir

DELAY = "1 day"


def once(updates: DataFrame, key: str = "update_id", at: str = "created_at", delay: str = DELAY) -> DataFrame:
    """Each update once, however often it is delivered within the delay."""
    return updates.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def routed(updates: DataFrame) -> DataFrame:
    """Updates with the queue that works on them."""
    return updates.withColumn("queue", F.when(F.col("kind") == "voice", "voice").when(F.col("kind") == "media", "media").otherwise("assistant"))


def source_counters(attempts: DataFrame, key: str = "domain") -> DataFrame:
    """Counters by source, kept up to date row by row (update or complete mode)."""
    return attempts.groupBy(key).agg(
        F.count(F.when(F.col("outcome").isin("extracted", "failed"), 1)).alias("attempt_count"), F.count(F.when(F.col("outcome") == "extracted", 1)).alias("extraction_success_count"),
        F.count(F.when(F.col("outcome") == "accepted", 1)).alias("accepted_gallery_count"), F.count(F.when(F.col("outcome") == "failed", 1)).alias("failure_count"))


def windowed(events: DataFrame, at: str = "ts", length: str = "1 day", delay: str = DELAY, *keys: str) -> DataFrame:
    """Counts and sums in tumbling windows."""
    return events.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "12 minutes", delay: str = DELAY) -> DataFrame:
    """First request of each burst: rows of a key closer than the gap are one."""
    return events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))


def available_now(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """All that is there now, worked through once: the rows written by an append stream, or the last state of a complete or update one.

    Results and checkpoint are files below ``folder``, a new one in the shared folder unless given; with the same folder a
    later call goes on where the last one ended. Nothing gathers on the driver. An update stream gives what changed last.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    path, checkpoint = f"{folder}/{name}", f"{folder}/{name}-checkpoint"
    if mode == "append":
        to_parquet(stream, path, checkpoint).awaitTermination()
    else:
        latest = lambda rows, _: rows.write.mode("overwrite").parquet(path)  # noqa: E731  a batch that runs again writes the same state
        stream.writeStream.foreachBatch(latest).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], stream.schema)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """An append-only stream into files, exactly once by the checkpoint; ``interval``, such as the two minutes of a polling source, keeps it running."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def polled(values: DataFrame, folder: str, name: str, key: str = "name", value: str = "value", at: str = "at", interval: str | None = "2 minutes") -> StreamingQuery:
    """A source that is asked again and again: each batch of (key, value, at) adds to the file table ``name`` the rows that differ from the last known value of their key.

    The last values stand in ``name``-state, a folder for each batch, so a batch that runs again starts from the same ones.
    """
    spark = values.sparkSession
    state = f"{folder}/{name}-state"

    def step(rows: DataFrame, batch: int) -> None:
        known = f"{state}/{batch - 1}"
        own = Window.partitionBy(key).orderBy(F.col("__old").desc(), at, value)
        rows = rows.select(key, value, at)
        if folder_exists(spark, known):
            before = spark.read.schema(rows.schema).parquet(known)
            rows = before.withColumn("__old", F.lit(True)).unionByName(rows.withColumn("__old", F.lit(False)))
        else:
            rows = rows.withColumn("__old", F.lit(False))
        seen = rows.withColumn("__before", F.lag(F.struct(value)).over(own)).persist()
        changed = seen.where(~F.col("__old") & (F.col("__before").isNull() | ~F.col(f"__before.{value}").eqNullSafe(F.col(value)))).select(key, value, at)
        changed.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        latest = seen.groupBy(key).agg(F.max_by(F.struct(value, at), F.struct((~F.col("__old")).alias("new"), at, value)).alias("r"))
        latest.select(key, "r.*").write.mode("overwrite").parquet(f"{state}/{batch}")
        seen.unpersist()

    writer = values.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/{name}-checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder as a stream, with event time as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
