"""The same views as streams.

Roll-ups use event time with a watermark, an extension over stamping rows when
they arrive: late rows within the watermark still count.  With ``delay=None``
there is no watermark and every row counts, however late; its state keeps a row
for each window and kind.  Sinks are idempotent: a batch is written under its
id, so a batch that runs twice leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DAY_START = "18 hours"  # midnight at UTC+6, in UTC


def hourly(events: DataFrame, ts: str = "ts", delay: str | None = "1 hour", value: str | None = "value") -> DataFrame:
    """Tumbling hours: window start, kind, n and sum."""
    return _tumbling(events, ts, delay, value, "1 hour", None)


def local_daily(events: DataFrame, ts: str = "ts", delay: str | None = "1 hour", value: str | None = "value") -> DataFrame:
    """Tumbling days that begin at local midnight (UTC+6); needs a UTC session."""
    return _tumbling(events, ts, delay, value, "1 day", DAY_START)


def _tumbling(events: DataFrame, ts: str, delay: str | None, value: str | None, size: str, start: str | None) -> DataFrame:
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", delay) if rows.isStreaming and delay else rows
    window = F.window("__ts", size, size, start) if start else F.window("__ts", size)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(window.alias("w"), "event_type").agg(*aggs).select(F.col("w.start").alias("start"), "event_type", "n", *(["total"] if value else []))


def latest_state(updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Latest row per key, batch or stream (update mode): heartbeats, cursors."""
    body = F.struct(F.col(order), *[F.col(c) for c in columns])
    return updates.groupBy(key).agg(F.max(body).alias("s")).select(key, "s.*")


def engine_state(updates: DataFrame, key: str = "worker_id") -> DataFrame:
    """Heartbeats where the total accumulates and the rest is replaced."""
    newest = F.max(F.struct("last_seen", "current_batch", "state")).alias("s")
    return updates.groupBy(key).agg(F.sum("scanned_total").alias("scanned_total"), newest).select(
        key, "s.last_seen", "scanned_total", "s.current_batch", "s.state")


def versioned_sink(folder: str):
    """A foreachBatch function that writes batch ``n`` to ``folder/batch=n`` (overwriting a failed try)."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def run_rollup(rolled: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what is there and stop; offsets are kept in ``checkpoint``, so the next run goes on from there."""
    return rolled.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(versioned_sink(folder)).start()


def read_rollup(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The current roll-up: of each key the row of its last batch."""
    rows = spark.read.parquet(folder)
    body = F.struct("batch", *[F.col(c) for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max(body).alias("s")).select(*keys, "s.*").drop("batch")


def compact_rollup(spark: SparkSession, folder: str, target: str, keys: list[str]) -> None:
    """The current roll-up as one batch of a new folder, for a store of many batches; the next run goes on writing there.

    It takes number -1, so that every later batch counts as newer.
    """
    read_rollup(spark, folder, keys).write.mode("overwrite").parquet(f"{target}/batch=-1")


def open_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A table of Parquet files as a stream; ``path`` may be a folder or one file (as a pattern, a file may be a source)."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def cached_view(view: DataFrame) -> DataFrame:
    """A view kept for repeated reads; how fresh it must be is the caller's choice."""
    return view.cache()
