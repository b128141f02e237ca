"""Streaming counterparts for live readings: daily means, activity segments, store sink, lag features.

Sources and sinks are the caller's; every function maps a streaming DataFrame to another one, except the
sink, which starts a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import MIN_VALID_HOURS


def stream_hourly_to_daily(readings: DataFrame, delay: str = "6 hours", min_hours: int = MIN_VALID_HOURS) -> DataFrame:
    """Station-day means of hourly means; late rows count until the watermark passes their hour.

    Two chained windows in append mode: a day appears once, when it can no longer change.
    """
    hourly = (
        readings.withWatermark("ts", delay)
        .groupBy("sensor_id", F.window("ts", "1 hour").alias("hour"))
        .agg(F.avg("pm25").alias("pm25"))
    )
    daily = hourly.groupBy("sensor_id", F.window(F.window_time("hour"), "1 day").alias("day")).agg(
        F.avg("pm25").alias("pm25_mean"), F.count("pm25").alias("n_hours_valid")
    )
    return daily.select(
        "sensor_id",
        F.to_date("day.start").alias("date"),
        "pm25_mean",
        "n_hours_valid",
        (F.col("n_hours_valid") >= min_hours).cast("int").alias("complete"),
    )


def stream_segments(readings: DataFrame, gap: str = "2 days", delay: str = "6 hours") -> DataFrame:
    """Activity segments of each station, emitted when the gap after the last reading has passed."""
    return (
        readings.withWatermark("ts", delay)
        .groupBy("sensor_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("pm25_mean"), F.max("ts").alias("last_ts"))
        .select("sensor_id", F.col("s.start").alias("first_ts"), "last_ts", "n", "pm25_mean")
    )


def stream_store_sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a store partitioned by date and batch; a replayed batch replaces its own files only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "batch")
            .parquet(path)
        )

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_days(daily: DataFrame, delay: str, **values: Column) -> DataFrame:
    """Rows (sensor_id, ts, values), one per station and day, once the watermark has passed the whole day.

    Of several values the first to arrive that is not null counts. Rows without a station or a day are left out.
    ``delay`` counts from the start of the day, so the day itself comes on top.
    """
    known = daily.where("sensor_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.date_trunc("day", "ts"))
    marked = known.withWatermark("ts", f"{delay} 1 day")
    return marked.groupBy("sensor_id", "ts").agg(*[F.first(v, ignorenulls=True).alias(c) for c, v in values.items()])


def stream_lag_features(daily: DataFrame, delay: str = "10 days") -> DataFrame:
    """Previous-day value per station, for days that the watermark has passed; a resent (station, day) counts once.

    ``daily`` has (sensor_id, ts, pm25) with ``ts`` the day's timestamp. Every row goes to its own day and, as the value
    before, to the next one; both meet in the state of that day, which is dropped with its answer. A value that arrives
    when its own day has been answered still counts for a next day that has not.
    """
    value, none = F.coalesce("pm25", F.lit(float("nan"))), F.lit(None).cast("double")  # an unknown value is one that arrived
    next_day = F.date_trunc("day", "ts") + F.make_interval(days=F.lit(1))
    both = F.array(
        F.struct("ts", value.alias("own"), none.alias("before")), F.struct(next_day.alias("ts"), none.alias("own"), value.alias("before"))
    )
    spread = daily.select("sensor_id", F.inline(both))
    # the next day's rows are a day ahead of the readings, and so is the watermark they carry
    days = finished_days(spread, f"{delay} 1 day", own=F.col("own"), before=F.col("before")).where("own IS NOT NULL")
    return days.select("sensor_id", F.to_date("ts").alias("date"), F.nullif("own", F.lit(float("nan"))).alias("pm25"), F.nullif("before", F.lit(float("nan"))).alias("pm25_lag1"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes everything available into a Parquet folder and returns that table."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
