"""Quotes and bars: the same transformation runs on a static or a streaming DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.core.frames import moment


def read_ticks(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def latest_price(ticks: DataFrame, key="symbol", time="ts") -> DataFrame:
    """Newest quote per symbol (update mode on a stream)."""
    t = ticks.select(key, time, "price", "quantity", moment(time, "event_id").alias("_at"))
    return t.groupBy(key).agg(F.max(time).alias(time), *[F.max_by(c, "_at").alias(c) for c in ("price", "quantity")])


def bars(ticks: DataFrame, width="1 minute", late="10 minutes", key="symbol", time="ts") -> DataFrame:
    """Tumbling OHLCV bars; on a stream rows later than the watermark are dropped."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark(time, late)
    t = ticks.select(key, time, "price", "quantity", moment(time, "event_id").alias("_at"))
    g = t.groupBy(key, F.window(time, width).alias("w")).agg(
        F.min_by("price", "_at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_at").alias("close"),
        F.sum("quantity").alias("volume"))
    return g.select(key, F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run everything available once; file sink plus checkpoint give exactly-once output across restarts."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_handler(df: DataFrame, handler, checkpoint: str, mode: str = "update"):
    """Hand each micro-batch to ``handler(df, batch_id)``: the place for alert callbacks."""
    return df.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
