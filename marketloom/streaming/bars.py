"""Structured Streaming forms: tumbling and sliding bars with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, size: str = "1 minute", slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """OHLCV bars of a stream (or table) of (symbol, ts, price, size); ticks later than ``late`` are dropped."""
    if ticks.isStreaming:
        ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # a watermark needs an instant
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = ticks.groupBy(w.alias("w"), "symbol").agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
