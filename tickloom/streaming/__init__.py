"""Streaming extension: bars from a tick stream, and first-touch tracking of positions against a bar stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", price: str = "px", by: str = "instrument", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """OHLCV windows of a tick stream; ticks later than the watermark are left out."""
    at = F.struct(ts, tie)
    g = ticks.withWatermark(ts, late).groupBy(by, F.window(ts, width))
    x = g.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
    return x.select(by, F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def touches(bar_stream: DataFrame, trades: DataFrame) -> DataFrame:
    """Bars of the stream that touch a static position's stop or target while it is open (stream-static join)."""
    x = bar_stream.join(trades, "instrument").where("bar_ts >= t0 and bar_ts <= t1")
    buy = F.col("side") == "buy"
    stop = F.when(buy, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    target = F.when(buy, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    return x.where(stop | target).select("id", "bar_ts", F.when(target, "target").otherwise("stop").alias("touched"))
