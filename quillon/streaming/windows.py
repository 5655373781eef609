from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _totals(events: DataFrame, window: Column, keys: list[str], late: str) -> DataFrame:
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "n", F.round("total", 4).alias("total"))
    )


def tumbling_totals(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _totals(events, F.window("ts", width), ["event_type"], late)


def sliding_totals(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _totals(events, F.window("ts", width, step), ["event_type"], late)


def session_totals(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return _totals(events, F.session_window("ts", gap), ["user_id"], late)


def drain(stream: DataFrame) -> DataFrame:
    """All windows of what a stream can read now, held in memory (tests and demonstrations)."""
    name = f"drain_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
