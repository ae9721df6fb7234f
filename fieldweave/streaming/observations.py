"""Observation streams: event-time means, late data bounded by a watermark, and dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.collapse import aggregate, whole_hours


def by_time(stream: DataFrame, keep: list[str], method: str, duration: str, late: str = "1 hour") -> DataFrame:
    """As ``collapse.by_time``, over a stream: an interval comes out once no report of it can be later than ``late``."""
    window = F.window("time", f"{whole_hours(duration)} hours")
    out = stream.withWatermark("time", late).groupBy(*keep, window.alias("__w")).agg(aggregate(method, F.col("value")).alias("value"))
    return out.select(*keep, F.col("__w.start").alias("time"), "value")


def first_reports(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first report of each key; keys are forgotten once ``late`` has passed, so state stays bounded."""
    return stream.withWatermark("time", late).dropDuplicatesWithinWatermark(keys)
