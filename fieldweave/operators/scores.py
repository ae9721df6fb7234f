"""Verification scores over pairs (forecast, observed), grouped by the coordinates to preserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = ("gt", "lt")


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("forecast IS NOT NULL AND observed IS NOT NULL")


def scores(pairs: DataFrame, preserve: list[str], carried: dict[str, str] | None = None) -> DataFrame:
    """(preserve, n, rmse, mae, additive_bias, pearson) of the pairs with both values.

    Where ``pairs`` has a time that is not preserved, also time_start, time_end and time,
    the middle: of all the group's pairs, of their bounds (time_lower, time_upper) if they
    have any. ``carried`` says which coordinates belong to which dimension ({"lat":
    "station"}): preserving one preserves its dimension, and it is shown beside it (the
    least, should there be several). A constant side has no correlation: null. Groups
    without a pair have no row.
    """
    carried = carried or {}
    keys = list(dict.fromkeys(carried.get(c, c) for c in preserve))
    shown = [F.min(c).alias(c) for c in preserve if c not in keys]
    times = []
    if "time" in pairs.columns and "time" not in preserve:
        lower, upper = ("time_lower", "time_upper") if "time_lower" in pairs.columns else ("time", "time")
        start, end = F.min(lower), F.max(upper)
        times = [F.timestamp_micros(F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2)).alias("time"), start.alias("time_start"), end.alias("time_end")]
    both = F.col("forecast").isNotNull() & F.col("observed").isNotNull()
    f, o = (F.when(both, F.col(c)) for c in ("forecast", "observed"))
    found = pairs.groupBy(*keys).agg(
        *shown,
        F.count_if(both).alias("n"),
        F.sqrt(F.avg((f - o) * (f - o))).alias("rmse"),
        F.avg(F.abs(f - o)).alias("mae"),
        F.avg(f - o).alias("additive_bias"),
        F.try_divide(F.covar_pop(f, o), F.stddev_pop(f) * F.stddev_pop(o)).alias("pearson"),
        *times,
    )
    return found.where("n > 0")


def event(value: Column, name: str, threshold: Column | float) -> Column:
    if name not in EVENTS:
        raise ValueError("an event is gt or lt a threshold")
    return value > threshold if name == "gt" else value < threshold


def contingency(pairs: DataFrame, preserve: list[str], name: str, thresholds: list[float]) -> DataFrame:
    """(preserve, threshold, hits, misses, false_alarms, correct_negatives) for each threshold, in one pass."""
    each = _pairs(pairs).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    f, o = event(F.col("forecast"), name, F.col("threshold")), event(F.col("observed"), name, F.col("threshold"))
    n = lambda c: F.count_if(c)
    return each.groupBy(*preserve, "threshold").agg(n(f & o).alias("hits"), n(~f & o).alias("misses"), n(f & ~o).alias("false_alarms"), n(~f & ~o).alias("correct_negatives"))


def detection(counts: DataFrame) -> DataFrame:
    """Contingency counts with pod and ets. Without an observed event pod is 0; a zero denominator leaves ets null."""
    h, m, f, c = (F.col(x) for x in ("hits", "misses", "false_alarms", "correct_negatives"))
    chance = F.try_divide((h + m) * (h + f), h + m + f + c)
    return counts.withColumns({"pod": F.coalesce(F.try_divide(h, h + m), F.lit(0.0)), "ets": F.try_divide(h - chance, h + m + f - chance)})


def partial_sums(pairs: DataFrame, preserve: list[str]) -> DataFrame:
    f, o = F.col("forecast"), F.col("observed")
    return _pairs(pairs).groupBy(*preserve).agg(F.avg(f).alias("f_mean"), F.avg(o).alias("o_mean"), F.avg(f * o).alias("fo_mean"), F.avg(f * f).alias("ff_mean"), F.avg(o * o).alias("oo_mean"))


def crps_members(field: DataFrame, cell: list[str], control: int = 0, method: str = "ecdf") -> DataFrame:
    """(cell, value): CRPS of the members beside the control member, a cell.

    An absent control is replaced by the cell's first member. Sorted members give the sum
    of all differences in one pass. Fewer than 2 members beside the control: no value.
    """
    if method not in ("ecdf", "fair"):
        raise ValueError(f"unknown method {method}")
    entries = F.sort_array(F.collect_list(F.struct((F.col("realization") != control).alias("late"), "realization", "value")))
    cells = field.where("value IS NOT NULL").groupBy(*cell).agg(entries.alias("m"))
    cells = cells.select(*cell, F.get("m", F.lit(0)).getField("value").alias("y"), F.array_sort(F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda e: e.getField("value"))).alias("x"))
    n = F.size("x")
    error = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("y")))
    ranked = F.transform("x", lambda v, i: (2 * (i + 1) - n - 1) * v)
    spread = F.aggregate(ranked, F.lit(0.0), lambda s, v: s + v)
    pairs = n * n if method == "ecdf" else n * (n - 1)
    return cells.where(n >= 2).select(*cell, (error / n - spread / pairs).alias("value"))


def crps(field: DataFrame, keep: list[str], cell: list[str], control: int = 0, method: str = "ecdf") -> DataFrame:
    return crps_members(field, cell, control, method).groupBy(*keep).agg(F.avg("value").alias("crps"))
