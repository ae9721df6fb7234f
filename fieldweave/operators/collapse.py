"""Aggregation over coordinates, with missing values left out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators.masks import condition
from fieldweave.shared import cut, found_in, required

#: Rows of a block of a series.
BLOCK = 4096


def aggregate(method: str, value: Column, percent: float | list[float] | None = None) -> Column:
    """MEAN, MAX, MIN, SUM, MEDIAN, PERCENTILE, RANGE, STD_DEV, VARIANCE or RMS of ``value``.

    Percentiles are exact, between neighbours linear; a list of them gives an array.
    Deviation and variance are those of a sample.
    """
    if method == "PERCENTILE":
        if percent is None:
            raise ValueError("PERCENTILE needs a percent")
        return F.percentile(value, [p / 100 for p in percent] if isinstance(percent, list) else percent / 100)
    methods = {
        "MEAN": F.avg(value),
        "MAX": F.max(value),
        "MIN": F.min(value),
        "SUM": F.sum(value),
        "MEDIAN": F.percentile(value, 0.5),
        "RANGE": F.max(value) - F.min(value),
        "STD_DEV": F.stddev_samp(value),
        "VARIANCE": F.var_samp(value),
        "RMS": F.sqrt(F.avg(value * value)),
    }
    if method not in methods:
        raise ValueError(f"unknown method {method}")
    return methods[method]


def collapse(field: DataFrame, keep: list[str], method: str | None, percent: float | list[float] | None = None) -> DataFrame:
    """(keep, value): ``field`` reduced over all other coordinates. "SEQ", "" or None passes it through.

    A median or percentile orders the values over several tasks, however few groups there are.
    """
    if method in ("SEQ", "", None):
        return field
    return reduced(field, keep, method, percent)


def exact_percentile(field: DataFrame, keep: list[str], percent: float | list[float]) -> DataFrame:
    """(keep, value) as by PERCENTILE, a list of percents giving an array, for groups too large for one task.

    Equal values are counted first. The counts are dealt to tasks by ranges of (keep, value),
    so a large group is spread over many; each range's total, summed over the ranges before
    it, places its values, and those at a percentile's two neighbouring positions are taken.
    """
    counted = field.where("value IS NOT NULL").groupBy(*keep, "value").agg(F.count("*").alias("n"))
    placed = cut(counted.repartitionByRange(*keep, "value").withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(Window.partitionBy(*keep).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy(*keep, "__part").agg(F.sum("n").alias("__n")).select(*(F.col(k).alias(f"__{k}") for k in keep), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keep)).alias("total"))
    own = Window.partitionBy(*keep, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.join(sums, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keep), F.col("__part") == F.col("__p")))
    upto = met.withColumn("upto", F.col("__before") + F.sum("n").over(own))
    percents = percent if isinstance(percent, list) else [percent]
    places = [(F.col("total") - 1) * F.lit(p / 100) for p in percents]
    first = lambda at: F.min(F.when(F.col("upto") > at, F.col("value")))
    found = upto.groupBy(*keep).agg(*(c for i, at in enumerate(places) for c in (first(F.floor(at)).alias(f"low{i}"), first(F.ceil(at)).alias(f"high{i}"), F.max(at - F.floor(at)).alias(f"part{i}"))))
    values = [F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}") for i in range(len(percents))]
    return found.select(*keep, (F.array(*values) if isinstance(percent, list) else values[0]).alias("value"))


def reduced(field: DataFrame, keep: list[str], method: str, percent: float | None = None) -> DataFrame:
    """(keep, value) by any method; medians and percentiles over ranges of values, so that no task holds a group."""
    if method == "PERCENTILE" and percent is None:
        raise ValueError("PERCENTILE needs a percent")
    if method in ("MEDIAN", "PERCENTILE"):
        return exact_percentile(field, keep, 50 if method == "MEDIAN" else percent)
    return field.groupBy(*keep).agg(aggregate(method, F.col("value"), percent).alias("value"))


def by_hour_of_day(cases: DataFrame, keep: list[str], method: str, percent: float | None = None) -> DataFrame:
    """(keep, hour, value): first each reference time by hour, then over reference times. A mean is a mean of means, a median one of medians."""
    hourly = reduced(cases.withColumn("hour", F.hour("time")), ["forecast_reference_time", *keep, "hour"], method, percent)
    return reduced(hourly, [*keep, "hour"], method, percent)


def by_validity_time(cases: DataFrame, keep: list[str], method: str, percent: float | None = None) -> DataFrame:
    """(keep, time, n_cases, value) over the cases that are valid at one time; an error, when it runs, if no two cases overlap."""
    valid = F.timestamp_micros(F.unix_micros("forecast_reference_time") + (F.col("forecast_period") * 3.6e9).cast("long"))
    timed = cases.withColumn("time", F.coalesce("time", valid) if "time" in cases.columns else valid)
    keys = [*keep, "time"]
    n_cases = F.count_distinct("forecast_reference_time").alias("n_cases")
    if method in ("MEDIAN", "PERCENTILE"):
        counted = timed.groupBy(*keys).agg(n_cases)
        out = counted.join(reduced(timed, keys, method, percent), keys, "left").select(*keys, "n_cases", "value")
    else:
        counted = out = timed.groupBy(*keys).agg(n_cases, aggregate(method, F.col("value"), percent).alias("value"))
    return required(out, counted.agg(F.max("n_cases") > 1), "no two cases overlap in time")


def overlapping_cases(cases: DataFrame) -> DataFrame:
    """``cases`` at the (reference time, lead time) that every model has; an error, when it runs, if there is none."""
    keys = ["forecast_reference_time", "forecast_period"]
    models = cases.agg(F.count_distinct("model_name")).scalar()
    shared = cases.groupBy(*keys).agg(F.count_distinct("model_name").alias("n")).where(F.col("n") == models).select(*keys)
    return found_in(cases, shared, keys, "no case is in every model")


def proportion(field: DataFrame, keep: list[str], name: str, threshold: float) -> DataFrame:
    """(keep, value): the part of the values present that meet the condition."""
    return field.groupBy(*keep).agg(F.avg(condition(F.col("value"), name, threshold).cast("double")).alias("value"))


def named_proportion(field: DataFrame, keep: list[str], name: str, threshold: float) -> DataFrame:
    """(variable, units, keep, value): ``proportion`` of each variable, named probability_of_(variable)_(condition)_(threshold), of units 1."""
    found = proportion(field, ["variable", *keep], name, threshold)
    label = F.concat(F.lit("probability_of_"), F.col("variable"), F.lit(f"_{name}_{threshold}"))
    return found.select(label.alias("variable"), F.lit("1").alias("units"), *keep, "value")


def whole_hours(duration: str) -> int:
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(\d+)H)?", duration)
    hours = 24 * int(m[1] or 0) + int(m[2] or 0) if m else 0
    if hours < 1:
        raise ValueError(f"not a duration of whole hours: {duration}")
    return hours


def by_time(field: DataFrame, keep: list[str], method: str, duration: str, percent: float | None = None) -> DataFrame:
    """(keep, time, value) over intervals of an ISO ``duration`` in whole hours, counted from 1970."""
    window = F.window("time", f"{whole_hours(duration)} hours")
    timed = field.select(*keep, window.alias("__w"), "value").select(*keep, F.col("__w.start").alias("time"), "value")
    return reduced(timed, [*keep, "time"], method, percent)


def stack_cases(fields: list[DataFrame]) -> DataFrame:
    """One table of cases; an error where a field has no reference time or lead time, or nulls in them."""
    from fieldweave.sources.io import combine

    keys = {"forecast_reference_time", "forecast_period"}
    if any(not keys <= set(f.columns) for f in fields):
        raise ValueError("cases need forecast_reference_time and forecast_period")
    missing = F.raise_error(F.lit("cases need forecast_reference_time and forecast_period in every row")).cast("boolean")
    return combine(*fields).where(F.when(F.col("forecast_reference_time").isNotNull() & F.col("forecast_period").isNotNull(), F.lit(True)).otherwise(missing))


def cases_per_lead(cases: DataFrame) -> DataFrame:
    return cases.groupBy("model_name", "forecast_period").agg(F.count_distinct("forecast_reference_time").alias("n_cases"))


def rolling(field: DataFrame, series: list[str], method: str, width: int, percent: float | None = None) -> DataFrame:
    """(series, time, value) over each ``width`` consecutive times of a series, full windows only; time is the middle.

    For medians and percentiles the rows of a series are numbered over ranges of time and cut
    into blocks of BLOCK rows, each with the ``width`` - 1 rows before it: a long series
    is worked on by many tasks, and each window's values are ordered by themselves.
    """
    if method in ("MEDIAN", "PERCENTILE"):
        if method == "PERCENTILE" and percent is None:
            raise ValueError("PERCENTILE needs a percent")
        return rolling_percentile(field, series, width, 50 if method == "MEDIAN" else percent)
    w = Window.partitionBy(*series).orderBy("time").rowsBetween(-(width - 1), 0)
    middle = F.timestamp_micros(((F.unix_micros(F.min("time").over(w)) + F.unix_micros(F.max("time").over(w))) / 2).cast("long"))
    if method == "RANGE":
        value = F.max("value").over(w) - F.min("value").over(w)
    elif method == "RMS":
        value = F.sqrt(F.avg(F.col("value") * F.col("value")).over(w))
    else:
        value = aggregate(method, F.col("value"), percent).over(w)
    out = field.select(*series, middle.alias("__t"), value.alias("value"), F.count(F.lit(1)).over(w).alias("__n"))
    return out.where(F.col("__n") == width).select(*series, F.col("__t").alias("time"), "value")


def numbered(rows: DataFrame, series: list[str], order: str) -> DataFrame:
    """``rows`` with __n, from 0 in ``order`` within each series: counts of ranges summed, then numbers within a range."""
    placed = cut(rows.repartitionByRange(*series, order).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*series).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(*series, "__part").agg(F.count("*").alias("__size")).select(*(F.col(k).alias(f"__{k}") for k in series), F.col("__part").alias("__p"), before.alias("__before"))
    met = placed.join(starts, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in series), F.col("__part") == F.col("__p")))
    own = F.row_number().over(Window.partitionBy(*series, "__part").orderBy(order)) - 1
    return met.withColumn("__n", F.col("__before") + own).select(*rows.columns, "__n")


def rolling_percentile(field: DataFrame, series: list[str], width: int, percent: float) -> DataFrame:
    rows = numbered(field.select(*series, "time", "value"), series, "time")
    blocks = F.explode(F.sequence(F.floor(F.col("__n") / BLOCK), F.floor((F.col("__n") + width - 1) / BLOCK)))
    w = Window.partitionBy(*series, "__b").orderBy("__n").rowsBetween(-(width - 1), 0)
    middle = F.timestamp_micros(((F.unix_micros(F.min("time").over(w)) + F.unix_micros(F.max("time").over(w))) / 2).cast("long"))
    found = rows.withColumn("__b", blocks).select(*series, "__n", "__b", middle.alias("time"), F.collect_list("value").over(w).alias("__v"), F.count(F.lit(1)).over(w).alias("__size"))
    # A row that a block has only before its own gives no window there; values that are present count.
    found = found.where((F.floor(F.col("__n") / BLOCK) == F.col("__b")) & (F.col("__size") == width)).withColumn("__v", F.array_sort("__v"))
    place = (F.size("__v") - 1) * F.lit(percent / 100)
    at = lambda i: F.get("__v", i.cast("int"))
    value = at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (place - F.floor(place))
    return found.select(*series, "time", value.alias("value"))


def domain_statistics(field: DataFrame, keep: list[str]) -> DataFrame:
    return field.groupBy(*keep).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg("value").alias("mean"))
