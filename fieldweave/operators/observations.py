"""Observation reports: matching in time, dedupe, reshaping, coding; and forecasts made from reanalyses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators.regrid import AxisSearch, rotate_pole

#: Fixed values.
MESSAGE_TYPES = {"AIREP": "AIRCFT", "Land Surface": "ADPSFC", "Sea Surface": "SFCSHP", "Upper Air Sounding": "ADPUPA"}
ACCUMULATED = ("PRATE", "TSTM", "APCP", "NCPCP", "ACPCP")


def match_window(forecasts: DataFrame, observations: DataFrame, keys: list[str], seconds: int = 1800) -> DataFrame:
    """Forecasts (keys, time, value) and observations of the same keys within ``seconds`` of their time, ends included.

    Time is cut into buckets as wide as the window; a forecast looks in its own bucket and
    both neighbours. So it is an equality join on keys and bucket.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = forecasts.select(*keys, F.col("time").alias("valid"), F.col("value").alias("forecast")).withColumn("__b", F.explode(F.array(*(bucket("valid") + d for d in (-1, 0, 1)))))
    right = observations.select(*keys, F.col("time").alias("obs_time"), F.col("value").alias("observed")).withColumn("__b", bucket("obs_time"))
    near = F.abs(F.unix_micros("obs_time") - F.unix_micros("valid")) <= seconds * 1_000_000
    return left.join(right, [*keys, "__b"]).where(near).select(*keys, "valid", "obs_time", "forecast", "observed")


def match_nearest(forecasts: DataFrame, observations: DataFrame, axes: tuple[DataFrame, DataFrame], keys: list[str], seconds: int = 1800, pole: tuple[float, float] | None = None) -> DataFrame:
    """Each observation (y, x, time, value, ...) beside the nearest cell of ``forecasts`` (keys, time, iy, ix, value), for each of the ``keys``.

    The nearest point of each axis (i, c), found by search; with ``pole`` (latitude,
    longitude of the grid's north pole) y and x are true ones. Of the valid times within
    ``seconds``, ends included, the nearest one counts (ties: the earlier). Observations
    outside the axes, without time or place, or without a forecast in the window have no
    row; equal observations count once. One equality join on cell and time bucket: an
    observation, the smaller side, looks in its own bucket and both neighbours.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    y, x = (F.col(c).cast("double") for c in "yx")
    if pole:
        y, x = rotate_pole(y, x, *pole)
    placed = observations.dropDuplicates().withColumns({"iy": AxisSearch(axes[0]).nearest(y), "ix": AxisSearch(axes[1]).nearest(x)})
    own = [c for c in placed.columns if c not in ("time", "value")]
    placed = placed.where("iy IS NOT NULL AND ix IS NOT NULL AND time IS NOT NULL").select(*own, F.col("time").alias("obs_time"), F.col("value").alias("observed"))
    placed = placed.withColumn("__b", F.explode(F.array(*(bucket("obs_time") + d for d in (-1, 0, 1)))))
    cells = forecasts.select(*keys, "iy", "ix", F.col("time").alias("valid"), F.col("value").alias("forecast"), bucket("time").alias("__b"))
    gap = F.abs(F.unix_micros("obs_time") - F.unix_micros("valid"))
    met = cells.join(placed, ["iy", "ix", "__b"]).where(gap <= seconds * 1_000_000)
    report = [*keys, *own, "obs_time", "observed"]
    return met.groupBy(*report).agg(F.min_by(F.struct("valid", "forecast"), F.struct(gap, "valid")).alias("__n")).select(*report, "__n.valid", "__n.forecast")


def pseudo_forecasts(reanalysis: DataFrame, first: datetime, last: datetime, every_hours: int, length_hours: int) -> DataFrame:
    """``reanalysis`` (variable, time, ...) as forecasts from each cycle start, first and last included.

    A cycle takes the times up to ``length_hours`` on; one that the variable's times do
    not cover is left out. forecast_period counts from the start, in hours. An error if nothing is left.
    Each row finds its cycles by arithmetic on its own time, so nothing is joined but
    the variables' spans.
    """
    if every_hours < 1 or length_hours < 0:
        raise ValueError("cycles need a positive step and a length")
    cycles = (last - first).total_seconds() // 3600 // every_hours
    start, step, length = F.lit(int(first.timestamp() * 1_000_000)), every_hours * 3_600_000_000, length_hours * 3_600_000_000
    spans = reanalysis.groupBy("variable").agg(F.unix_micros(F.min("time")).alias("__lo"), F.unix_micros(F.max("time")).alias("__hi"))
    since = F.unix_micros("time") - start
    lo = F.greatest(F.lit(0), F.ceil((since - length) / step)).cast("long")
    hi = F.least(F.lit(int(cycles)), F.floor(since / step)).cast("long")
    rows = reanalysis.where(lo <= hi).withColumn("__c", F.explode(F.sequence(lo, hi))).join(spans, "variable")
    began = start + F.col("__c") * step
    rows = rows.where((began >= F.col("__lo")) & (began + length <= F.col("__hi")))
    out = rows.withColumn("forecast_reference_time", F.timestamp_micros(began)).withColumn("forecast_period", (F.unix_micros("time") - began) / 3.6e9).drop("__c", "__lo", "__hi")
    if out.isEmpty():
        raise ValueError("no cycle lies within the reanalysis")
    return out


def enrich(reports: DataFrame, variables: DataFrame, report_types: DataFrame) -> DataFrame:
    """Active reports (statuses or-ed are 1) with what the small tables say of their variable and type."""
    active = reports.where(F.col("report_status").bitwiseOR(F.col("datum_status")) == 1)
    return active.join(variables, "varno", "left").join(report_types, "reportype", "left")


def keep_last(reports: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last report of each key by ``position``: one aggregation, not a sort."""
    others = [c for c in reports.columns if c not in keys]
    last = reports.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("__l"))
    return last.select(*keys, *(F.col(f"__l.{c}").alias(c) for c in others))


def to_long(reports: DataFrame, ids: list[str], names: dict[str, str], start: str, end: str, missing: float = -99.0) -> DataFrame:
    """(ids, var, obs): a row a variable of ``names``, for start < vld <= end, without missing values and elevations."""
    inside = (F.col("vld") > F.lit(start).cast("timestamp")) & (F.col("vld") <= F.lit(end).cast("timestamp"))
    present = [c for c in names if c in reports.columns]
    long = reports.where(inside).unpivot(ids, [F.col(c).cast("double").alias(c) for c in present], "var", "obs")
    named = F.create_map(*(F.lit(x) for c in present for x in (c, names[c])))
    kept = long.where((F.col("obs") != missing) & ((F.col("elv") != missing) if "elv" in ids else F.lit(True)))
    return kept.withColumn("var", named[F.col("var")])


def level(coordinate_type: Column, reference: Column) -> Column:
    return F.when(coordinate_type.isin(1, 11, 15), reference)


def height(coordinate_type: Column, reference: Column) -> Column:
    return F.when((coordinate_type == 5) & (reference == 1), reference * 0)


def message_type(buffer_type: Column, report_type: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in MESSAGE_TYPES.items() for x in pair))
    return F.coalesce(named[buffer_type], report_type.cast("string"))


def station_name(name: Column) -> Column:
    return F.when(F.trim(name) == "", F.lit("NA")).otherwise(F.trim(name))


def report_time(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat(date.cast("string"), F.lpad(time.cast("string"), 6, "0")), "yyyyMMddHHmmss")


def code_reports(reports: DataFrame) -> DataFrame:
    """Level, height, message type, station and time of observation reports; accumulated variables are an error."""
    name = F.when(F.col("name").isin(*ACCUMULATED), F.raise_error(F.lit("accumulated variables are not coded")).cast("string")).otherwise(F.col("name"))
    kind, ref = F.col("vertco_type"), F.col("vertco_reference_1")
    return reports.select(
        message_type(F.col("bufrtype"), F.col("reportype")).alias("Message_Type"),
        station_name(F.col("statid")).alias("Station_ID"),
        report_time(F.col("date"), F.col("time")).alias("Valid_Time"),
        F.col("lat").alias("Lat"),
        F.col("lon").alias("Lon"),
        F.col("stalt").alias("Elevation"),
        name.alias("Variable_Name"),
        level(kind, ref).alias("Level"),
        height(kind, ref).alias("Height"),
        F.lit("0").alias("QC_String"),
        F.col("obsvalue").alias("Observation_Value"),
    )


def double_kinetic_error(winds: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, realization, value): half the squared wind differences of each member from member 0, from u and v.

    Member 0's winds come from a window over the cell's members, so the field moves once.
    """
    w = Window.partitionBy(*cell)
    control = lambda c: F.max(F.when(F.col("realization") == 0, F.col(c))).over(w)
    both = winds.withColumn("__u", control("u")).withColumn("__v", control("v")).where("realization <> 0 AND __u IS NOT NULL AND __v IS NOT NULL")
    du, dv = F.col("__u") - F.col("u"), F.col("__v") - F.col("v")
    return both.select(*cell, "realization", (0.5 * du * du + 0.5 * dv * dv).alias("value"))
