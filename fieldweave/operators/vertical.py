"""Work on vertical columns and ordered coordinates: differences, integrals, layers, interpolation.

``column`` names a column's keys. All windows share one partitioning, by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.surface import wind_direction, wind_speed

LAYER_OUTPUTS = ("number", "depth", "base", "wind_below", "directional_shear")


def differentiate(field: DataFrame, series: list[str], coordinate: str) -> DataFrame:
    """(series, coordinate, value): slopes between neighbours, at the middle of each pair."""
    w = Window.partitionBy(*series).orderBy(coordinate)
    ahead = field.select(*series, coordinate, "value", F.lead(coordinate).over(w).alias("__c"), F.lead("value").over(w).alias("__v"))
    ahead = ahead.where("__c IS NOT NULL")
    return ahead.select(*series, ((F.col(coordinate) + F.col("__c")) / 2).alias(coordinate), F.try_divide(F.col("__v") - F.col("value"), F.col("__c") - F.col(coordinate)).alias("value"))


def integrate(field: DataFrame, column: list[str], height: str = "level_height") -> DataFrame:
    """(column, value): the integral over height by trapezoids."""
    w = Window.partitionBy(*column).orderBy(height)
    ahead = field.select(*column, height, "value", F.lead(height).over(w).alias("__z"), F.lead("value").over(w).alias("__v"))
    return ahead.groupBy(*column).agg(F.sum((F.col("value") + F.col("__v")) / 2 * (F.col("__z") - F.col(height))).alias("value"))


def precipitable_water(levels: DataFrame, column: list[str]) -> DataFrame:
    """(column, water, saturation_water, saturation_fraction) from mixing_ratio and relative_humidity on levels.

    Both integrals come from one window pass.
    """
    w = Window.partitionBy(*column).orderBy("level_height")
    saturated = levels.withColumn("__s", F.try_divide("mixing_ratio", "relative_humidity"))
    ahead = saturated.select(*column, "mixing_ratio", "__s", *(F.lead(c).over(w).alias(f"__{c}1") for c in ("mixing_ratio", "__s", "level_height")), "level_height")
    dz = F.col("__level_height1") - F.col("level_height")
    out = ahead.groupBy(*column).agg(
        F.sum((F.col("mixing_ratio") + F.col("__mixing_ratio1")) / 2 * dz).alias("water"), F.sum((F.col("__s") + F.col("____s1")) / 2 * dz).alias("saturation_water")
    )
    return out.withColumn("saturation_fraction", F.try_divide("water", "saturation_water"))


def layers(levels: DataFrame, column: list[str]) -> DataFrame:
    """(column, number, depth, base, top) of the runs of 1 in a 0/1 ``mask`` over ``level_height``.

    depth, base and top are those of the deepest run, the lowest on ties; null without a
    run. A run of one level has depth 0. A mask that is not 0 or 1 is an error.
    """
    w = Window.partitionBy(*column).orderBy("level_height")
    checked = F.when(F.col("mask").isin(0, 1), F.col("mask")).otherwise(F.raise_error(F.lit("a mask must be 0 or 1")).cast("double"))
    starts = levels.withColumn("__m", checked).withColumn("__new", ((F.col("__m") == 1) & (F.coalesce(F.lag("__m").over(w), F.lit(0)) == 0)).cast("int"))
    runs = starts.withColumn("__run", F.sum("__new").over(w))
    spans = runs.groupBy(*column, "__run").agg(F.min(F.when(F.col("__m") == 1, F.col("level_height"))).alias("base"), F.max(F.when(F.col("__m") == 1, F.col("level_height"))).alias("top"))
    depth = F.col("top") - F.col("base")
    best = F.max_by(F.struct("base", "top"), F.struct(depth.alias("d"), (-F.col("base")).alias("b")))
    out = spans.groupBy(*column).agg(F.count("base").alias("number"), best.alias("__best"))
    return out.select(*column, "number", (F.col("__best.top") - F.col("__best.base")).alias("depth"), F.col("__best.base").alias("base"), F.col("__best.top").alias("top"))


def layer_properties(levels: DataFrame, column: list[str], output: str) -> DataFrame:
    """(column, value): one of LAYER_OUTPUTS; wind_below and directional_shear need u and v on the levels.

    wind_below: the mean speed strictly under the base. directional_shear: direction at
    the top minus that at the base, between -180 and 180.
    """
    if output not in LAYER_OUTPUTS:
        raise ValueError(f"unknown output {output}")
    found = layers(levels, column)
    if output in ("number", "depth", "base"):
        return found.select(*column, F.col(output).cast("double").alias("value"))
    both = levels.select(*column, "level_height", "u", "v").join(found.select(*column, "base", "top"), column)
    if output == "wind_below":
        under = F.when(F.col("level_height") < F.col("base"), wind_speed(F.col("u"), F.col("v")))
        return both.groupBy(*column).agg(F.avg(under).alias("value"))
    at = lambda edge: F.max(F.when(F.col("level_height") == F.col(edge), wind_direction(F.col("u"), F.col("v"))))
    turned = both.groupBy(*column).agg(F.round(at("top") - at("base"), 9).alias("__d"))
    return turned.select(*column, (F.pmod(F.col("__d") + 180, F.lit(360.0)) - 180).alias("value"))


def interpolate(field: DataFrame, column: list[str], coordinate: str, targets: list[float]) -> DataFrame:
    """(column, coordinate, value) at ``targets``, linear between neighbours and beyond the ends.

    Each pair of neighbours takes the targets from its lower point to before its upper
    one; the lowest pair also those below, the highest those above. The few targets are
    an array, so there is no join. A column of one level gives nothing.
    """
    w = Window.partitionBy(*column).orderBy(coordinate)
    pairs = field.select(
        *column, F.col(coordinate).alias("__c"), "value", F.lead(coordinate).over(w).alias("__d"), F.lead("value").over(w).alias("__v"), F.row_number().over(w).alias("__i"), F.lead(coordinate, 2).over(w).alias("__after")
    ).where("__d IS NOT NULL")
    mine = F.filter(
        F.array(*(F.lit(float(t)) for t in targets)),
        lambda t: ((t >= F.col("__c")) | (F.col("__i") == 1)) & ((t < F.col("__d")) | F.col("__after").isNull()),
    )
    each = pairs.withColumn("__t", F.explode(mine))
    slope = F.try_divide(F.col("__v") - F.col("value"), F.col("__d") - F.col("__c"))
    return each.select(*column, F.col("__t").alias(coordinate), (F.col("value") + slope * (F.col("__t") - F.col("__c"))).alias("value"))


def rain_rate(depths: DataFrame, series: list[str]) -> DataFrame:
    """(series, time, value in kg m-2 s-1) from depths in mm at times.

    The duration of a depth comes from time_lower and time_upper where they are there,
    else it lasts to the next time; the last one as long as the one before. A duration
    that is not positive, or a series of one time without bounds, is an error.
    """
    w = Window.partitionBy(*series).orderBy("time")
    second = lambda c: F.unix_micros(c) / 1e6
    step = second(F.lead("time").over(w)) - second(F.col("time"))
    back = second(F.col("time")) - second(F.lag("time").over(w))
    bounds = second(F.col("time_upper")) - second(F.col("time_lower")) if {"time_lower", "time_upper"} <= set(depths.columns) else F.lit(None).cast("double")
    lasted = depths.select(*series, "time", "value", F.coalesce(bounds, step, back).alias("__s"))
    bad = F.raise_error(F.lit("a rain depth needs a positive duration")).cast("double")
    return lasted.select(*series, "time", F.when(F.col("__s") > 0, F.col("value") / F.col("__s")).otherwise(bad).alias("value"))


RAIN = ("rainfall", "precipitation")


def rainfall_to_rate(field: DataFrame, series: list[str]) -> DataFrame:
    """``field`` (series, variable, units, time, value) with depths of rain as rates; rates and other variables pass.

    Depths are rows of a rain variable in mm, cm, m or kg m-2. A variable has one unit.
    """
    scale = F.when(F.col("units").isin("mm", "kg m-2"), 1.0).when(F.col("units") == "cm", 10.0).when(F.col("units") == "m", 1000.0)
    rain = F.coalesce(F.col("variable").rlike("|".join(RAIN)), F.lit(False)) & scale.isNotNull()
    bounds = [c for c in ("time_lower", "time_upper") if c in field.columns]
    depth = field.where(rain).select(*series, "variable", "time", *bounds, (F.col("value") * scale).alias("value"))
    rates = rain_rate(depth, [*series, "variable"]).withColumn("units", F.lit("kg m-2 s-1"))
    return field.where(~rain).select(*series, "variable", "units", "time", "value").unionByName(rates)
