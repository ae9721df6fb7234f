"""Ready-made diagnostics: short compositions of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.thermo import equivalent_potential_temperature
from fieldweave.functions.surface import beaufort
from fieldweave.operators.collapse import rolling
from fieldweave.operators.masks import mask

#: Conditions, all of which must hold. Visibility in km, rain in mm hr-1, temperature in K, cloud base in m.
PRESENCE = {
    "fog": (("lt", 0.25),),
    "thick_fog": (("le", 0.1),),
    "aviation_fog": (("lt", 1.0),),
    "rain": (("gt", 0.0),),
    "light_rain": (("gt", 0.0), ("lt", 2.0)),
    "moderate_rain": (("ge", 2.0), ("lt", 10.0)),
    "heavy_rain": (("ge", 10.0), ("lt", 50.0)),
    "violent_rain": (("ge", 50.0),),
    "frost": (("lt", 273.15),),
    "snow": (("gt", 0.0),),
    "lightning": (("gt", 0.0),),
    "low_cloud": (("lt", 50.0),),
}
#: Beaufort force from which a wind has its name.
WINDS = {"gale": 8.0, "storm": 10.0, "hurricane": 12.0}
DAY_END = 21


def presence(value: Column, name: str) -> Column:
    """1.0 where all conditions of ``name`` hold, else 0.0: masks of one field multiply on the row, without a join."""
    return reduce(lambda a, b: a * b, (mask(value, c, t) for c, t in PRESENCE[name]))


def wind_presence(speed: Column, name: str) -> Column:
    return mask(beaufort(speed), "ge", WINDS[name])


def domain_fraction(field: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """(keep, a column a name): the part of the domain where each presence holds, in one pass."""
    return field.groupBy(*keep).agg(*(F.avg(presence(F.col("value"), n)).alias(n) for n in names))


def daily_extreme(hourly: DataFrame, series: list[str], method: str) -> DataFrame:
    """(series, time, value): extremes of 24 hours from 09 to 09, told by the middle of their window at hour 21."""
    return rolling(hourly, series, method, 24).where(F.hour("time") == DAY_END)


def unstable_layers(levels: DataFrame, column: list[str]) -> DataFrame:
    """(column, level_height, mask): 1 between two levels where equivalent potential temperature falls and the air is moist.

    ``levels``: t, p, rh (fraction) and level_height. The mask stands at the lower level.
    """
    w = Window.partitionBy(*column).orderBy("level_height")
    theta = levels.withColumn("__th", equivalent_potential_temperature(F.col("t"), F.col("rh"), F.col("p")))
    slope = F.try_divide(F.lead("__th").over(w) - F.col("__th"), F.lead("level_height").over(w) - F.col("level_height"))
    both = theta.select(*column, "level_height", slope.alias("__s"), "rh")
    return both.select(*column, "level_height", (mask(F.col("__s"), "lt", 0.0) * mask(F.col("rh"), "gt", 0.9)).alias("mask"))
