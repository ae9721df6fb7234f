"""Unit conversion. Each unit is an affine function of a base unit: base = value * scale + offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T0 = 273.15
#: unit: (base unit, scale, offset)
UNITS = {
    "K": ("K", 1.0, 0.0),
    "Celsius": ("K", 1.0, T0),
    "Fahrenheit": ("K", 5 / 9, T0 - 32 * 5 / 9),
    "m": ("m", 1.0, 0.0),
    "km": ("m", 1000.0, 0.0),
    "ft": ("m", 0.3048, 0.0),
    "kilofeet": ("m", 304.8, 0.0),
    "Pa": ("Pa", 1.0, 0.0),
    "hPa": ("Pa", 100.0, 0.0),
    "1": ("1", 1.0, 0.0),
    "%": ("1", 0.01, 0.0),
    "m s-1": ("m s-1", 1.0, 0.0),
    "knots": ("m s-1", 1852 / 3600, 0.0),
    "mm": ("kg m-2", 1.0, 0.0),
    "cm": ("kg m-2", 10.0, 0.0),
    "kg m-2": ("kg m-2", 1.0, 0.0),
    "kg m-2 s-1": ("kg m-2 s-1", 1.0, 0.0),
    "mm s-1": ("kg m-2 s-1", 1.0, 0.0),
    "mm hr-1": ("kg m-2 s-1", 1 / 3600, 0.0),
}


def factors(source: str, target: str) -> tuple[float, float]:
    """(scale, offset) with target = source * scale + offset; units of different kinds raise."""
    (base, scale, offset), (other, to_scale, to_offset) = UNITS[source], UNITS[target]
    if base != other:
        raise ValueError(f"can't convert {source} to {target}")
    return scale / to_scale, (offset - to_offset) / to_scale


def convert(value: Column, source: str, target: str) -> Column:
    scale, offset = factors(source, target)
    return value * F.lit(scale) + F.lit(offset)


def convert_units(field: DataFrame, target: str) -> DataFrame:
    """``field`` with value and units in ``target``; a row of another kind of unit is an error when it is read."""
    value = F.when(F.col("units") == target, F.col("value"))
    for unit, (base, _, _) in UNITS.items():
        if base == UNITS[target][0] and unit != target:
            value = value.when(F.col("units") == unit, convert(F.col("value"), unit, target))
    wrong = F.raise_error(F.concat(F.lit(f"can't convert to {target} from "), F.coalesce(F.col("units"), F.lit("no unit"))))
    return field.withColumn("value", value.otherwise(wrong.cast("double"))).withColumn("units", F.lit(target))
