"""Joining and aligning fields by keys: grid indices, times, members; never by floating coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.surface import wind_direction, wind_speed
from fieldweave.operators.regrid import regrid_onto
from fieldweave.shared import found_in

#: Variables on staggered grids, always regridded before a difference.
STAGGERED = (
    "eastward_wind_at_10m",
    "northward_wind_at_10m",
    "northward_wind_at_cell_centres",
    "eastward_wind_at_cell_centres",
    "zonal_wind_at_pressure_levels",
    "meridional_wind_at_pressure_levels",
    "potential_vorticity_at_pressure_levels",
    "vapour_specific_humidity_at_pressure_levels_for_climate_averaging",
)


def common_points(fields: DataFrame, coordinates: list[str]) -> DataFrame:
    """``fields`` at the points of ``coordinates`` that every model has; an error, when it runs, if there is none.

    One aggregation counts models a point; the points, few beside the cells, are joined to them.
    """
    models = fields.agg(F.count_distinct("model_name")).scalar()
    points = fields.groupBy(*coordinates).agg(F.count_distinct("model_name").alias("n")).where(F.col("n") == models).select(*coordinates)
    return found_in(fields, points, coordinates, f"no common {', '.join(coordinates)}")


def paired(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_name, base, other): each other model's value beside the base's, where both have the cell.

    A join on the cell's keys; the base side is hashed the same way, so neither side moves twice.
    """
    base = fields.where("is_base").select(*keys, F.col("value").alias("base"))
    return fields.where("NOT is_base").select(*keys, "model_name", F.col("value").alias("other")).join(base, keys)


def difference(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_name, value): other minus base."""
    return paired(fields, keys).select(*keys, "model_name", (F.col("other") - F.col("base")).alias("value"))


def named_difference(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(variable, units, keys, model_name, value): other minus base of each variable, under the base's name with ``_difference`` and its units."""
    base = fields.where("is_base").select("variable", "units", *keys, F.col("value").alias("base"))
    met = fields.where("NOT is_base").select("variable", *keys, "model_name", "value").join(base, ["variable", *keys])
    return met.select(F.concat("variable", F.lit("_difference")).alias("variable"), "units", *keys, "model_name", (F.col("value") - F.col("base")).alias("value"))


def regridded_difference(fields: DataFrame, base_axes: tuple[DataFrame, DataFrame], other_axes: tuple[DataFrame, DataFrame], keys: list[str], same_grid: bool = False) -> DataFrame:
    """(keys, iy, ix, model_name, value) of fields with a variable: the base goes linearly onto the other grid first.

    On the same grid only the STAGGERED variables do. ``keys`` without iy and ix; axes are (i, c) tables.
    """
    keep = ["is_base", "variable", *keys]
    moved = F.col("is_base") & (F.col("variable").isin(*STAGGERED) if same_grid else F.lit(True))
    base = regrid_onto(fields.where(moved), base_axes, other_axes, keep)
    rest = fields.where(~moved).select(*keep, "model_name", "iy", "ix", "value")
    return difference(base.unionByName(rest, allowMissingColumns=True), ["variable", *keys, "iy", "ix"])


def vector_wind(u: DataFrame, v: DataFrame, u_axes: tuple[DataFrame, DataFrame], v_axes: tuple[DataFrame, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, iy, ix, variable, units, value): wind_speed and wind_from_direction of the fields ``u`` and ``v`` (keys, iy, ix, units, value).

    ``keys`` without iy and ix. On axes (i, c) of other lengths u goes linearly onto the grid
    of v first. Cells of both fields count; an error, when it runs, where their units differ.
    """
    shape = lambda axes: [a.count() for a in axes]
    if shape(u_axes) != shape(v_axes):
        u = regrid_onto(u, u_axes, v_axes, [*keys, "units"])
    both = u.select(*keys, "iy", "ix", F.col("units").alias("__u_units"), F.col("value").alias("u")).join(v.select(*keys, "iy", "ix", "units", F.col("value").alias("v")), [*keys, "iy", "ix"])
    units = F.when(F.col("__u_units").eqNullSafe(F.col("units")), F.col("units")).otherwise(F.raise_error(F.lit("u and v need the same units")))
    speed, direction = wind_speed(F.col("u"), F.col("v")), wind_direction(F.col("u"), F.col("v"))
    kinds = F.array(
        F.struct(F.lit("wind_speed").alias("variable"), F.col("units").alias("units"), speed.alias("value")),
        F.struct(F.lit("wind_from_direction").alias("variable"), F.lit("degrees").alias("units"), direction.alias("value")),
    )
    return both.withColumn("units", units).select(*keys, "iy", "ix", F.inline(kinds))


def pivoted_difference(fields: DataFrame, keys: list[str], other: str) -> DataFrame:
    """(keys, value) for one other model, in a single aggregation without a join."""
    of = lambda c: F.max(F.when(c, F.col("value")))
    cells = fields.where(F.col("is_base") | (F.col("model_name") == other)).groupBy(*keys).agg(of(F.col("is_base")).alias("base"), of(~F.col("is_base")).alias("other"))
    return cells.where("base IS NOT NULL AND other IS NOT NULL").select(*keys, (F.col("other") - F.col("base")).alias("value"))


def arithmetic(a: DataFrame, b: DataFrame, keys: list[str], operation: str) -> DataFrame:
    """add, subtract, multiply or divide two fields cell by cell; keys that ``b`` lacks are not compared (it is repeated)."""
    x, y = F.col("value"), F.col("__b")
    operations = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.try_divide(x, y)}
    if operation not in operations:
        raise ValueError(f"unknown operation {operation}")
    shared = [k for k in keys if k in b.columns]
    both = a.join(b.select(*shared, F.col("value").alias("__b"), F.col("variable").alias("__name")), shared)
    named = both.withColumn("variable", F.concat_ws("_x_", "variable", "__name")) if operation == "multiply" else both
    return named.withColumn("value", operations[operation]).drop("__b", "__name")


def matched_points(fields: DataFrame, *point: str) -> DataFrame:
    """(point, models): which models have each point of the union."""
    return fields.groupBy(*point).agg(F.array_sort(F.collect_set("model_name")).alias("models"))


def pivot_variables(field: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """A row a cell with a column for each variable: one aggregation, not a join a variable."""
    return field.where(F.col("variable").isin(variables)).groupBy(*keys).agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables))
