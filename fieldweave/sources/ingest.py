"""Normalising fields on read: projections over every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.surface import wind_speed
from fieldweave.functions.thermo import finite

#: Attributes that tell files apart but not fields.
FILE_ATTRIBUTES = ("timeStamp", "uuid", "name", "source", "analysis_source", "history", "radar_sites", "additional_radar_sites", "recursive_filter_iterations", "Probability methods")
#: STASH codes of radiation fields, and of accumulations that are marked as means.
RADIATION = ("m01s01i207", "m01s01i208", "m01s02i205", "m01s02i201", "m01s02i207", "m01s01i235")
#: STASH codes of lightning, rain and snow, which are accumulations.
ACCUMULATED = ("m01s21i104", "m01s04i201", "m01s04i202", "m01s05i201", "m01s05i202")
#: STASH codes of the 10 m wind along the grid's own axes.
GRID_WINDS = ("m01s03i225", "m01s03i226")
SPEED_UNITS = "m s-1"
HIGHEST_CLOUD_BASE = 144


def clean(field: DataFrame) -> DataFrame:
    """NaN and infinite values become null, which aggregates skip."""
    return field.withColumn("value", finite(F.col("value")))


def default_realization(field: DataFrame) -> DataFrame:
    return field.withColumn("realization", F.coalesce("realization", F.lit(0)))


def name_from_stash(field: DataFrame, names: DataFrame) -> DataFrame:
    """variable from the table ``names`` (stash, name); a code that it lacks keeps its name."""
    return field.join(names.select("stash", F.col("name").alias("__name")), "stash", "left").withColumn("variable", F.coalesce("__name", "variable")).drop("__name")


def drop_file_attributes(field: DataFrame) -> DataFrame:
    """Without attributes that tell files apart; the list of STASH sources in order."""
    kept = F.map_filter("attributes", lambda k, v: ~k.isin(*FILE_ATTRIBUTES))
    order = lambda k, v: F.when(k == "um_stash_source", F.array_join(F.array_sort(F.regexp_extract_all(v, F.lit("m[0-9]{2}s[0-9]{2}i[0-9]{3}"), F.lit(0))), ",")).otherwise(v)
    return field.withColumn("attributes", F.transform_values(kept, order))


def wrap_longitude(axes: DataFrame) -> DataFrame:
    """``axes`` (model_name, ix, x) moved by whole turns, so each model's median longitude lies in [-175, 175)."""
    median = axes.groupBy("model_name").agg(F.median("x").alias("__mid"))
    turns = F.when(F.col("__mid") < -175, F.ceil((-175 - F.col("__mid")) / 360)).when(F.col("__mid") >= 175, -(F.floor((F.col("__mid") - 175) / 360) + 1)).otherwise(0)
    return axes.join(median, "model_name").withColumn("x", F.col("x") + 360 * turns).drop("__mid")


def pressure_levels(field: DataFrame) -> DataFrame:
    """Pressure levels in hPa under one name."""
    own = F.lower("level_type").isin("pressure", "pressure_level", "air_pressure")
    pascal = own & (F.col("level_units") == "Pa")
    return field.withColumns({"level": F.when(pascal, F.col("level") / 100).otherwise(F.col("level")), "level_units": F.when(pascal, F.lit("hPa")).otherwise(F.col("level_units")), "level_type": F.when(own, F.lit("pressure")).otherwise(F.col("level_type"))})


def radiation_times(field: DataFrame) -> DataFrame:
    """Radiation fields whose first time is neither :00 nor :30 exactly move to the nearest hour, lead times too."""
    first = F.min("time").over(Window.partitionBy("model_name", "variable", "forecast_reference_time"))
    minute, second = F.minute(first), F.second(first)
    moved = F.when(F.col("stash").isin(*RADIATION) & ~(minute.isin(0, 30) & (second == 0)), 60 * F.when(minute > 30, minute - 60).otherwise(minute) + second).otherwise(0)
    shifted = field.withColumn("__s", moved)
    return shifted.withColumn("time", F.timestamp_micros(F.unix_micros("time") - F.col("__s") * 1_000_000)).withColumn("forecast_period", F.col("forecast_period") - F.col("__s") / 3600).drop("__s")


def accumulations(field: DataFrame, codes: tuple[str, ...] = ACCUMULATED) -> DataFrame:
    """Cell methods of the accumulated ``codes`` say sum where they all said mean."""
    fixed = F.transform("cell_methods", lambda m: F.when(m.getField("method") == "mean", m.withField("method", F.lit("sum"))).otherwise(m))
    return field.withColumn("cell_methods", F.when(F.col("stash").isin(*codes) & F.forall("cell_methods", lambda m: F.coalesce(m.getField("method") == "mean", F.lit(False))), fixed).otherwise(F.col("cell_methods")))


def microphysics_units(field: DataFrame) -> DataFrame:
    """Surface microphysical rates in mm hr-1 and amounts in mm; visibility in km."""
    rain, units = F.contains("variable", F.lit("surface_microphysical")), F.col("units")
    rate, amount, far = rain & (units == "kg m-2 s-1"), rain & (units == "kg m-2"), F.contains("variable", F.lit("visibility")) & (units == "m")
    value = F.when(rate, F.col("value") * 3600).when(far, F.col("value") / 1000).otherwise(F.col("value"))
    return field.withColumns({"value": value, "units": F.when(rate, F.lit("mm hr-1")).when(amount, F.lit("mm")).when(far, F.lit("km")).otherwise(units)})


def mask_cloud_base(field: DataFrame) -> DataFrame:
    return field.withColumn("value", F.when(~((F.col("variable") == "cloud_base_altitude") & (F.col("value") > HIGHEST_CLOUD_BASE)), F.col("value")))


def lead_times(field: DataFrame) -> DataFrame:
    """forecast_period in hours from the two times, where it is missing."""
    hours = (F.unix_micros("time") - F.unix_micros("forecast_reference_time")) / 3.6e9
    return field.withColumn("forecast_period", F.coalesce("forecast_period", hours))


def dummy_time(field: DataFrame) -> DataFrame:
    return field.withColumn("time", F.coalesce("time", F.timestamp_seconds(F.lit(0))))


#: Names by whether a field is on pressure levels.
PRESSURE_NAMES = {
    "x_wind": "zonal_wind_at_pressure_levels",
    "y_wind": "meridional_wind_at_pressure_levels",
    "air_temperature": "temperature_at_pressure_levels",
    "specific_humidity": "vapour_specific_humidity_at_pressure_levels_for_climate_averaging",
}
SURFACE_NAMES = {("x_wind", "u_wind_at_10m"): "eastward_wind_at_10m", ("y_wind", "v_wind_at_10m"): "northward_wind_at_10m"}


def long_names(field: DataFrame) -> DataFrame:
    on = F.coalesce(F.col("level_type") == "pressure", F.lit(False))
    name = F.when(F.col("variable") == "air_pressure_at_sea_level", F.lit("air_pressure_at_mean_sea_level"))
    for old, new in PRESSURE_NAMES.items():
        name = name.when(on & (F.col("variable") == old), F.lit(new))
    for (old, short), new in SURFACE_NAMES.items():
        name = name.when(~on & (F.col("variable") == old) & (F.col("var_name") == short), F.lit(new))
    return field.withColumn("variable", name.otherwise(F.col("variable")))


def strip_suffix(field: DataFrame) -> DataFrame:
    return field.withColumn("variable", F.regexp_replace("variable", r"_\d+$", ""))


def add_wind_speed(field: DataFrame, keys: list[str], u: str = "eastward_wind_at_10m", v: str = "northward_wind_at_10m", speed: str = "wind_speed_at_10m") -> DataFrame:
    """Wind speed as a variable more, for cells with both components and no speed yet: one aggregation, no self-join."""
    of = lambda name: F.max(F.when(F.col("variable") == name, F.col("value")))
    cells = field.where(F.col("variable").isin(u, v, speed)).groupBy(*keys).agg(of(u).alias("u"), of(v).alias("v"), F.max((F.col("variable") == speed).cast("int")).alias("has"))
    units = [F.lit(SPEED_UNITS).alias("units")] if "units" in field.columns else []
    new = cells.where("has = 0 AND u IS NOT NULL AND v IS NOT NULL").select(*keys, F.lit(speed).alias("variable"), wind_speed(F.col("u"), F.col("v")).alias("value"), *units)
    return field.unionByName(new, allowMissingColumns=True)


def wind_speed_only(field: DataFrame, keys: list[str], u: str = "eastward_wind_at_10m", v: str = "northward_wind_at_10m", speed: str = "wind_speed_at_10m") -> DataFrame:
    """As ``add_wind_speed``; where a model has nothing but the two components, only their speed is left of it."""
    others = Window.partitionBy("model_name")
    alone = (F.max((~F.col("variable").isin(u, v, speed)).cast("int")).over(others) == 0) & (F.max((F.col("__given") & (F.col("variable") == speed)).cast("int")).over(others) == 0)
    given = field.withColumn("__given", F.lit(True))
    both = add_wind_speed(given, keys, u, v, speed).withColumn("__given", F.coalesce("__given", F.lit(False)))
    return both.withColumn("__alone", alone).where(~F.col("__alone") | (F.col("variable") == speed)).drop("__given", "__alone")


def pole_angles(places: DataFrame, pole_lat: float, pole_lon: float) -> DataFrame:
    """(iy, ix, angle): radians that ``rotate_winds`` needs at ``places`` (iy, ix, lat, lon; true degrees) of a grid with that north pole.

    It is minus the bearing of the grid's pole, clockwise from north.
    """
    lat, turn, top = F.radians("lat"), F.radians(F.lit(pole_lon) - F.col("lon")), F.radians(F.lit(pole_lat))
    bearing = F.atan2(F.cos(top) * F.sin(turn), F.cos(lat) * F.sin(top) - F.sin(lat) * F.cos(top) * F.cos(turn))
    return places.select("iy", "ix", (-bearing).alias("angle"))


def true_north_winds(field: DataFrame, angles: DataFrame, keys: list[str]) -> DataFrame:
    """``field`` (keys with iy and ix, stash, value, ...) with the two GRID_WINDS turned to true north; other rows stay.

    Each cell's pair is brought together by one aggregation; a component without the other becomes null.
    """
    of = lambda code: F.max(F.when(F.col("stash") == code, F.col("value")))
    both = field.where(F.col("stash").isin(*GRID_WINDS)).groupBy(*keys).agg(*(of(c).alias(n) for c, n in zip(GRID_WINDS, ("u", "v"), strict=True)))
    turned = rotate_winds(both, angles).select(*keys, F.explode(F.create_map(F.lit(GRID_WINDS[0]), "u", F.lit(GRID_WINDS[1]), "v")).alias("stash", "__turned"))
    met = field.join(turned, [*keys, "stash"], "left")
    return met.withColumn("value", F.when(F.col("stash").isin(*GRID_WINDS), F.col("__turned")).otherwise(F.col("value"))).drop("__turned")


def rotate_winds(cells: DataFrame, angles: DataFrame) -> DataFrame:
    """u and v of ``cells`` (iy, ix, u, v) turned to true north by ``angles`` (iy, ix, angle in radians)."""
    c, s = F.cos("angle"), F.sin("angle")
    return cells.join(angles, ["iy", "ix"]).withColumns({"u": F.col("u") * c - F.col("v") * s, "v": F.col("u") * s + F.col("v") * c}).drop("angle")


def renumber_stations(observations: DataFrame) -> DataFrame:
    """Station numbers of each source (source_index) follow those of the sources before it: no two share one."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = observations.groupBy("source_index").agg(F.count_distinct("station").alias("n")).select("source_index", before.alias("__shift"))
    return observations.join(shift, "source_index").withColumn("station", F.col("station") + F.col("__shift")).drop("__shift")


def renumber_members(field: DataFrame) -> DataFrame:
    """Where sources clash (member 0 in more than one), it becomes the source's number, counted from 1."""
    clash = field.where("realization = 0").select("source_index").distinct().limit(2).count() > 1
    return field.withColumn("realization", F.when(F.col("realization") == 0, F.col("source_index") + 1).otherwise(F.col("realization"))) if clash else field


def coordinates_from_attributes(field: DataFrame) -> DataFrame:
    """y and x as the middle of the extent that the attributes give, where a field has none."""
    middle = lambda a: (F.col("attributes")[f"geospatial_{a}_min"].cast("double") + F.col("attributes")[f"geospatial_{a}_max"].cast("double")) / 2
    return field.withColumns({"y": F.coalesce("y", middle("lat")), "x": F.coalesce("x", middle("lon"))})


def equalise(fields: list[DataFrame]) -> list[DataFrame]:
    """``fields`` with the columns that all of them have, in the first one's order, and the attributes that do not differ.

    An attribute stays if every row of every field has it with the same value (nulls
    alike); one aggregation over all map entries tells which, when the result runs.
    """
    common = reduce(lambda a, b: [c for c in a if c in b], (f.columns for f in fields))
    fields = [f.select(*common) for f in fields]
    if "attributes" not in common:
        return fields
    maps = reduce(DataFrame.unionByName, (f.select("attributes") for f in fields))
    entries = maps.select(F.explode("attributes").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    rows = maps.agg(F.count("*")).scalar()
    kept = entries.where(F.col("n") == rows).agg(F.sort_array(F.collect_list("key"))).scalar()
    alike = lambda f: f.withColumn("__kept", kept).withColumn("attributes", F.map_filter("attributes", lambda k, v: F.array_contains("__kept", k))).drop("__kept")
    return [alike(f).select(*common) for f in fields]
