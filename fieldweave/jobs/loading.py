"""Queries of reading, writing and naming fields, of the remaining predicates, and of the remaining diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.functions import constraints, surface, units
from fieldweave.jobs import diagnostics
from fieldweave.jobs.base import Query
from fieldweave.operators import align, collapse, masks, regrid, vertical
from fieldweave.shared import fresh_path
from fieldweave.sources import adapters, ingest, io


def counted(df, keys, *more):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *more)


def several_sources(spark, sf_dir):
    """The same line items from a path and from a glob, with conditions that reach both scans."""
    paths = [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/line*.parquet"]
    read = io.read_fields(spark, paths, ["first", "second"], F.col("l_quantity") > 10, F.col("l_linenumber").between(2, 5))
    return counted(read, ["model_name", "is_base"], F.sum("l_quantity").alias("value"))


def unnamed_sources(spark, sf_dir):
    """Two tables of different columns; a column that one lacks is null there."""
    read = io.read_fields(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"])
    return counted(read, ["model_name", "is_base"], F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


def one_source(spark, sf_dir):
    read = io.read_fields(spark, [f"{sf_dir}/lineitem.parquet"], ["only"]).withColumn("variable", F.lit("quantity"))
    return counted(io.one_field(read), ["model_name", "variable"], F.avg("l_quantity").alias("value"))


def written_fields(spark, sf_dir):
    """The monthly fields written in parts of model and variable, and one part read back."""
    path = fresh_path(spark)
    io.write_field(adapters.field(spark, sf_dir), path)
    read = io.read_fields(spark, [path], ["again"], (F.col("model_name") == "N") & (F.col("variable") == "quantity"))
    return counted(read, ["model_name", "variable", "iy", "ix"], F.avg("value").alias("value"))


def surface_reports(spark, sf_dir):
    """Events as columns of text under a header, names quoted; read back as reports."""
    path = fresh_path(spark)
    stamp = [F.date_format("time", f).cast("int").alias(n) for f, n in (("yyyy", "YR"), ("MM", "MN"), ("dd", "DY"), ("HH", "HR"), ("mm", "MI"))]
    rows = adapters.observations(spark, sf_dir).select(*stamp, "station", F.concat(F.lit("type "), "variable").alias("name"), F.col("value").alias("TT"))
    rows.write.csv(path, sep=" ", header=True, quote="'")
    read = io.read_surface_reports(spark, path)
    return counted(read, ["name", F.date_trunc("day", "vld").alias("day")], F.avg("TT").alias("value"), F.max("vld").alias("latest"))


def point_reports(spark, sf_dir):
    path = fresh_path(spark)
    rows = adapters.observations(spark, sf_dir).select("variable", "station", "time", F.lit(None).cast("string").alias("quality"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    io.write_point_reports(rows, path)
    read = spark.read.csv(path, sep="\t", schema="variable string, station long, time string, quality string, value string")
    return counted(read, ["variable", F.substring("time", 1, 8).alias("day")], F.count_if(F.col("quality") == "NA").alias("no_quality"), F.count_if(F.col("value") == "NA").alias("no_value"), F.sum(F.try_to_number("value", F.lit("9999999.99")).cast("double")).alias("value"))


CODES = ("m01s21i104", "m01s04i201", "m01s03i225", "m01s03i226", "m01s03i236", "m01s16i222", "m01s05i216")
METHOD = "struct<method:string,coord:string,interval:string,comment:string>"


def described(spark, sf_dir):
    """Line items as fields with codes, attributes, cell methods, levels and coordinates."""
    n = F.col("l_linenumber").cast("int")
    code = F.element_at(F.array(*(F.lit(c) for c in CODES)), n)
    method = lambda m, interval: F.struct(F.lit(m).alias("method"), F.lit("time").alias("coord"), F.lit(interval).alias("interval"), F.lit(None).cast("string").alias("comment"))
    none = F.array().cast(f"array<{METHOD}>")
    methods = F.when(n % 3 == 0, none).when(n % 3 == 1, F.array(method("mean", "1 hour"))).otherwise(F.array(method("point", None), method("mean", "2 hour")))
    return adapters.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model_name"),
        n.alias("n"),
        code.alias("stash"),
        F.when(n == 1, "lightning").when(n == 2, "surface_microphysical_rainfall_amount").when(n == 3, "wind_speed_at_10m").when(n == 4, "eastward_wind_at_10m").otherwise("air_temperature").alias("variable"),
        F.when(n == 5, "air_temperature").alias("standard_name"),
        F.when(n == 6, "temp").alias("var_name"),
        F.create_map(F.lit("history"), F.lit("made"), F.lit("uuid"), F.lit("x"), F.lit("um_stash_source"), F.concat(F.lit("m01s03i236 and "), code), F.lit("flag"), F.col("l_returnflag"),
                     F.lit("geospatial_lat_min"), (F.col("l_suppkey") % 5).cast("string"), F.lit("geospatial_lat_max"), F.lit("10"), F.lit("geospatial_lon_min"), F.lit("-4"), F.lit("geospatial_lon_max"), (F.col("l_partkey") % 8).cast("string")).alias("attributes"),
        methods.alias("cell_methods"),
        F.when(n < 4, "air_pressure").when(n == 4, "Pressure_Level").otherwise("height").alias("level_type"),
        F.when(n < 3, "Pa").otherwise("hPa").alias("level_units"),
        (F.col("l_quantity") * 100).alias("level"),
        F.when(n > 5, F.lit(1.0)).alias("y"),
        F.lit(None).cast("double").alias("x"),
        F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("time"),
        (F.col("l_suppkey") % 5).cast("int").alias("iy"),
        (F.col("l_partkey") % 8).cast("int").alias("ix"),
        F.col("l_quantity").alias("value"),
        "l_tax",
    )


def kept_attributes(spark, sf_dir):
    rows = ingest.drop_file_attributes(described(spark, sf_dir))
    return counted(rows, [F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("names"), F.col("attributes")["um_stash_source"].alias("sources")])


def removed_attributes(spark, sf_dir):
    rows = io.rename(io.remove_attributes(described(spark, sf_dir), ["history", "uuid", "absent", "geospatial_lat_min", "geospatial_lat_max", "geospatial_lon_min", "geospatial_lon_max"]), "renamed")
    return counted(rows, ["variable", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("names"), F.col("attributes")["flag"].alias("flag")])


def constant_columns(spark, sf_dir):
    """Which columns are left of some, one of them constant and one without values."""
    rows = adapters.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(7).alias("seven"), F.lit(None).cast("int").alias("nothing"), F.when(F.col("l_linenumber") > 3, 1).alias("some"))
    left = io.remove_constant_columns(rows, ["seven", "nothing", "some", "l_quantity", "absent"])
    return left.agg(F.count("*").alias("n"), F.lit(",".join(left.columns)).alias("names"))


def pressure_levels(spark, sf_dir):
    return counted(ingest.pressure_levels(described(spark, sf_dir)), ["level_type", "level_units"], F.avg("level").alias("level"))


def accumulated_methods(spark, sf_dir):
    rows = ingest.accumulations(described(spark, sf_dir))
    return counted(rows, ["stash", F.array_join(F.transform("cell_methods", lambda m: F.concat_ws("/", m.getField("method"), m.getField("interval"))), ",").alias("methods")])


def attribute_coordinates(spark, sf_dir):
    return counted(ingest.coordinates_from_attributes(described(spark, sf_dir)), ["model_name"], F.avg("y").alias("y"), F.avg("x").alias("x"))


POLE = (37.5, 177.5)
TRUE = {"lat": "50 + iy * 0.7", "lon": "ix * 1.1 - 3"}


def true_winds(spark, sf_dir):
    """Winds along the axes of a rotated grid turned to true north, by angles from the grid's pole."""
    rows = described(spark, sf_dir).groupBy("model_name", "time", "iy", "ix", "stash").agg(F.avg("value").alias("value"))
    places = rows.select("iy", "ix").distinct().select("iy", "ix", *(F.expr(e).alias(n) for n, e in TRUE.items()))
    turned = ingest.true_north_winds(rows, ingest.pole_angles(places, *POLE), ["model_name", "time", "iy", "ix"])
    return counted(turned, ["model_name", "stash"], F.count("value").alias("present"), F.avg("value").alias("value"))


def wind_speeds_only(spark, sf_dir):
    """One model has the two components only, another also a temperature, the third a given speed."""
    kind = F.when(F.col("model_name") == "A", F.col("realization") % 2).when(F.col("model_name") == "N", F.col("realization") % 4).otherwise(F.col("realization") % 3).cast("int")
    names = F.array(*(F.lit(n) for n in ("eastward_wind_at_10m", "northward_wind_at_10m", "wind_speed_at_10m", "air_temperature")))
    variable = F.when((F.col("model_name") == "N") & (kind == 2), F.lit("air_temperature")).otherwise(F.element_at(names, kind + 1))
    cells = adapters.lines(spark, sf_dir).withColumn("variable", variable).groupBy("model_name", "time", "iy", "ix", "variable").agg(F.avg("value").alias("value")).withColumn("units", F.lit("given"))
    return counted(ingest.wind_speed_only(cells, ["model_name", "time", "iy", "ix"]), ["model_name", "variable", "units"], F.avg("value").alias("value"))


def more_selections(spark, sf_dir):
    """How many line items each predicate on names, codes, cell methods and attributes keeps."""
    c = constraints
    named = {
        "code": c.stash("m01s03i236"), "by_code": c.variable("m01s16i222"), "by_names": c.variable(["air_temperature", "temp"]), "wind": c.variable("wind_speed_at_10m"), "code_or_name": c.variable(["m01s05i216", "lightning"]),
        "mean": c.cell_methods(["mean"]), "mean_hourly": c.cell_methods(["mean"], interval="1 hour"), "both": c.cell_methods(["mean", "point"], coord="time"), "no_method": c.cell_methods([]), "lightning": c.cell_methods([], name="lightning"), "albedo": c.cell_methods([], name="albedo"),
        "flagged": c.attribute("flag", "A"), "has_uuid": c.attribute("uuid"), "absent": c.attribute("absent"), "combined": c.combine(c.stash("m01s03i236"), c.attribute("flag", "N"), c.not_level(0)),
    }
    return described(spark, sf_dir).agg(*(F.count_if(x).alias(n) for n, x in named.items())).unpivot([], list(named), "name", "n")


def selected_fields(spark, sf_dir):
    chosen = io.select_fields(described(spark, sf_dir), constraints.stash("m01s03i236"), constraints.variable("lightning"), constraints.attribute("flag", "R"))
    return counted(chosen, ["model_name", "variable"], F.avg("value").alias("value"))


def stacked_cases(spark, sf_dir):
    """The cases of each model from a table of its own, with a column that only one of them has."""
    cases = adapters.case_field(spark, sf_dir)
    tables = [cases.where(F.col("model_name") == m) for m in ("A", "N", "R")]
    stacked = collapse.stack_cases([tables[0].withColumn("extra", F.lit(1)), *tables[1:]])
    return counted(stacked, ["model_name", "forecast_reference_time"], F.count("extra").alias("extra"), F.avg("value").alias("value"))


def equalised(spark, sf_dir):
    """Tables of different columns cut to those they share."""
    rows = described(spark, sf_dir)
    tables = ingest.equalise([rows.select("model_name", "value", "n", "stash").where("n < 4"), rows.select("stash", "value", "model_name", "iy").where("n >= 4")])
    return counted(io.combine(*tables), ["model_name", "stash"], F.avg("value").alias("value"), F.lit(",".join(tables[1].columns)).alias("names"))


def equalised_attributes(spark, sf_dir):
    """Two tables whose rows agree on one attribute in three."""
    rows = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model_name"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("n"))
    attributes = F.create_map(F.lit("institution"), F.lit("centre"), F.lit("model"), F.col("model_name"), F.when(F.col("n") < 4, "grid").otherwise("domain"), F.lit("a"))
    rows = rows.withColumn("attributes", attributes)
    tables = ingest.equalise([rows.where("n < 4"), rows.where("n >= 4").drop("n")])
    shown = F.concat_ws(",", F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return io.combine(*tables).groupBy("model_name", shown.alias("kept")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


PRESENT = ("thick_fog", "aviation_fog", "frost", "snow", "lightning")


def more_presence(spark, sf_dir):
    cells = adapters.field(spark, sf_dir).withColumn("value", (F.col("value") - 25) / 5)
    warm = adapters.field(spark, sf_dir).withColumn("value", F.col("value") + 248)
    found = diagnostics.domain_fraction(cells, ["model_name", "time"], [n for n in PRESENT if n != "frost"])
    return found.join(diagnostics.domain_fraction(warm, ["model_name", "time"], ["frost"]), ["model_name", "time"])


def named_winds(spark, sf_dir):
    speed = F.col("value")
    return adapters.lines(spark, sf_dir).groupBy("model_name", "time").agg(*(F.avg(diagnostics.wind_presence(speed, n)).alias(n) for n in diagnostics.WINDS))


def converted_fields(spark, sf_dir):
    """Temperatures in two units, rain depths in three and latent heat to one unit each."""
    n = F.col("l_linenumber")
    rows = adapters.table(spark, sf_dir, "lineitem")
    warm = units.convert_units(rows.select("l_returnflag", F.when(n < 4, "K").otherwise("Fahrenheit").alias("units"), F.col("l_quantity").alias("value")), "Celsius").withColumn("kind", F.lit("temperature"))
    deep = units.convert_units(rows.select("l_returnflag", F.when(n < 3, "cm").when(n < 5, "kg m-2").otherwise("mm").alias("units"), F.col("l_quantity").alias("value")), "mm").withColumn("kind", F.lit("depth"))
    flux = rows.select("l_returnflag", F.when(n < 3, "kg m-2 s-1").otherwise("W m-2").alias("units"), F.col("l_tax").alias("value"))
    heat = flux.select("l_returnflag", surface.latent_heat_unit(F.col("units")).alias("units"), surface.latent_heat(F.col("value"), F.col("units")).alias("value"), F.lit("heat").alias("kind"))
    return counted(io.combine(warm, deep, heat), ["kind", "l_returnflag", "units"], F.avg("value").alias("value"))


def sums_and_differences(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    static = field.groupBy("iy", "ix").agg(F.avg("value").alias("value")).withColumn("variable", F.lit("mean"))
    cell = ["time", "iy", "ix"]
    both = [align.arithmetic(field, static, cell, o).withColumn("operation", F.lit(o)) for o in ("add", "subtract")]
    return io.combine(*both).select("operation", "model_name", *cell, "value")


def generated_masks(spark, sf_dir):
    return counted(masks.generate_mask(adapters.field(spark, sf_dir), "ge", 25.0), ["model_name", "variable", "units"], F.sum("value").alias("value"))


def axis(spark, n, step, start=0.0):
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (start + F.col("id") * step).alias("c"))


def regridded_differences(spark, sf_dir):
    """The base's fields lie on a grid of other spacing, and go onto the others' grid first."""
    field = adapters.field(spark, sf_dir)
    mine, theirs = (axis(spark, 5, 10.0), axis(spark, 8, 10.0)), (axis(spark, 5, 8.0, 2.0), axis(spark, 8, 9.0, 1.0))
    return align.regridded_difference(field, mine, theirs, ["time"])


GRID = ((-3.0, 2.0), (-4.0, 2.0))


def rotated_axes(spark):
    return axis(spark, 5, GRID[0][1], GRID[0][0]), axis(spark, 8, GRID[1][1], GRID[1][0])


def true_stations(spark, sf_dir):
    """Field values at suppliers' places, in true degrees, of a grid with its pole elsewhere."""
    stations = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), (49 + F.col("s_suppkey") % 9).cast("double").alias("y"), (-12 + F.col("s_suppkey") % 23).cast("double").alias("x"))
    return regrid.interpolate_to_stations(adapters.field(spark, sf_dir), rotated_axes(spark), stations, ["model_name", "time"], POLE).groupBy("model_name", "station").agg(F.count("value").alias("n"), F.avg("value").alias("value"))


def true_point(spark, sf_dir):
    return regrid.single_point(adapters.field(spark, sf_dir), rotated_axes(spark), 52.0, 1.0, ["model_name", "time"], margin=1, pole=POLE)


def spaced_transect(spark, sf_dir):
    """As many points as the length holds of the grid's spacing."""
    return regrid.transect(adapters.field(spark, sf_dir), (axis(spark, 5, 10.0), axis(spark, 8, 10.0)), (0.0, 4.0), (40.0, 66.0), None, ["model_name", "time"])


def rainfall_rates(spark, sf_dir):
    """Monthly depths in each cell as rates per second, whichever unit of depth they came in."""
    field = adapters.field(spark, sf_dir).withColumns({"units": F.when(F.col("is_base"), F.lit("cm")).otherwise(F.lit("mm")), "variable": F.lit("surface_microphysical_rainfall_amount")})
    return counted(vertical.rainfall_to_rate(field, ["model_name", "iy", "ix"]), ["model_name", "iy", "ix", "units"], F.avg("value").alias("value"))


LINES = "l AS (SELECT l_returnflag AS model_name, l_linenumber AS n, l_quantity AS q, l_suppkey % 5 AS iy, l_partkey % 8 AS ix, l_tax, " + f"{list(CODES)}[l_linenumber] AS stash, " + """
CASE l_linenumber WHEN 1 THEN 'lightning' WHEN 2 THEN 'surface_microphysical_rainfall_amount' WHEN 3 THEN 'wind_speed_at_10m' WHEN 4 THEN 'eastward_wind_at_10m' ELSE 'air_temperature' END AS variable,
date_trunc('month', l_shipdate)::TIMESTAMP AS time FROM lineitem)"""
BOUNDS = "geospatial_lat_max,geospatial_lat_min,geospatial_lon_max,geospatial_lon_min"
#: Latitude and longitude of (lat, lon) on the grid of POLE.
TURN = """degrees(asin(sin(radians(52.5)) * cos(radians({0})) * cos(radians({1} - 177.5)) + cos(radians(52.5)) * sin(radians({0})))) AS gy,
degrees(atan2(-cos(radians({0})) * sin(radians({1} - 177.5)), -(cos(radians(52.5)) * cos(radians({0})) * cos(radians({1} - 177.5)) - sin(radians(52.5)) * sin(radians({0}))))) AS gx"""
NEAR = "CASE WHEN least(greatest(floor(({0} - {1}) / 2), 0), {2}) = {3} THEN 1 - (({0} - {1}) / 2 - {3}) WHEN least(greatest(floor(({0} - {1}) / 2), 0), {2}) = {3} - 1 THEN ({0} - {1}) / 2 - {3} + 1 END"

QUERIES = [
    Query(
        "several_sources",
        "model_name:s is_base:b n:l value:r",
        several_sources,
        "",
        "SELECT m AS model_name, m = 'first' AS is_base, count(*) AS n, sum(l_quantity) AS value FROM lineitem, (VALUES ('first'), ('second')) AS v(m) WHERE l_quantity > 10 AND l_linenumber BETWEEN 2 AND 5 GROUP BY ALL",
    ),
    Query(
        "unnamed_sources",
        "model_name:s is_base:b n:l customers:l suppliers:l",
        unnamed_sources,
        "",
        "SELECT 'model 1' AS model_name, true AS is_base, count(*) AS n, count(*) AS customers, 0 AS suppliers FROM customer UNION ALL SELECT 'model 2', false, count(*), 0, count(*) FROM supplier",
    ),
    Query("one_source", "model_name:s variable:s n:l value:r", one_source, "", "SELECT 'only' AS model_name, 'quantity' AS variable, count(*) AS n, avg(l_quantity) AS value FROM lineitem"),
    Query(
        "written_fields",
        "model_name:s variable:s iy:i ix:i n:l value:r",
        written_fields,
        "field",
        "SELECT 'again' AS model_name, 'quantity' AS variable, iy, ix, count(*) AS n, avg(value) AS value FROM field WHERE model_name = 'N' GROUP BY ALL",
    ),
    Query(
        "surface_reports",
        "name:s day:t n:l value:r latest:t",
        surface_reports,
        "obs",
        "SELECT 'type ' || variable AS name, date_trunc('day', time)::TIMESTAMP AS day, count(*) AS n, avg(value + 273.15) AS value, max(date_trunc('minute', time)) AS latest FROM obs GROUP BY ALL",
    ),
    Query(
        "point_reports",
        "variable:s day:s n:l no_quality:l no_value:l value:r",
        point_reports,
        "obs",
        "SELECT variable, strftime(time, '%Y%m%d') AS day, count(*) AS n, count(*) AS no_quality, count(*) FILTER (value <= 50) AS no_value, sum(value) FILTER (value > 50) AS value FROM obs GROUP BY ALL",
    ),
    Query(
        "kept_attributes",
        "names:s sources:s n:l",
        kept_attributes,
        "",
        f"WITH {LINES}\nFINAL\nSELECT 'flag,{BOUNDS},um_stash_source' AS names, least(stash, 'm01s03i236') || ',' || greatest(stash, 'm01s03i236') AS sources, count(*) AS n FROM l GROUP BY ALL",
    ),
    Query(
        "removed_attributes", "variable:s names:s flag:s n:l", removed_attributes, "", "SELECT 'renamed' AS variable, 'flag,um_stash_source' AS names, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL"
    ),
    Query("constant_columns", "n:l names:s", constant_columns, "", "SELECT count(*) AS n, 'l_returnflag,l_quantity,some' AS names FROM lineitem"),
    Query(
        "pressure_levels",
        "level_type:s level_units:s n:l level:r",
        pressure_levels,
        "",
        f"""WITH {LINES}
FINAL
SELECT CASE WHEN n < 5 THEN 'pressure' ELSE 'height' END AS level_type, 'hPa' AS level_units, count(*) AS n, avg(CASE WHEN n < 3 THEN q ELSE q * 100 END) AS level FROM l GROUP BY ALL""",
    ),
    Query(
        "accumulated_methods",
        "stash:s methods:s n:l",
        accumulated_methods,
        "",
        f"""WITH {LINES}, m AS (SELECT stash, n, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN n = 1 THEN 'sum/1 hour' ELSE 'mean/1 hour' END ELSE 'point,mean/2 hour' END AS methods FROM l)
FINAL
SELECT stash, methods, count(*) AS n FROM m GROUP BY ALL""",
    ),
    Query(
        "attribute_coordinates",
        "model_name:s n:l y:r x:r",
        attribute_coordinates,
        "",
        f"WITH {LINES}\nFINAL\nSELECT model_name, count(*) AS n, avg(CASE WHEN n > 5 THEN 1 ELSE (iy + 10) / 2.0 END) AS y, avg((ix - 4) / 2.0) AS x FROM l GROUP BY ALL",
    ),
    Query(
        "true_winds",
        "model_name:s stash:s n:l present:l value:r",
        true_winds,
        "",
        f"""WITH {LINES}, c AS (SELECT model_name, time, iy, ix, stash, avg(q) AS value FROM l GROUP BY ALL), p AS (SELECT *, radians({TRUE['lat']}) AS la, radians(177.5 - ({TRUE['lon']})) AS tu FROM c),
        a AS (SELECT *, atan2(cos(radians(37.5)) * sin(tu), cos(la) * sin(radians(37.5)) - sin(la) * cos(radians(37.5)) * cos(tu)) AS b FROM p),
        w AS (SELECT model_name, stash, CASE stash WHEN 'm01s03i225' THEN value * cos(b) + sin(b) * max(value) FILTER (stash = 'm01s03i226') OVER k
          WHEN 'm01s03i226' THEN value * cos(b) - sin(b) * max(value) FILTER (stash = 'm01s03i225') OVER k ELSE value END AS value FROM a WINDOW k AS (PARTITION BY model_name, time, iy, ix))
FINAL
SELECT model_name, stash, count(*) AS n, count(value) AS present, avg(value) AS value FROM w GROUP BY ALL""",
    ),
    Query(
        "wind_speeds_only",
        "model_name:s variable:s units:s n:l value:r",
        wind_speeds_only,
        "ln",
        """WITH k AS (SELECT *, CASE model_name WHEN 'A' THEN realization % 2 WHEN 'N' THEN realization % 4 ELSE realization % 3 END AS kind FROM ln),
        v AS (SELECT model_name, time, iy, ix, value, CASE WHEN kind = 0 THEN 'eastward_wind_at_10m' WHEN kind = 1 THEN 'northward_wind_at_10m' WHEN kind = 3 OR model_name = 'N' THEN 'air_temperature' ELSE 'wind_speed_at_10m' END AS variable FROM k),
        c AS (SELECT model_name, time, iy, ix, variable, avg(value) AS value FROM v GROUP BY ALL),
        s AS (SELECT model_name, time, iy, ix, max(value) FILTER (variable = 'eastward_wind_at_10m') AS u, max(value) FILTER (variable = 'northward_wind_at_10m') AS v, count(*) FILTER (variable = 'wind_speed_at_10m') AS has FROM c GROUP BY ALL),
        a AS (SELECT model_name, variable, 'given' AS units, value FROM c WHERE model_name <> 'A' UNION ALL SELECT model_name, 'wind_speed_at_10m', 'm s-1', sqrt(u * u + v * v) FROM s WHERE has = 0 AND u IS NOT NULL AND v IS NOT NULL)
FINAL
SELECT model_name, variable, units, count(*) AS n, avg(value) AS value FROM a GROUP BY ALL""",
    ),
    Query(
        "more_selections",
        "name:s n:l",
        more_selections,
        "",
        f"""WITH {LINES}
FINAL
SELECT name, count(*) FILTER (keeps) AS n FROM (SELECT unnest([
  {{'name': 'code', 'keeps': n = 5}}, {{'name': 'by_code', 'keeps': n = 6}}, {{'name': 'by_names', 'keeps': n > 4}}, {{'name': 'wind', 'keeps': n IN (3, 4)}}, {{'name': 'code_or_name', 'keeps': n IN (1, 7)}},
  {{'name': 'mean', 'keeps': n % 3 > 0}}, {{'name': 'mean_hourly', 'keeps': n % 3 = 1}}, {{'name': 'both', 'keeps': n % 3 = 2}}, {{'name': 'no_method', 'keeps': n % 3 = 0}}, {{'name': 'lightning', 'keeps': false}}, {{'name': 'albedo', 'keeps': n % 3 = 1}},
  {{'name': 'flagged', 'keeps': model_name = 'A'}}, {{'name': 'has_uuid', 'keeps': true}}, {{'name': 'absent', 'keeps': false}}, {{'name': 'combined', 'keeps': n = 5 AND model_name = 'N' AND q <> 0}}], recursive := true) FROM l) GROUP BY ALL""",
    ),
    Query(
        "selected_fields",
        "model_name:s variable:s n:l value:r",
        selected_fields,
        "",
        f"WITH {LINES}\nFINAL\nSELECT model_name, variable, count(*) AS n, avg(q) AS value FROM l WHERE n IN (1, 5) OR model_name = 'R' GROUP BY ALL",
    ),
    Query(
        "stacked_cases",
        "model_name:s forecast_reference_time:t n:l extra:l value:r",
        stacked_cases,
        "cases",
        "SELECT model_name, frt AS forecast_reference_time, count(*) AS n, count(*) FILTER (model_name = 'A') AS extra, avg(value) AS value FROM cases GROUP BY ALL",
    ),
    Query("equalised", "model_name:s stash:s n:l value:r names:s", equalised, "", f"WITH {LINES}\nFINAL\nSELECT model_name, stash, count(*) AS n, avg(q) AS value, 'model_name,value,stash' AS names FROM l GROUP BY ALL"),
    Query("equalised_attributes", "model_name:s kept:s n:l value:r", equalised_attributes, "", "SELECT l_returnflag AS model_name, 'institution=centre' AS kept, count(*) AS n, avg(l_quantity) AS value FROM lineitem GROUP BY ALL"),
    Query(
        "more_presence",
        "model_name:s time:t " + " ".join(f"{n}:r" for n in PRESENT),
        more_presence,
        "field",
        """SELECT model_name, time, avg((v <= 0.1)::INT) AS thick_fog, avg((v < 1)::INT) AS aviation_fog, avg((value + 248 < 273.15)::INT) AS frost, avg((v > 0)::INT) AS snow, avg((v > 0)::INT) AS lightning
        FROM (SELECT *, (value - 25) / 5 AS v FROM field) GROUP BY ALL""",
    ),
    Query(
        "named_winds",
        "model_name:s time:t gale:r storm:r hurricane:r",
        named_winds,
        "ln",
        "SELECT model_name, time, avg((f >= 8)::INT) AS gale, avg((f >= 10)::INT) AS storm, avg((f >= 12)::INT) AS hurricane FROM (SELECT *, round_even(pow(value / 0.836, 2 / 3::DOUBLE), 0) AS f FROM ln) GROUP BY ALL",
    ),
    Query(
        "converted_fields",
        "kind:s l_returnflag:s units:s n:l value:r",
        converted_fields,
        "",
        """SELECT 'temperature' AS kind, l_returnflag, 'Celsius' AS units, count(*) AS n, avg(CASE WHEN l_linenumber < 4 THEN l_quantity - 273.15 ELSE (l_quantity - 32) * 5 / 9 END) AS value FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'depth', l_returnflag, 'mm', count(*), avg(CASE WHEN l_linenumber < 3 THEN 10 * l_quantity ELSE l_quantity END) FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'heat', l_returnflag, 'W m-2', count(*), avg(CASE WHEN l_linenumber < 3 THEN 2.501e6 * l_tax ELSE l_tax END) FROM lineitem GROUP BY ALL""",
    ),
    Query(
        "sums_and_differences",
        "operation:s model_name:s time:t iy:i ix:i value:r",
        sums_and_differences,
        "field",
        """SELECT o AS operation, model_name, time, iy, ix, CASE WHEN o = 'add' THEN value + m ELSE value - m END AS value FROM field JOIN (SELECT iy, ix, avg(value) AS m FROM field GROUP BY ALL) USING (iy, ix), (VALUES ('add'), ('subtract')) AS v(o)""",
    ),
    Query(
        "generated_masks",
        "model_name:s variable:s units:s n:l value:r",
        generated_masks,
        "field",
        "SELECT model_name, 'mask_for_quantity_ge_25' AS variable, '1' AS units, count(*) AS n, sum((value >= 25)::INT) AS value FROM field GROUP BY ALL",
    ),
    Query(
        "regridded_differences",
        "model_name:s variable:s time:t iy:i ix:i value:r",
        regridded_differences,
        "field",
        """WITH y AS (SELECT range AS t, least(floor((2 + 8 * range) / 10), 3) AS k, (2 + 8 * range) / 10 - least(floor((2 + 8 * range) / 10), 3) AS f FROM range(5)),
        x AS (SELECT range AS t, least(floor((1 + 9 * range) / 10), 6) AS k, (1 + 9 * range) / 10 - least(floor((1 + 9 * range) / 10), 6) AS f FROM range(8)),
        wy AS (SELECT t, k AS s, 1 - f AS w FROM y UNION ALL SELECT t, k + 1, f FROM y), wx AS (SELECT t, k AS s, 1 - f AS w FROM x UNION ALL SELECT t, k + 1, f FROM x),
        b AS (SELECT time, wy.t AS iy, wx.t AS ix, sum(value * wy.w * wx.w) AS value, count(*) AS n FROM field JOIN wy ON wy.s = iy AND abs(wy.w) > 0 JOIN wx ON wx.s = ix AND abs(wx.w) > 0 WHERE is_base GROUP BY ALL),
        need AS (SELECT wy.t AS iy, wx.t AS ix, count(*) AS n FROM wy, wx WHERE wy.w <> 0 AND wx.w <> 0 GROUP BY ALL)
FINAL
SELECT model_name, 'quantity' AS variable, time, iy, ix, f.value - CASE WHEN b.n = need.n THEN b.value END AS value FROM field f JOIN b USING (time, iy, ix) JOIN need USING (iy, ix) WHERE NOT is_base""",
    ),
    Query(
        "true_stations",
        "model_name:s station:l n:l value:r",
        true_stations,
        "field",
        f"""WITH s AS (SELECT s_suppkey AS station, (49 + s_suppkey % 9)::DOUBLE AS y, (-12 + s_suppkey % 23)::DOUBLE AS x FROM supplier), g AS (SELECT station, {TURN.format('y', 'x')} FROM s),
        i AS (SELECT * FROM g WHERE gy BETWEEN -3 AND 5 AND gx BETWEEN -4 AND 10),
        w AS (SELECT station, model_name, time, value, {NEAR.format('gy', '-3', 3, 'iy')} AS wy, {NEAR.format('gx', '-4', 6, 'ix')} AS wx FROM i, field),
        v AS (SELECT station, model_name, time, CASE WHEN count(*) = 4 THEN sum(wy * wx * value) END AS value FROM w WHERE wy IS NOT NULL AND wx IS NOT NULL GROUP BY ALL)
FINAL
SELECT model_name, station, count(value) AS n, avg(value) AS value FROM v GROUP BY ALL""",
    ),
    Query(
        "true_point",
        "model_name:s time:t value:r near_edge:b",
        true_point,
        "field",
        f"""WITH g AS (SELECT {TURN.format('52.0', '1.0')}), w AS (SELECT model_name, time, value, {NEAR.format('gy', '-3', 3, 'iy')} AS wy, {NEAR.format('gx', '-4', 6, 'ix')} AS wx, NOT (gy BETWEEN -1 AND 3 AND gx BETWEEN -2 AND 8) AS near_edge FROM g, field)
FINAL
SELECT model_name, time, CASE WHEN count(*) = 4 THEN sum(wy * wx * value) END AS value, near_edge FROM w WHERE wy IS NOT NULL AND wx IS NOT NULL GROUP BY ALL""",
    ),
    Query(
        "spaced_transect",
        "model_name:s time:t point:i place:r value:r",
        spaced_transect,
        "field",
        """WITH l AS (SELECT range AS point, ceil(range * 40 / 6 / 10.0 - 0.5)::INT AS iy, ceil((4 + range * 62 / 6.0) / 10 - 0.5)::INT AS ix, 4 + range * 62 / 6.0 AS place FROM range(7))
FINAL
SELECT model_name, time, point, place, value FROM field JOIN l USING (iy, ix)""",
    ),
    Query(
        "rainfall_rates",
        "model_name:s iy:i ix:i units:s n:l value:p",
        rainfall_rates,
        "field",
        """WITH r AS (SELECT model_name, iy, ix, CASE WHEN is_base THEN 10 ELSE 1 END * value / coalesce(epoch(lead(time) OVER w) - epoch(time), epoch(time) - epoch(lag(time) OVER w)) AS value FROM field WINDOW w AS (PARTITION BY model_name, iy, ix ORDER BY time))
FINAL
SELECT model_name, iy, ix, 'kg m-2 s-1' AS units, count(*) AS n, avg(value) AS value FROM r GROUP BY ALL""",
    ),
]
