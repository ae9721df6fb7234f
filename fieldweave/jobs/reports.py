"""Queries of the ingest projections and of observation reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fieldweave.jobs.base import Query
from fieldweave.operators import observations
from fieldweave.sources import adapters, ingest

RADIATION = "m01s01i235"


def raw_fields(spark, sf_dir):
    """Line items as raw fields with STASH codes, attributes and cell methods."""
    n = F.col("l_linenumber")
    return adapters.table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_returnflag").alias("model_name"),
        F.when(n == 1, "visibility_in_air").when(n == 2, "surface_microphysical_rainfall_rate").when(n == 3, "surface_microphysical_amount").when(n == 4, "cloud_base_altitude").when(n == 5, "x_wind").when(n == 6, "air_temperature_0").otherwise("air_pressure_at_sea_level").alias("variable"),
        F.when(n == 1, "m").when(n == 2, "kg m-2 s-1").when(n == 3, "kg m-2").otherwise("1").alias("units"),
        F.when(n == 4, F.col("l_quantity") * 6).otherwise(F.col("l_quantity")).alias("value"),
        F.when(n == 5, "pressure").alias("level_type"),
        F.lit(None).cast("string").alias("var_name"),
        F.when(n > 3, n).alias("realization"),
        F.lit(RADIATION).alias("stash"),
        F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("forecast_reference_time"),
        F.lit(None).cast("double").alias("forecast_period"),
        F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))) + 60 * F.lit(47) + 12).alias("time"),
    )


def normalised(spark, sf_dir):
    rows = raw_fields(spark, sf_dir)
    for step in (ingest.default_realization, ingest.clean, ingest.microphysics_units, ingest.mask_cloud_base, ingest.long_names, ingest.strip_suffix, ingest.dummy_time, ingest.lead_times):
        rows = rows.transform(step)
    return rows.groupBy("model_name", "variable", "units", "realization").agg(F.count("value").alias("n"), F.avg("value").alias("value"), F.avg("forecast_period").alias("forecast_period"))


def radiation_times(spark, sf_dir):
    rows = raw_fields(spark, sf_dir).transform(ingest.lead_times).transform(ingest.radiation_times)
    return rows.groupBy("model_name", "time").agg(F.count("*").alias("n"), F.avg("forecast_period").alias("forecast_period"))


def wind_speeds(spark, sf_dir):
    """All members stand for the two components, and in row 0 for a given speed too."""
    keys = ["model_name", "time", "iy", "ix"]
    kind = F.when(F.col("iy") == 0, F.col("realization") % 3).otherwise(F.col("realization") % 2).cast("int")
    names = F.array(F.lit("eastward_wind_at_10m"), F.lit("northward_wind_at_10m"), F.lit("wind_speed_at_10m"))
    named = adapters.lines(spark, sf_dir).withColumn("variable", F.element_at(names, kind + 1)).groupBy(*keys, "variable").agg(F.avg("value").alias("value"))
    return ingest.add_wind_speed(named, keys).groupBy("model_name", "time", "variable").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def renumbered_stations(spark, sf_dir):
    sources = adapters.observations(spark, sf_dir).withColumn("source_index", F.ascii("variable"))
    return ingest.renumber_stations(sources).groupBy("variable").agg(F.min("station").alias("first"), F.max("station").alias("last"))


def renumbered_members(spark, sf_dir):
    sources = adapters.member_field(spark, sf_dir).withColumn("source_index", F.ascii("model_name") - 65)
    return ingest.renumber_members(sources).groupBy("model_name", "realization").agg(F.count("*").alias("n"))


def wrapped_longitudes(spark, sf_dir):
    axes = adapters.table(spark, sf_dir, "supplier").select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("model_name"), F.col("s_suppkey").alias("ix"), (F.col("s_suppkey") % 3 * 300 - 250 + F.col("s_suppkey") * 0.1).alias("x"))
    return ingest.wrap_longitude(axes)


def named_by_stash(spark, sf_dir):
    names = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stash"), F.col("n_name").alias("name")).where("stash < 15")
    rows = adapters.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stash"), F.concat(F.lit("code_"), F.col("s_nationkey")).alias("variable"))
    return ingest.name_from_stash(rows, names).groupBy("variable").agg(F.count("*").alias("n"))


def matched_observations(spark, sf_dir):
    obs = adapters.observations(spark, sf_dir)
    forecasts = obs.where("variable = 'view'").groupBy(F.col("station"), F.date_trunc("hour", "time").alias("time")).agg(F.avg("value").alias("value"))
    pairs = observations.match_window(forecasts, obs.where("variable <> 'view'"), ["station"])
    return pairs.groupBy("station").agg(F.count("*").alias("n"), F.avg(F.col("forecast") - F.col("observed")).alias("value"))


def nearest_observations(spark, sf_dir):
    """Hourly views and clicks a cell as forecasts; other events are observed at places, some outside the grid."""
    obs = adapters.observations(spark, sf_dir)
    cells = [(F.col("station") % n).cast("int").alias(c) for c, n in (("iy", 5), ("ix", 8))]
    forecasts = obs.where("variable IN ('view', 'click')").groupBy(F.col("variable").alias("model_name"), F.date_trunc("hour", "time").alias("time"), *cells).agg(F.avg("value").alias("value"))
    placed = obs.where("variable NOT IN ('view', 'click')").withColumns({"y": (F.col("station") * 7.3) % 45 - 2, "x": (F.col("station") * 3.7) % 80 - 4})
    axes = tuple(spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") * 10.0).alias("c")) for n in (5, 8))
    met = observations.match_nearest(forecasts, placed, axes, ["model_name"])
    return met.groupBy("model_name", "station", "iy", "ix").agg(F.count("*").alias("n"), F.avg(F.col("forecast") - F.col("observed")).alias("value"), F.min("valid").alias("first"))


FIRST, LAST = datetime(2024, 1, 1, 12, tzinfo=timezone.utc), datetime(2024, 2, 5, tzinfo=timezone.utc)


def pseudo_forecasts(spark, sf_dir):
    found = observations.pseudo_forecasts(adapters.observations(spark, sf_dir), FIRST, LAST, 18, 48)
    return found.groupBy("variable", "forecast_reference_time").agg(F.count("*").alias("n"), F.avg("forecast_period").alias("forecast_period"), F.avg("value").alias("value"))


def enriched_reports(spark, sf_dir):
    reports = adapters.table(spark, sf_dir, "lineitem").select(
        ((F.col("l_linenumber") % 3)).alias("report_status"), (F.col("l_suppkey") % 2).cast("int").alias("datum_status"), (F.col("l_suppkey") % 30).cast("int").alias("varno"), F.col("l_returnflag").alias("reportype"), F.col("l_quantity").alias("obsvalue")
    )
    variables = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("varno"), F.col("n_name").alias("name"))
    types = spark.sql("SELECT * FROM VALUES ('A', 'AIREP'), ('N', 'Land Surface') AS t(reportype, bufrtype)")
    found = observations.enrich(reports, variables, types).withColumn("type", observations.message_type(F.col("bufrtype"), F.col("reportype")))
    return found.groupBy("name", "type").agg(F.count("*").alias("n"), F.avg("obsvalue").alias("value"))


def last_reports(spark, sf_dir):
    obs = adapters.observations(spark, sf_dir).select("station", "variable", F.date_trunc("day", "time").alias("vld"), "value", "event_id")
    return observations.keep_last(obs, ["station", "variable", "vld"], "event_id")


def long_reports(spark, sf_dir):
    wide = adapters.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sid"), F.col("l_shipdate").cast("timestamp").alias("vld"), F.when(F.col("l_linenumber") == 7, -99.0).otherwise(F.col("l_partkey") % 100.0).alias("elv"), F.col("l_quantity").alias("TT"), F.when(F.col("l_tax") < 0.02, -99.0).otherwise(F.col("l_tax")).alias("RH")
    )
    long = observations.to_long(wide, ["sid", "vld", "elv"], {"TT": "TMP", "RH": "RH", "FF": "WIND"}, "1996-01-01 00:00:00", "1997-01-01 00:00:00")
    return long.groupBy("sid", "var").agg(F.count("*").alias("n"), F.avg("obs").alias("value"))


def coded_reports(spark, sf_dir):
    n = F.col("l_linenumber")
    reports = adapters.table(spark, sf_dir, "lineitem").select(
        F.when(n == 1, "AIREP").when(n == 2, "Land Surface").otherwise("other").alias("bufrtype"),
        n.alias("reportype"),
        F.when(n == 3, "  ").otherwise(F.col("l_returnflag")).alias("statid"),
        F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("date"),
        (n * 10000 + 305).alias("time"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("stalt"),
        F.lit("TMP").alias("name"),
        F.when(n < 4, 1).when(n < 6, 5).otherwise(11).alias("vertco_type"),
        F.when(n == 4, 1.0).otherwise(F.col("l_quantity")).alias("vertco_reference_1"),
        F.col("l_quantity").alias("obsvalue"),
    )
    coded = observations.code_reports(reports)
    return coded.groupBy("Message_Type", "Station_ID", F.date_trunc("month", "Valid_Time").alias("month")).agg(F.count("*").alias("n"), F.count("Level").alias("n_level"), F.avg("Level").alias("level"), F.count("Height").alias("n_height"), F.max("Valid_Time").alias("latest"))


RAW = """raw AS (SELECT l_returnflag AS model_name, l_linenumber AS n, l_quantity AS q, date_trunc('month', l_shipdate)::TIMESTAMP AS frt, date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 47 MINUTE + INTERVAL 12 SECOND AS time FROM lineitem)"""
QUERIES = [
    Query(
        "normalised_fields",
        "model_name:s variable:s units:s realization:i n:l value:r forecast_period:r",
        normalised,
        "",
        f"""WITH {RAW}, r AS (SELECT model_name, CASE n WHEN 1 THEN 'visibility_in_air' WHEN 2 THEN 'surface_microphysical_rainfall_rate' WHEN 3 THEN 'surface_microphysical_amount' WHEN 4 THEN 'cloud_base_altitude'
          WHEN 5 THEN 'zonal_wind_at_pressure_levels' WHEN 6 THEN 'air_temperature' ELSE 'air_pressure_at_mean_sea_level' END AS variable, CASE n WHEN 1 THEN 'km' WHEN 2 THEN 'mm hr-1' WHEN 3 THEN 'mm' ELSE '1' END AS units,
          CASE WHEN n > 3 THEN n ELSE 0 END AS realization, CASE n WHEN 1 THEN q / 1000 WHEN 2 THEN q * 3600 WHEN 4 THEN CASE WHEN q * 6 <= 144 THEN q * 6 END ELSE q END AS value, epoch(time - frt) / 3600 AS forecast_period FROM raw)
FINAL
SELECT model_name, variable, units, realization, count(value) AS n, avg(value) AS value, avg(forecast_period) AS forecast_period FROM r GROUP BY ALL""",
    ),
    Query(
        "radiation_times",
        "model_name:s time:t n:l forecast_period:r",
        radiation_times,
        "",
        f"WITH {RAW}\nFINAL\nSELECT model_name, time + INTERVAL 13 MINUTE - INTERVAL 12 SECOND AS time, count(*) AS n, avg(epoch(time + INTERVAL 13 MINUTE - INTERVAL 12 SECOND - frt) / 3600) AS forecast_period FROM raw GROUP BY ALL",
    ),
    Query(
        "wind_speeds",
        "model_name:s time:t variable:s n:l value:r",
        wind_speeds,
        "ln",
        """WITH k AS (SELECT *, CASE WHEN iy = 0 THEN realization % 3 ELSE realization % 2 END AS kind FROM ln),
        c AS (SELECT model_name, time, iy, ix, avg(value) FILTER (kind = 0) AS u, avg(value) FILTER (kind = 1) AS v, avg(value) FILTER (kind = 2) AS s FROM k GROUP BY ALL),
        a AS (SELECT model_name, time, 'eastward_wind_at_10m' AS variable, u AS value FROM c UNION ALL SELECT model_name, time, 'northward_wind_at_10m', v FROM c UNION ALL SELECT model_name, time, 'wind_speed_at_10m', coalesce(s, sqrt(u * u + v * v)) FROM c)
FINAL
SELECT model_name, time, variable, count(*) AS n, avg(value) AS value FROM a WHERE value IS NOT NULL GROUP BY ALL""",
    ),
    Query(
        "renumbered_stations",
        "variable:s first:l last:l",
        renumbered_stations,
        "obs",
        """WITH s AS (SELECT ascii(variable) AS i, count(DISTINCT station) AS n FROM obs GROUP BY ALL), b AS (SELECT i, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s)
FINAL
SELECT variable, min(station + shift) AS first, max(station + shift) AS last FROM obs JOIN b ON i = ascii(variable) GROUP BY ALL""",
    ),
    Query(
        "renumbered_members", "model_name:s realization:i n:l", renumbered_members, "member", "SELECT model_name, CASE WHEN realization = 0 THEN ascii(model_name) - 64 ELSE realization END AS realization, count(*) AS n FROM member GROUP BY ALL"
    ),
    Query(
        "wrapped_longitudes",
        "model_name:s ix:l x:r",
        wrapped_longitudes,
        "",
        """WITH a AS (SELECT ['a', 'b', 'c'][s_suppkey % 3 + 1] AS model_name, s_suppkey AS ix, s_suppkey % 3 * 300 - 250 + s_suppkey * 0.1::DOUBLE AS x FROM supplier), m AS (SELECT model_name, median(x) AS mid FROM a GROUP BY ALL)
FINAL
SELECT model_name, ix, x + 360 * CASE WHEN mid < -175 THEN ceil((-175 - mid) / 360) WHEN mid >= 175 THEN -floor((mid - 175) / 360) - 1 ELSE 0 END AS x FROM a JOIN m USING (model_name)""",
    ),
    Query(
        "named_by_stash", "variable:s n:l", named_by_stash, "", "SELECT coalesce(n_name, 'code_' || s_nationkey) AS variable, count(*) AS n FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 15 GROUP BY ALL"
    ),
    Query(
        "matched_observations",
        "station:l n:l value:r",
        matched_observations,
        "obs",
        """WITH f AS (SELECT station, date_trunc('hour', time) AS time, avg(value) AS value FROM obs WHERE variable = 'view' GROUP BY ALL)
FINAL
SELECT f.station, count(*) AS n, avg(f.value - o.value) AS value FROM f JOIN obs o ON o.station = f.station AND o.variable <> 'view' AND o.time BETWEEN f.time - INTERVAL 30 MINUTE AND f.time + INTERVAL 30 MINUTE GROUP BY ALL""",
    ),
    Query(
        "nearest_observations",
        "model_name:s station:l iy:i ix:i n:l value:r first:t",
        nearest_observations,
        "obs",
        """WITH f AS (SELECT variable AS model_name, date_trunc('hour', time) AS valid, (station % 5)::INT AS iy, (station % 8)::INT AS ix, avg(value) AS forecast FROM obs WHERE variable IN ('view', 'click') GROUP BY ALL),
        o AS (SELECT *, fmod(station * 7.3::DOUBLE, 45) - 2 AS y, fmod(station * 3.7::DOUBLE, 80) - 4 AS x FROM obs WHERE variable NOT IN ('view', 'click')),
        p AS (SELECT *, ceil(y / 10 - 0.5)::INT AS iy, ceil(x / 10 - 0.5)::INT AS ix FROM o WHERE y BETWEEN 0 AND 40 AND x BETWEEN 0 AND 70),
        m AS (SELECT * FROM p JOIN f USING (iy, ix) WHERE f.valid BETWEEN p.time - INTERVAL 30 MINUTE AND p.time + INTERVAL 30 MINUTE QUALIFY row_number() OVER (PARTITION BY model_name, event_id ORDER BY abs(epoch_us(p.time) - epoch_us(f.valid)), f.valid) = 1)
FINAL
SELECT model_name, station, iy, ix, count(*) AS n, avg(forecast - value) AS value, min(valid) AS first FROM m GROUP BY ALL""",
    ),
    Query(
        "pseudo_forecasts",
        "variable:s forecast_reference_time:t n:l forecast_period:r value:r",
        pseudo_forecasts,
        "obs",
        """WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 12:00:00', TIMESTAMP '2024-02-05', INTERVAL 18 HOUR)) AS start), s AS (SELECT variable, min(time) AS lo, max(time) AS hi FROM obs GROUP BY ALL)
FINAL
SELECT variable, start AS forecast_reference_time, count(*) AS n, avg(epoch(time - start) / 3600) AS forecast_period, avg(value) AS value
FROM obs JOIN s USING (variable) JOIN c ON time BETWEEN start AND start + INTERVAL 48 HOUR WHERE start >= lo AND start + INTERVAL 48 HOUR <= hi GROUP BY ALL""",
    ),
    Query(
        "enriched_reports",
        "name:s type:s n:l value:r",
        enriched_reports,
        "",
        """SELECT n_name AS name, CASE l_returnflag WHEN 'A' THEN 'AIRCFT' WHEN 'N' THEN 'ADPSFC' ELSE l_returnflag END AS type, count(*) AS n, avg(l_quantity) AS value
FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30 WHERE (l_linenumber % 3) | (l_suppkey % 2) = 1 GROUP BY ALL""",
    ),
    Query(
        "last_reports",
        "station:l variable:s vld:t value:r event_id:l",
        last_reports,
        "obs",
        "SELECT station, variable, date_trunc('day', time) AS vld, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM obs GROUP BY ALL",
    ),
    Query(
        "long_reports",
        "sid:l var:s n:l value:r",
        long_reports,
        "",
        """WITH w AS (SELECT l_suppkey AS sid, l_quantity AS tt, l_tax AS rh FROM lineitem WHERE l_linenumber <> 7 AND l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-01-01'),
        l AS (SELECT sid, 'TMP' AS var, tt AS obs FROM w UNION ALL SELECT sid, 'RH', rh FROM w WHERE rh >= 0.02)
FINAL
SELECT sid, var, count(*) AS n, avg(obs) AS value FROM l GROUP BY ALL""",
    ),
    Query(
        "coded_reports",
        "Message_Type:s Station_ID:s month:t n:l n_level:l level:r n_height:l latest:t",
        coded_reports,
        "",
        """WITH r AS (SELECT CASE l_linenumber WHEN 1 THEN 'AIRCFT' WHEN 2 THEN 'ADPSFC' ELSE l_linenumber::VARCHAR END AS Message_Type, CASE WHEN l_linenumber = 3 THEN 'NA' ELSE l_returnflag END AS Station_ID,
          date_trunc('day', l_shipdate)::TIMESTAMP + to_hours(l_linenumber::BIGINT) + INTERVAL 3 MINUTE + INTERVAL 5 SECOND AS t, CASE WHEN l_linenumber < 4 OR l_linenumber > 5 THEN l_quantity END AS level,
          CASE WHEN l_linenumber = 4 OR (l_linenumber = 5 AND l_quantity = 1) THEN 0 END AS height FROM lineitem)
FINAL
SELECT Message_Type, Station_ID, date_trunc('month', t) AS month, count(*) AS n, count(level) AS n_level, avg(level) AS level, count(height) AS n_height, max(t) AS latest FROM r GROUP BY ALL""",
    ),
]
