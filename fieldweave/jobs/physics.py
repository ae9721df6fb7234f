"""Queries of the formulas on columns: one projection over every row each, then small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.functions import constraints, surface, thermo, units
from fieldweave.functions.surface import wind_direction, wind_speed
from fieldweave.jobs.base import Query
from fieldweave.sources import adapters


def _thermo():
    t, p, rh = F.col("t"), F.col("p"), F.col("rh")
    w, q = F.col("mixing_ratio"), F.col("specific_humidity")
    return {
        "vapour_pressure": thermo.vapour_pressure(t),
        "vapour_pressure_rh": thermo.vapour_pressure_from_rh(t, rh),
        "exner": thermo.exner_pressure(p),
        "saturation_mixing_ratio": thermo.saturation_mixing_ratio(t, p),
        "saturation_specific_humidity": thermo.saturation_specific_humidity(t, p),
        "mixing_ratio_of_q": thermo.mixing_ratio_from_specific_humidity(q),
        "specific_humidity_of_w": thermo.specific_humidity_from_mixing_ratio(w),
        "rh_of_w": thermo.rh_percent_from_mixing_ratio(w, t, p),
        "rh_of_q": thermo.rh_percent_from_specific_humidity(q, t, p),
        "dewpoint": thermo.finite(thermo.dewpoint_temperature(t, rh)),
        "virtual_temperature": thermo.virtual_temperature(t, w),
        "wet_bulb": thermo.wet_bulb_temperature(t, 100 * rh),
        "theta": thermo.potential_temperature(t, p),
        "theta_v": thermo.virtual_potential_temperature(t, w, p),
        "theta_e": thermo.equivalent_potential_temperature(t, rh, p),
        "theta_es": thermo.saturation_equivalent_potential_temperature(t, p),
    }


THERMO = [
    "vapour_pressure", "vapour_pressure_rh", "exner", "saturation_mixing_ratio", "saturation_specific_humidity", "mixing_ratio", "specific_humidity", "mixing_ratio_of_q", "specific_humidity_of_w",
    "rh_of_w", "rh_of_q", "dewpoint", "virtual_temperature", "wet_bulb", "theta", "theta_v", "theta_e", "theta_w", "theta_es",
]


def thermodynamics(spark, sf_dir):
    states = adapters.weather(spark, sf_dir).groupBy("t", "p", "rh").count()
    # What later formulas use many times is a column of its own first.
    t, p, rh = F.col("t"), F.col("p"), F.col("rh")
    bound = states.withColumns({"mixing_ratio": thermo.mixing_ratio_from_rh(t, p, rh), "specific_humidity": thermo.specific_humidity_from_rh(t, p, rh)})
    return bound.withColumns(_thermo()).withColumn("theta_w", thermo.wet_bulb_of_equivalent(F.col("theta_e")))


def winds(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    pairs = adapters.weather(spark, sf_dir).groupBy("u", "v").count()
    return pairs.select("u", "v", wind_speed(u, v).alias("speed"), wind_direction(u, v).alias("direction"), surface.beaufort(wind_speed(u, v)).alias("force"))


def aviation(spark, sf_dir):
    visibility, cloud = F.col("l_quantity") / 5, F.when(F.col("l_linenumber") < 6, F.col("l_quantity") / 15)
    ground = F.col("l_discount") * 2
    states = adapters.table(spark, sf_dir, "lineitem").select(
        surface.visibility_state(visibility).alias("visibility_state"), surface.cloud_base_state(cloud).alias("cloud_state"), surface.cloud_base_state(cloud, ground).alias("cloud_state_above_ground")
    )
    states = states.withColumn("colour_state", surface.colour_state(F.col("visibility_state"), F.col("cloud_state_above_ground")))
    return states.groupBy("visibility_state", "cloud_state", "cloud_state_above_ground", "colour_state").agg(F.count("*").alias("n"))


def convection(spark, sf_dir):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rows = adapters.table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        surface.cape_ratio(q, 1000 * d, -2000 * x).alias("ratio"),
        surface.inflow_layer(F.when(F.col("l_linenumber") < 7, q), 200 * d, 100 * x).alias("inflow"),
        surface.sensible_heat_flux(d, 250 + q, F.lit(1e5) - 1000 * q).alias("sensible"),
        surface.latent_heat(x / 1000, F.when(F.col("l_linenumber") % 2 == 0, F.lit("kg m-2 s-1")).otherwise(F.lit("W m-2"))).alias("latent"),
    )
    return rows.groupBy("l_returnflag").agg(F.avg("ratio").alias("ratio"), F.count("ratio").alias("n_ratio"), F.sum("inflow").alias("inflow"), F.avg("sensible").alias("sensible"), F.avg("latent").alias("latent"))


UNIT_PAIRS = [("K", "Celsius"), ("Celsius", "Fahrenheit"), ("m", "km"), ("kilofeet", "m"), ("hPa", "Pa"), ("1", "%"), ("m s-1", "knots"), ("kg m-2 s-1", "mm hr-1")]


def unit_conversions(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy("l_quantity").count()
    return rows.select("l_quantity", *(units.convert(F.col("l_quantity"), a, b).alias(f"c{i}") for i, (a, b) in enumerate(UNIT_PAIRS)))


def selections(spark, sf_dir):
    """How many observations and cells each predicate keeps."""
    obs = adapters.observations(spark, sf_dir)
    cells = adapters.member_field(spark, sf_dir).withColumns({"y": F.col("iy") * 10.0, "x": F.col("ix") * 45.0, "level_type": F.lit("pressure"), "level": 100.0 * F.col("realization")})
    named = {"march_1996": constraints.time_range("1996-03"), "years": constraints.time_range("1995", "1997-06"), "box": constraints.area(5, 35, 40, 200), "over_date_line": constraints.area(-5, 35, 300, 60),
             "no_control": constraints.not_member(0), "two_members": constraints.members([1, 3]), "levels": constraints.level("pressure", [100, 300]), "any_level": constraints.level("pressure", "*"), "not_surface": constraints.not_level(0)}
    one = cells.agg(*(F.count_if(c).alias(n) for n, c in named.items())).unpivot([], list(named), "name", "n")
    hours = obs.agg(F.count_if(constraints.hours(6, 8)).alias("morning"), F.count_if(constraints.time_range("2024-01-02T06", "2024-01-05")).alias("days")).unpivot([], ["morning", "days"], "name", "n")
    return one.union(hours)


C = "(t - 273.15)"
E = f"6.1121 * exp(17.502 * {C} / (240.97 + {C}))"
QUERIES = [
    Query(
        "thermodynamics",
        "t:r p:r rh:r count:l " + " ".join(f"{n}:r" for n in THERMO),
        thermodynamics,
        "wx",
        f"""WITH s AS (SELECT t, p, rh, count(*) AS count FROM wx GROUP BY ALL), a AS (SELECT *, {E} AS e, pow(p / 1000, 287.05 / 1005) AS x FROM s),
        b AS (SELECT *, 0.62197 * e / (p - e) AS ws, 0.62197 * e / p AS qs FROM a), c AS (SELECT *, ws * rh AS w, qs * rh AS q, ln(e * rh) AS le FROM b),
        d AS (SELECT *, t / x * pow(rh, -w * 461.52 / 1005) * exp(2.501e6 * w / (1005 * t)) AS the, t - 273.15 AS tc, 100 * rh AS r,
          t * (w + 0.62197) / (0.62197 * (1 + w)) AS tv FROM c),
        f AS (SELECT *, the / 273.15 AS z FROM d),
        g AS (SELECT *, the - exp((7.101574 - 20.68208 * z + 16.11182 * z**2 + 2.574631 * z**3 - 5.205688 * z**4) / (1 - 3.552497 * z + 3.781782 * z**2 - 0.6899655 * z**3 - 0.592934 * z**4)) AS thw,
          (243.5 * le - 440.8) / (19.48 - le) + 273.15 AS td,
          tc * atan(0.151977 * sqrt(r + 8.313659)) + atan(tc + r) - atan(r - 1.676331) + 0.00391838 * pow(r, 1.5) * atan(0.023101 * r) - 4.686035 + 273.15 AS tw FROM f)
FINAL
SELECT t, p, rh, count, e AS vapour_pressure, e * rh AS vapour_pressure_rh, x AS exner, ws AS saturation_mixing_ratio, qs AS saturation_specific_humidity, w AS mixing_ratio, q AS specific_humidity,
  q / (1 - q) AS mixing_ratio_of_q, w / (1 + w) AS specific_humidity_of_w, 100 * w / ws AS rh_of_w, 100 * q / qs AS rh_of_q, CASE WHEN tc BETWEEN -35 AND 35 THEN td END AS dewpoint, tv AS virtual_temperature,
  CASE WHEN tc BETWEEN -20 AND 50 AND r BETWEEN 5 AND 99 THEN tw END AS wet_bulb, t / x AS theta, tv / x AS theta_v, the AS theta_e,
  CASE WHEN thw - 273.15 BETWEEN -30 AND 50 THEN thw END AS theta_w, t / x * exp(2.501e6 * ws / (1005 * t)) AS theta_es FROM g""",
    ),
    Query(
        "winds",
        "u:r v:r speed:r direction:r force:r",
        winds,
        "wx",
        "SELECT u, v, sqrt(u * u + v * v) AS speed, fmod(degrees(atan2(-u, -v)) + 360, 360) AS direction, round_even(pow(sqrt(u * u + v * v) / 0.836, 2 / 3::DOUBLE), 0)::DOUBLE AS force FROM (SELECT DISTINCT u, v FROM wx)",
    ),
    Query(
        "aviation",
        "visibility_state:i cloud_state:i cloud_state_above_ground:i colour_state:i n:l",
        aviation,
        "",
        """WITH r AS (SELECT l_quantity / 5 AS v, CASE WHEN l_linenumber < 6 THEN l_quantity / 15 END AS c, l_discount * 2 AS g FROM lineitem),
        s AS (SELECT (v < 8)::INT + (v < 5)::INT + (v < 3.7)::INT + (v < 2.5)::INT + (v < 1.6)::INT + (v < 0.8)::INT AS visibility_state,
          coalesce((c < 2.5)::INT + (c < 1.5)::INT + (c < 0.7)::INT + (c < 0.5)::INT + (c < 0.3)::INT + (c < 0.2)::INT, 0) AS cloud_state,
          coalesce((c - g < 2.5)::INT + (c - g < 1.5)::INT + (c - g < 0.7)::INT + (c - g < 0.5)::INT + (c - g < 0.3)::INT + (c - g < 0.2)::INT, 0) AS cloud_state_above_ground FROM r)
FINAL
SELECT *, greatest(visibility_state, cloud_state_above_ground) AS colour_state, count(*) AS n FROM s GROUP BY ALL""",
    ),
    Query(
        "convection",
        "l_returnflag:s ratio:r n_ratio:l inflow:l sensible:r latent:r",
        convection,
        "",
        """WITH r AS (SELECT l_returnflag, CASE WHEN -2000 * l_tax > -75 THEN 1 - l_quantity / nullif(1000 * l_discount, 0) END AS ratio,
          coalesce((CASE WHEN l_linenumber < 7 THEN l_quantity END > 200 * l_discount + 100 * l_tax)::INT, 0) AS inflow,
          1005 * (1e5 - 1000 * l_quantity) / (287.05 * (250 + l_quantity)) * l_discount AS sensible, l_tax / 1000 * CASE WHEN l_linenumber % 2 = 0 THEN 2.501e6 ELSE 1 END AS latent FROM lineitem)
FINAL
SELECT l_returnflag, avg(ratio) AS ratio, count(ratio) AS n_ratio, sum(inflow) AS inflow, avg(sensible) AS sensible, avg(latent) AS latent FROM r GROUP BY ALL""",
    ),
    Query(
        "unit_conversions",
        "l_quantity:r " + " ".join(f"c{i}:r" for i in range(len(UNIT_PAIRS))),
        unit_conversions,
        "",
        """SELECT DISTINCT l_quantity, l_quantity - 273.15 AS c0, l_quantity * 9 / 5 + 32 AS c1, l_quantity / 1000 AS c2, l_quantity * 304.8 AS c3, l_quantity * 100 AS c4, l_quantity * 100 AS c5,
        l_quantity * 3600 / 1852 AS c6, l_quantity * 3600 AS c7 FROM lineitem""",
    ),
    Query(
        "selections",
        "name:s n:l",
        selections,
        "member obs",
        """WITH m AS (SELECT *, iy * 10.0 AS y, ix * 45.0 AS x, 100.0 * realization AS level FROM member)
FINAL
SELECT 'march_1996' AS name, count(*) FILTER (time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1996-04-01') AS n FROM m
UNION ALL SELECT 'years', count(*) FILTER (time >= TIMESTAMP '1995-01-01' AND time <= TIMESTAMP '1997-06-01') FROM m
UNION ALL SELECT 'box', count(*) FILTER (y > 5 AND y < 35 AND x > 40 AND x < 200) FROM m
UNION ALL SELECT 'over_date_line', count(*) FILTER (y > -5 AND y < 35 AND (x > 300 OR x < 60)) FROM m
UNION ALL SELECT 'no_control', count(*) FILTER (realization <> 0) FROM m UNION ALL SELECT 'two_members', count(*) FILTER (realization IN (1, 3)) FROM m
UNION ALL SELECT 'levels', count(*) FILTER (level IN (100, 300)) FROM m UNION ALL SELECT 'any_level', count(*) FROM m UNION ALL SELECT 'not_surface', count(*) FILTER (level <> 0) FROM m
UNION ALL SELECT 'morning', count(*) FILTER (hour(time) BETWEEN 6 AND 8) FROM obs
UNION ALL SELECT 'days', count(*) FILTER (time BETWEEN TIMESTAMP '2024-01-02 06:00:00' AND TIMESTAMP '2024-01-05') FROM obs""",
    ),
]
