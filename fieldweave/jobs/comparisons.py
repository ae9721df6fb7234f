"""Queries of the alignment, score and ensemble operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.jobs.aggregates import CELL, pairs
from fieldweave.jobs.base import Query
from fieldweave.operators import align, collapse, masks, observations, scores
from fieldweave.sources import adapters

THRESHOLDS = [15.0, 20.0, 25.0, 30.0]


def model_difference(spark, sf_dir):
    return align.difference(adapters.field(spark, sf_dir), CELL)


def named_results(spark, sf_dir):
    """Differences and probabilities under the names that they are known by."""
    keep = ["variable", "units", "model_name", "time"]
    field = adapters.field(spark, sf_dir)
    differences = align.named_difference(field, CELL).groupBy(*keep).agg(F.avg("value").alias("value"))
    return differences.unionByName(collapse.named_proportion(field, ["model_name", "time"], "gt", 25.0).select(*keep, "value"))


def pivoted_difference(spark, sf_dir):
    return align.pivoted_difference(adapters.field(spark, sf_dir), CELL, "R")


def common_points(spark, sf_dir):
    return align.common_points(adapters.field(spark, sf_dir), CELL).groupBy("model_name").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def matched_points(spark, sf_dir):
    point = ["time", "iy", "ix", "realization"]
    return align.matched_points(adapters.member_field(spark, sf_dir), *point).select(*point, F.concat_ws(",", "models").alias("models"))


def field_product(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    static = field.groupBy("iy", "ix").agg(F.avg("value").alias("value")).withColumn("variable", F.lit("mean"))
    return align.arithmetic(field, static, CELL, "multiply")


def field_ratio(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    return align.arithmetic(field.where("model_name = 'N'"), field.where("is_base").select(*CELL, "value", "variable"), CELL, "divide")


def forecast_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("model_name", *CELL, F.col("other").alias("forecast"), F.col("base").alias("observed"))


def model_scores(spark, sf_dir):
    return scores.scores(forecast_pairs(spark, sf_dir), ["model_name", "time"])


def overall_scores(spark, sf_dir):
    return scores.scores(forecast_pairs(spark, sf_dir), ["model_name"])


def station_scores(spark, sf_dir):
    """Daily clicks forecast daily views; latitudes, which belong to stations, are preserved."""
    daily = adapters.observations(spark, sf_dir).groupBy("station", F.date_trunc("day", "time").alias("time")).agg(
        *(F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(n) for v, n in (("click", "forecast"), ("view", "observed")))
    )
    return scores.scores(daily.withColumn("lat", 50 + F.col("station") * 0.01), ["lat"], {"lat": "station"})


def detection_scores(spark, sf_dir):
    return scores.detection(scores.contingency(forecast_pairs(spark, sf_dir), ["model_name", "time"], "gt", THRESHOLDS))


def partial_sums(spark, sf_dir):
    return scores.partial_sums(forecast_pairs(spark, sf_dir), ["model_name"])


def ensemble_crps(spark, sf_dir):
    return scores.crps(adapters.member_field(spark, sf_dir), ["model_name", "time"], ["model_name", *CELL])


def fair_crps(spark, sf_dir):
    return scores.crps(adapters.member_field(spark, sf_dir), ["model_name"], ["model_name", *CELL], method="fair")


def double_kinetic_error(spark, sf_dir):
    winds = adapters.lines(spark, sf_dir).groupBy("model_name", "realization", *CELL).agg(F.avg(F.col("value") - 25).alias("u"), F.avg(100 * F.col("l_discount") - 5).alias("v"))
    return observations.double_kinetic_error(winds, ["model_name", *CELL]).groupBy("model_name", "realization").agg(F.avg("value").alias("value"))


def masks_of(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    value = F.when(F.col("ix") != 3, F.col("value"))
    return field.withColumn("value", value).groupBy("model_name", "time").agg(*(F.sum(masks.mask(F.col("value"), n, 25.0)).alias(f"n_{n}") for n in ("eq", "ne", "gt", "ge", "lt", "le")))


def land_mean(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    land = field.select("iy", "ix").distinct().withColumn("value", ((F.col("iy") + F.col("ix")) % 2).cast("double"))
    return masks.apply_mask(field, land, ["iy", "ix"]).groupBy("model_name", "time").agg(F.avg("value").alias("value"))


def trimmed(spark, sf_dir):
    field = adapters.field(spark, sf_dir)
    axes = field.groupBy("model_name").agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    return masks.trim(field, axes, 1, 2, 1, 1).groupBy("model_name", "iy", "ix").agg(F.avg("value").alias("value"))


def placed_axes(spark, sf_dir, low):
    """Axes 5 degrees apart: of the base from 40 north, of the others, whose poles are turned, from ``low``; and the poles."""
    field = adapters.field(spark, sf_dir)
    start = F.when(F.col("model_name") == "A", F.lit(40.0 if low is None else low)).otherwise(-10.0 if low is None else low)
    rows = [field.select("model_name", F.lit(a).alias("axis"), F.col(f"i{a}").alias("i"), ((start if a == "y" else F.lit(-20.0)) + 5 * F.col(f"i{a}")).alias("c")).distinct() for a in "yx"]
    poles = spark.sql("SELECT * FROM VALUES ('N', 37.5D, 177.5D), ('R', 45D, 170D) AS t(model_name, pole_lat, pole_lon)")
    return field, rows[0].union(rows[1]), poles


def real_subarea(spark, sf_dir):
    field, axes, poles = placed_axes(spark, sf_dir, None)
    return masks.subarea(field, axes, "realworld", (45, 57, -12, 8), poles).groupBy("model_name", "iy", "ix").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def relative_subarea(spark, sf_dir):
    field, axes, _ = placed_axes(spark, sf_dir, -10.0)
    return masks.subarea(field, axes, "modelrelative", (-5, 8, 350, 368)).groupBy("model_name", "iy", "ix").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def radar_weights(spark, sf_dir):
    weight = F.when(F.month("time") % 2 == 0, F.col("ix") * 4.0).otherwise((F.col("ix") * 4 + 1) / 32)
    cells = adapters.field(spark, sf_dir).withColumn("weight", weight)
    return masks.radar_weights(cells.select("model_name", *CELL, "value", "weight"), ["model_name", "time"]).groupBy("model_name", "time").agg(F.sum("value").alias("value"))


PAIRED = "p AS (SELECT time, iy, ix, o.model_name, b.value AS o, o.value AS f FROM field o JOIN field b USING (time, iy, ix) WHERE b.is_base AND NOT o.is_base)"
SCORES = "count(*) AS n, sqrt(avg((f - o) * (f - o))) AS rmse, avg(abs(f - o)) AS mae, avg(f - o) AS additive_bias, covar_pop(f, o) / nullif(stddev_pop(f) * stddev_pop(o), 0) AS pearson"
SHOWN = "n:l rmse:r mae:r additive_bias:r pearson:r"
TIMES = "min(time) AS time_start, max(time) AS time_end, make_timestamp((epoch_us(min(time)) + epoch_us(max(time))) // 2) AS time"
SHOWN_TIMES = f"{SHOWN} time:t time_start:t time_end:t"
BOXED = """WITH p AS (SELECT * FROM (VALUES ('N', 37.5::DOUBLE, 177.5::DOUBLE), ('R', 45.0::DOUBLE, 170.0::DOUBLE)) AS t(model_name, pole_lat, pole_lon)), c AS (SELECT * FROM (VALUES (0, 45.0::DOUBLE, -12.0::DOUBLE), (1, 57.0::DOUBLE, 8.0::DOUBLE)) AS t(k, lat, lon)),
t AS (SELECT model_name, k, radians(90 - pole_lat) AS t, radians(lat) AS y, radians(lon - pole_lon) AS x FROM p, c),
r AS (SELECT model_name, k, degrees(asin(sin(t) * cos(y) * cos(x) + cos(t) * sin(y))) AS lat, degrees(atan2(-cos(y) * sin(x), -(cos(t) * cos(y) * cos(x) - sin(t) * sin(y)))) AS lon FROM t UNION ALL SELECT 'A', k, lat, lon FROM c),
b AS (SELECT model_name, max(lat) FILTER (k = 0) AS low, max(lat) FILTER (k = 1) AS high, max(lon) FILTER (k = 0) AS west, max(lon) FILTER (k = 1) AS east FROM r GROUP BY ALL)
FINAL
SELECT model_name, iy, ix, count(*) AS n, avg(value) AS value FROM field JOIN b USING (model_name)
WHERE CASE WHEN model_name = 'A' THEN 40 ELSE -10 END + 5 * iy BETWEEN low AND high AND -20 + 5 * ix BETWEEN west AND east GROUP BY ALL"""
CRPS = """WITH x AS (SELECT model_name, time, iy, ix, first(value ORDER BY realization <> 0, realization) AS y, list(value ORDER BY realization <> 0, realization) AS m FROM member GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT x.model_name, time, iy, ix, y, unnest(m[2:]) AS v FROM x),
d AS (SELECT model_name, time, iy, ix, count(*) AS n, avg(abs(v - y)) AS a FROM e GROUP BY ALL),
s AS (SELECT a.model_name, a.time, a.iy, a.ix, sum(abs(a.v - b.v)) AS s FROM e a JOIN e b USING (model_name, time, iy, ix) GROUP BY ALL)
FINAL
"""

QUERIES = [
    Query("model_difference", "model_name:s time:t iy:i ix:i value:r", model_difference, "field", f"WITH {PAIRED}\nFINAL\nSELECT model_name, time, iy, ix, f - o AS value FROM p"),
    Query(
        "named_results",
        "variable:s units:s model_name:s time:t value:r",
        named_results,
        "field",
        f"""WITH {PAIRED}
FINAL
SELECT 'quantity_difference' AS variable, '1' AS units, model_name, time, avg(f - o) AS value FROM p GROUP BY ALL UNION ALL
SELECT 'probability_of_quantity_gt_25.0', '1', model_name, time, avg((value > 25)::INT) FROM field GROUP BY ALL""",
    ),
    Query("pivoted_difference", "time:t iy:i ix:i value:r", pivoted_difference, "field", f"WITH {PAIRED}\nFINAL\nSELECT time, iy, ix, f - o AS value FROM p WHERE model_name = 'R'"),
    Query(
        "common_points",
        "model_name:s n:l value:r",
        common_points,
        "field",
        "SELECT model_name, count(*) AS n, avg(value) AS value FROM field WHERE (time, iy, ix) IN (SELECT (time, iy, ix) FROM field GROUP BY time, iy, ix HAVING count(*) = 3) GROUP BY ALL",
    ),
    Query(
        "matched_points",
        "time:t iy:i ix:i realization:i models:s",
        matched_points,
        "member",
        "SELECT time, iy, ix, realization, string_agg(model_name, ',' ORDER BY model_name) AS models FROM member GROUP BY ALL",
    ),
    Query(
        "field_product",
        "model_name:s variable:s time:t iy:i ix:i value:r",
        field_product,
        "field",
        "SELECT model_name, 'quantity_x_mean' AS variable, time, iy, ix, value * m AS value FROM field JOIN (SELECT iy, ix, avg(value) AS m FROM field GROUP BY ALL) USING (iy, ix)",
    ),
    Query("field_ratio", "time:t iy:i ix:i value:r", field_ratio, "field", f"WITH {PAIRED}\nFINAL\nSELECT time, iy, ix, f / nullif(o, 0) AS value FROM p WHERE model_name = 'N'"),
    Query("model_scores", f"model_name:s time:t {SHOWN}", model_scores, "field", f"WITH {PAIRED}\nFINAL\nSELECT model_name, time, {SCORES} FROM p GROUP BY ALL"),
    Query("overall_scores", f"model_name:s {SHOWN_TIMES}", overall_scores, "field", f"WITH {PAIRED}\nFINAL\nSELECT model_name, {SCORES}, {TIMES} FROM p GROUP BY ALL"),
    Query("real_subarea", "model_name:s iy:i ix:i n:l value:r", real_subarea, "field", BOXED),
    Query("relative_subarea", "model_name:s iy:i ix:i n:l value:r", relative_subarea, "field", "SELECT model_name, iy, ix, count(*) AS n, avg(value) AS value FROM field WHERE 5 * iy - 10 BETWEEN -5 AND 8 AND 5 * ix - 20 BETWEEN -10 AND 8 GROUP BY ALL"),
    Query(
        "station_scores",
        f"station:l lat:r {SHOWN_TIMES}",
        station_scores,
        "obs",
        f"""SELECT station, 50 + station * 0.01 AS lat, {SCORES.replace("count(*)", "count(f - o)")}, {TIMES} FROM (SELECT station, time, CASE WHEN o IS NOT NULL THEN f END AS f, CASE WHEN f IS NOT NULL THEN o END AS o FROM
        (SELECT station, date_trunc('day', time) AS time, avg(value) FILTER (variable = 'click') AS f, avg(value) FILTER (variable = 'view') AS o FROM obs GROUP BY ALL)) GROUP BY ALL HAVING count(f - o) > 0""",
    ),
    Query(
        "detection_scores",
        "model_name:s time:t threshold:r hits:l misses:l false_alarms:l correct_negatives:l pod:r ets:r",
        detection_scores,
        "field",
        f"""WITH {PAIRED}, c AS (SELECT model_name, time, threshold, count(*) FILTER (f > threshold AND o > threshold) AS hits, count(*) FILTER (f <= threshold AND o > threshold) AS misses,
        count(*) FILTER (f > threshold AND o <= threshold) AS false_alarms, count(*) FILTER (f <= threshold AND o <= threshold) AS correct_negatives
        FROM p, (SELECT unnest({THRESHOLDS}) AS threshold) GROUP BY ALL),
        h AS (SELECT *, (hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + correct_negatives)::DOUBLE AS chance FROM c)
FINAL
SELECT *, coalesce(hits / nullif(hits + misses, 0), 0) AS pod, (hits - chance) / nullif(hits + misses + false_alarms - chance, 0) AS ets FROM h""",
    ),
    Query(
        "partial_sums",
        "model_name:s f_mean:r o_mean:r fo_mean:r ff_mean:r oo_mean:r",
        partial_sums,
        "field",
        f"WITH {PAIRED}\nFINAL\nSELECT model_name, avg(f) AS f_mean, avg(o) AS o_mean, avg(f * o) AS fo_mean, avg(f * f) AS ff_mean, avg(o * o) AS oo_mean FROM p GROUP BY ALL",
    ),
    Query("ensemble_crps", "model_name:s time:t crps:r", ensemble_crps, "member", f"{CRPS}SELECT model_name, time, avg(a - s / (2 * n * n)) AS crps FROM d JOIN s USING (model_name, time, iy, ix) GROUP BY ALL"),
    Query("fair_crps", "model_name:s crps:r", fair_crps, "member", f"{CRPS}SELECT model_name, avg(a - s / (2 * n * (n - 1))) AS crps FROM d JOIN s USING (model_name, time, iy, ix) GROUP BY ALL"),
    Query(
        "double_kinetic_error",
        "model_name:s realization:i value:r",
        double_kinetic_error,
        "ln",
        """WITH w AS (SELECT l_returnflag AS model_name, l_linenumber - 1 AS realization, date_trunc('month', l_shipdate) AS time, l_suppkey % 5 AS iy, l_partkey % 8 AS ix, avg(l_quantity - 25) AS u, avg(100 * l_discount - 5) AS v FROM lineitem GROUP BY ALL)
FINAL
SELECT m.model_name, m.realization, avg(0.5 * pow(c.u - m.u, 2) + 0.5 * pow(c.v - m.v, 2)) AS value FROM w m JOIN w c USING (model_name, time, iy, ix) WHERE c.realization = 0 AND m.realization <> 0 GROUP BY ALL""",
    ),
    Query(
        "masks",
        "model_name:s time:t n_eq:r n_ne:r n_gt:r n_ge:r n_lt:r n_le:r",
        masks_of,
        "field",
        """SELECT model_name, time, count(*) FILTER (v = 25) AS n_eq, count(*) FILTER (v <> 25 OR v IS NULL) AS n_ne, count(*) FILTER (v > 25) AS n_gt, count(*) FILTER (v >= 25) AS n_ge,
        count(*) FILTER (v < 25) AS n_lt, count(*) FILTER (v <= 25) AS n_le FROM (SELECT *, CASE WHEN ix <> 3 THEN value END AS v FROM field) GROUP BY ALL""",
    ),
    Query("land_mean", "model_name:s time:t value:r", land_mean, "field", "SELECT model_name, time, avg(value) FILTER ((iy + ix) % 2 = 1) AS value FROM field GROUP BY ALL"),
    Query("trimmed", "model_name:s iy:i ix:i value:r", trimmed, "field", "SELECT model_name, iy, ix, avg(value) AS value FROM field WHERE iy BETWEEN 1 AND 3 AND ix BETWEEN 2 AND 6 GROUP BY ALL"),
    Query(
        "radar_weights",
        "model_name:s time:t value:r",
        radar_weights,
        "field",
        """WITH w AS (SELECT *, CASE WHEN month(time) % 2 = 0 THEN ix * 4.0 ELSE (ix * 4 + 1) / 32.0 END::DOUBLE AS weight FROM field), m AS (SELECT model_name, time, max(weight) < 1 AS packed FROM w GROUP BY ALL)
FINAL
SELECT model_name, time, sum(CASE WHEN CASE WHEN packed THEN round_even(weight * 32, 0) ELSE weight END < 11 THEN 0 ELSE value END) AS value FROM w JOIN m USING (model_name, time) GROUP BY ALL""",
    ),
]
