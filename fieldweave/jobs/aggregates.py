"""Queries of the collapse, window and distribution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.jobs import diagnostics
from fieldweave.jobs.base import Query
from fieldweave.operators import align, collapse, distributions
from fieldweave.sources import adapters

METHODS = ("MEAN", "MAX", "MIN", "SUM", "MEDIAN", "RANGE", "STD_DEV", "VARIANCE", "RMS")


def domain_mean_series(spark, sf_dir):
    return collapse.collapse(adapters.field(spark, sf_dir), ["model_name", "time"], "MEAN")


def collapse_methods(spark, sf_dir):
    value = F.col("value")
    return adapters.field(spark, sf_dir).groupBy("model_name", "time").agg(*(collapse.aggregate(m, value).alias(m.lower()) for m in METHODS), collapse.aggregate("PERCENTILE", value, 90).alias("p90"))


def whole_domain_percentile(spark, sf_dir):
    return collapse.exact_percentile(adapters.lines(spark, sf_dir).select("model_name", "value"), ["model_name"], 95)


def event_cases(spark, sf_dir):
    return adapters.observations(spark, sf_dir).withColumn("forecast_reference_time", F.date_trunc("day", "time"))


def hour_of_day(spark, sf_dir):
    return collapse.by_hour_of_day(event_cases(spark, sf_dir), ["variable"], "MEAN")


def validity_time(spark, sf_dir):
    return collapse.by_validity_time(adapters.case_field(spark, sf_dir).withColumn("forecast_period", F.col("forecast_period") + 24 * F.col("iy")), ["model_name"], "MEAN")


def lead_time_mean(spark, sf_dir):
    return collapse.collapse(adapters.case_field(spark, sf_dir), ["model_name", "forecast_period"], "MEAN")


def proportion_above(spark, sf_dir):
    return collapse.proportion(adapters.field(spark, sf_dir), ["model_name", "time"], "gt", 25.0)


def six_hour_means(spark, sf_dir):
    return collapse.by_time(adapters.observations(spark, sf_dir), ["variable"], "MEAN", "PT6H")


def hour_of_day_median(spark, sf_dir):
    return collapse.by_hour_of_day(event_cases(spark, sf_dir), ["variable"], "MEDIAN")


def validity_time_median(spark, sf_dir):
    return collapse.by_validity_time(adapters.case_field(spark, sf_dir).withColumn("forecast_period", F.col("forecast_period") + 24 * F.col("iy")), ["model_name"], "MEDIAN")


def six_hour_percentile(spark, sf_dir):
    return collapse.by_time(adapters.observations(spark, sf_dir), ["variable"], "PERCENTILE", "PT6H", 90)


def cases_per_lead(spark, sf_dir):
    return collapse.cases_per_lead(adapters.case_field(spark, sf_dir))


def overlapping_cases(spark, sf_dir):
    return collapse.overlapping_cases(adapters.case_field(spark, sf_dir)).groupBy("model_name").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def domain_statistics(spark, sf_dir):
    return collapse.domain_statistics(adapters.field(spark, sf_dir), ["model_name", "time"])


def ensemble_spread(spark, sf_dir):
    return collapse.domain_statistics(adapters.member_field(spark, sf_dir), ["model_name", "time", "iy", "ix"])


def histogram(spark, sf_dir):
    return distributions.histogram(adapters.field(spark, sf_dir), ["model_name"])


def rain_contribution(spark, sf_dir):
    edges = distributions.RAIN_AMOUNT_EDGES
    counts = distributions.edge_histogram(adapters.field(spark, sf_dir), ["model_name"], edges)
    return distributions.contribution(counts, ["model_name"], edges)


CELL = ["time", "iy", "ix"]


def pairs(spark, sf_dir):
    return align.paired(adapters.field(spark, sf_dir), CELL)


def quantile_pairs(spark, sf_dir):
    return distributions.quantile_pairs(pairs(spark, sf_dir), [1, 10, 25, 50, 75, 90, 99], ["model_name"])


def scatter_quantiles(spark, sf_dir):
    percents = distributions.SCATTER_PERCENTS
    found = collapse.collapse(adapters.field(spark, sf_dir), ["model_name"], "PERCENTILE", percents)
    return found.select("model_name", F.posexplode("value").alias("place", "value"))


def hexagons(spark, sf_dir):
    return distributions.hexagons(pairs(spark, sf_dir), 20, ["model_name"])


def hourly(spark, sf_dir):
    return adapters.observations(spark, sf_dir).groupBy("variable", F.date_trunc("hour", "time").alias("time")).agg(F.avg("value").alias("value"))


def rolling_day(spark, sf_dir):
    return collapse.rolling(hourly(spark, sf_dir), ["variable"], "MEAN", 24)


def rolling_median(spark, sf_dir):
    return collapse.rolling(hourly(spark, sf_dir), ["variable"], "MEDIAN", 24)


def daily_maximum(spark, sf_dir):
    return diagnostics.daily_extreme(hourly(spark, sf_dir), ["variable"], "MAX")


def daily_presence(spark, sf_dir):
    masked = hourly(spark, sf_dir).withColumn("value", diagnostics.presence(F.col("value") - 100, "lightning"))
    return diagnostics.daily_extreme(masked, ["variable"], "MAX")


RAIN = ["rain", "light_rain", "moderate_rain", "heavy_rain", "violent_rain", "fog", "low_cloud"]


def presence_fractions(spark, sf_dir):
    return diagnostics.domain_fraction(adapters.field(spark, sf_dir).withColumn("value", F.col("value") - 20), ["model_name", "time"], RAIN)


def exceedance_without_control(spark, sf_dir):
    from fieldweave.functions.constraints import not_member

    return collapse.proportion(adapters.member_field(spark, sf_dir).where(not_member(0)), ["model_name", "time", "iy", "ix"], "ge", 30.0)


def level_profile(spark, sf_dir):
    """Members stand for levels: over the domain first, then over time."""
    over_domain = collapse.collapse(adapters.member_field(spark, sf_dir), ["model_name", "realization", "time"], "MEAN")
    return collapse.collapse(over_domain, ["model_name", "realization"], "MEAN")


ROLL = """SELECT variable, make_timestamp(((epoch_us(min(time) OVER w) + epoch_us(max(time) OVER w)) // 2)::BIGINT) AS time, {0} OVER w AS value, count(*) OVER w AS n
FROM {1} WINDOW w AS (PARTITION BY variable ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""
SCATTER = [p / 100 for p in distributions.SCATTER_PERCENTS]
QQ = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
PAIRS = "p AS (SELECT time, iy, ix, o.model_name, b.value AS base, o.value AS other FROM field o JOIN field b USING (time, iy, ix) WHERE b.is_base AND NOT o.is_base)"
E_ = distributions.RAIN_AMOUNT_EDGES

QUERIES = [
    Query("domain_mean_series", "model_name:s time:t value:r", domain_mean_series, "field", "SELECT model_name, time, avg(value) AS value FROM field GROUP BY ALL"),
    Query(
        "collapse_methods",
        "model_name:s time:t " + " ".join(f"{m.lower()}:r" for m in METHODS) + " p90:r",
        collapse_methods,
        "field",
        """SELECT model_name, time, avg(value) AS mean, max(value) AS max, min(value) AS min, sum(value) AS sum, quantile_cont(value, 0.5) AS median, max(value) - min(value) AS range,
        stddev_samp(value) AS std_dev, var_samp(value) AS variance, sqrt(avg(value * value)) AS rms, quantile_cont(value, 0.9) AS p90 FROM field GROUP BY ALL""",
    ),
    Query("whole_domain_percentile", "model_name:s value:r", whole_domain_percentile, "ln", "SELECT model_name, quantile_cont(value, 0.95) AS value FROM ln GROUP BY ALL"),
    Query(
        "hour_of_day",
        "variable:s hour:i value:r",
        hour_of_day,
        "obs",
        "SELECT variable, hour, avg(value) AS value FROM (SELECT variable, date_trunc('day', time) AS d, hour(time) AS hour, avg(value) AS value FROM obs GROUP BY ALL) GROUP BY ALL",
    ),
    Query(
        "validity_time",
        "model_name:s time:t n_cases:l value:r",
        validity_time,
        "cases",
        "SELECT model_name, frt + to_hours((lead + 24 * iy)::BIGINT) AS time, count(DISTINCT frt) AS n_cases, avg(value) AS value FROM cases GROUP BY ALL",
    ),
    Query("lead_time_mean", "model_name:s forecast_period:r value:r", lead_time_mean, "cases", "SELECT model_name, lead AS forecast_period, avg(value) AS value FROM cases GROUP BY ALL"),
    Query("proportion_above", "model_name:s time:t value:r", proportion_above, "field", "SELECT model_name, time, avg((value > 25)::INT) AS value FROM field GROUP BY ALL"),
    Query(
        "six_hour_means", "variable:s time:t value:r", six_hour_means, "obs", "SELECT variable, time_bucket(INTERVAL '6 hours', time, TIMESTAMP '1970-01-01') AS time, avg(value) AS value FROM obs GROUP BY ALL"
    ),
    Query("cases_per_lead", "model_name:s forecast_period:r n_cases:l", cases_per_lead, "cases", "SELECT model_name, lead AS forecast_period, count(DISTINCT frt) AS n_cases FROM cases GROUP BY ALL"),
    Query(
        "overlapping_cases",
        "model_name:s n:l value:r",
        overlapping_cases,
        "cases",
        "SELECT model_name, count(*) AS n, avg(value) AS value FROM cases WHERE (frt, lead) IN (SELECT (frt, lead) FROM cases GROUP BY frt, lead HAVING count(DISTINCT model_name) = 3) GROUP BY ALL",
    ),
    Query(
        "domain_statistics", "model_name:s time:t lowest:r highest:r mean:r", domain_statistics, "field", "SELECT model_name, time, min(value) AS lowest, max(value) AS highest, avg(value) AS mean FROM field GROUP BY ALL"
    ),
    Query(
        "ensemble_spread",
        "model_name:s time:t iy:i ix:i lowest:r highest:r mean:r",
        ensemble_spread,
        "member",
        "SELECT model_name, time, iy, ix, min(value) AS lowest, max(value) AS highest, avg(value) AS mean FROM member GROUP BY ALL",
    ),
    Query(
        "histogram",
        "model_name:s bin:l lower:r upper:r n:l density:r",
        histogram,
        "field",
        """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS width FROM field),
        c AS (SELECT model_name, least(floor((value - lo) * 50 / (hi - lo)), 49) AS bin, count(*) AS n FROM field, e GROUP BY ALL)
FINAL
SELECT m.model_name, b.bin, lo + b.bin * width AS lower, lo + (b.bin + 1) * width AS upper, coalesce(n, 0) AS n, coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY m.model_name) * width) AS density
FROM (SELECT DISTINCT model_name FROM field) m, range(0, 50) AS b(bin), e LEFT JOIN c ON c.model_name = m.model_name AND c.bin = b.bin""",
    ),
    Query(
        "rain_contribution",
        "model_name:s bin:i value:r",
        rain_contribution,
        "field",
        f"""WITH g AS (SELECT {E_} AS e), c AS (SELECT model_name, least(len(list_filter(e, lambda x: x <= value)) - 1, {len(E_) - 2}) AS bin, count(*) AS n FROM field, g WHERE value BETWEEN {E_[0]!r} AND {E_[-1]!r} GROUP BY ALL)
FINAL
SELECT * FROM (SELECT model_name, bin, n * (e[bin + 1] + e[bin + 2]) / 2 / sum(n) OVER (PARTITION BY model_name) AS value FROM c, g) WHERE bin > 0""",
    ),
    Query(
        "quantile_pairs",
        "model_name:s percent:r base:r other:r",
        quantile_pairs,
        "field",
        f"WITH {PAIRS}, q AS (SELECT model_name, quantile_cont(base, {QQ}) AS b, quantile_cont(other, {QQ}) AS o FROM p GROUP BY ALL)\nFINAL\nSELECT model_name, 100 * unnest({QQ}) AS percent, unnest(b) AS base, unnest(o) AS other FROM q",
    ),
    Query(
        "scatter_quantiles",
        "model_name:s place:i value:r",
        scatter_quantiles,
        "field",
        f"SELECT model_name, unnest(range(0, {len(SCATTER)})) AS place, unnest(v) AS value FROM (SELECT model_name, quantile_cont(value, {SCATTER}) AS v FROM field GROUP BY ALL)",
    ),
    Query(
        "hexagons",
        "model_name:s hx:l hy:l n:l",
        hexagons,
        "field",
        f"""WITH {PAIRS}, r AS (SELECT min(base) AS b0, max(base) - min(base) AS b1, min(other) AS o0, max(other) - min(other) AS o1 FROM p),
        u AS (SELECT model_name, (base - b0) * (20 / b1) AS x, (other - o0) * (11 / o1) AS y FROM p, r),
        h AS (SELECT *, round_even(x, 0)::DOUBLE AS ax, round_even(y, 0)::DOUBLE AS ay, floor(x) + 0.5 AS bx, floor(y) + 0.5 AS by_ FROM u),
        d AS (SELECT *, (x - ax) * (x - ax) + 3 * (y - ay) * (y - ay) < (x - bx) * (x - bx) + 3 * (y - by_) * (y - by_) AS first FROM h)
FINAL
SELECT model_name, 2 * CASE WHEN first THEN ax ELSE bx END AS hx, 2 * CASE WHEN first THEN ay ELSE by_ END AS hy, count(*) AS n FROM d GROUP BY ALL""",
    ),
    Query(
        "hour_of_day_median",
        "variable:s hour:i value:r",
        hour_of_day_median,
        "obs",
        "SELECT variable, hour, quantile_cont(value, 0.5) AS value FROM (SELECT variable, date_trunc('day', time) AS d, hour(time) AS hour, quantile_cont(value, 0.5) AS value FROM obs GROUP BY ALL) GROUP BY ALL",
    ),
    Query(
        "validity_time_median",
        "model_name:s time:t n_cases:l value:r",
        validity_time_median,
        "cases",
        "SELECT model_name, frt + to_hours((lead + 24 * iy)::BIGINT) AS time, count(DISTINCT frt) AS n_cases, quantile_cont(value, 0.5) AS value FROM cases GROUP BY ALL",
    ),
    Query(
        "six_hour_percentile",
        "variable:s time:t value:r",
        six_hour_percentile,
        "obs",
        "SELECT variable, time_bucket(INTERVAL '6 hours', time, TIMESTAMP '1970-01-01') AS time, quantile_cont(value, 0.9) AS value FROM obs GROUP BY ALL",
    ),
    Query("rolling_median", "variable:s time:t value:r", rolling_median, "hourly", f"SELECT * FROM ({ROLL.format('quantile_cont(value, 0.5)', 'hourly')}) WHERE n = 24"),
    Query("rolling_day", "variable:s time:t value:p", rolling_day, "hourly", f"SELECT * FROM ({ROLL.format('avg(value)', 'hourly')}) WHERE n = 24"),
    Query("daily_maximum", "variable:s time:t value:r", daily_maximum, "hourly", f"SELECT * FROM ({ROLL.format('max(value)', 'hourly')}) WHERE n = 24 AND hour(time) = 21"),
    Query(
        "daily_presence",
        "variable:s time:t value:r",
        daily_presence,
        "hourly",
        f"SELECT * FROM ({ROLL.format('max(value)', '(SELECT variable, time, (value > 100)::INT::DOUBLE AS value FROM hourly)')}) WHERE n = 24 AND hour(time) = 21",
    ),
    Query(
        "presence_fractions",
        "model_name:s time:t " + " ".join(f"{n}:r" for n in RAIN),
        presence_fractions,
        "field",
        """SELECT model_name, time, avg((v > 0)::INT) AS rain, avg((v > 0 AND v < 2)::INT) AS light_rain, avg((v >= 2 AND v < 10)::INT) AS moderate_rain, avg((v >= 10 AND v < 50)::INT) AS heavy_rain,
        avg((v >= 50)::INT) AS violent_rain, avg((v < 0.25)::INT) AS fog, avg((v < 50)::INT) AS low_cloud FROM (SELECT *, value - 20 AS v FROM field) GROUP BY ALL""",
    ),
    Query(
        "exceedance_without_control",
        "model_name:s time:t iy:i ix:i value:r",
        exceedance_without_control,
        "member",
        "SELECT model_name, time, iy, ix, avg((value >= 30)::INT) AS value FROM member WHERE realization <> 0 GROUP BY ALL",
    ),
    Query(
        "level_profile",
        "model_name:s realization:i value:r",
        level_profile,
        "member",
        "SELECT model_name, realization, avg(value) AS value FROM (SELECT model_name, realization, time, avg(value) AS value FROM member GROUP BY ALL) GROUP BY ALL",
    ),
]
