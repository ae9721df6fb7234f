"""Queries of the vertical, regridding, slab, tracking and trajectory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.jobs import diagnostics
from fieldweave.jobs.base import Query
from fieldweave.operators import align, regrid, slabs, tracking, vertical
from fieldweave.shared import cut
from fieldweave.sources import adapters

COLUMN = ["model_name", "time", "iy", "ix"]


def levels(spark, sf_dir):
    """Members stand for levels, 100 m apart and a little more with height."""
    z = 100.0 * F.col("realization") + 10.0 * F.col("realization") * F.col("realization")
    cells = adapters.lines(spark, sf_dir).groupBy("realization", *COLUMN).agg(F.avg("value").alias("value"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
    return cells.withColumn("level_height", z)


def vertical_slopes(spark, sf_dir):
    return vertical.differentiate(levels(spark, sf_dir), COLUMN, "level_height").groupBy("model_name", "time").agg(F.avg("value").alias("value"), F.sum("level_height").alias("level_height"))


def precipitable_water(spark, sf_dir):
    moist = levels(spark, sf_dir).select(*COLUMN, "level_height", (F.col("d") / 10).alias("mixing_ratio"), (0.1 + F.col("x")).alias("relative_humidity"))
    water = vertical.precipitable_water(moist, COLUMN)
    return water.groupBy("model_name", "time").agg(*(F.avg(c).alias(c) for c in ("water", "saturation_water", "saturation_fraction")))


def height_integral(spark, sf_dir):
    return vertical.integrate(levels(spark, sf_dir), COLUMN).groupBy("model_name", "time").agg(F.avg("value").alias("value"))


def masked_levels(spark, sf_dir):
    return levels(spark, sf_dir).withColumns({"mask": (F.col("value") > 20).cast("int"), "u": F.col("value") - 24.9, "v": 100 * F.col("d") - 4.7})


def unstable_runs(spark, sf_dir):
    return vertical.layers(masked_levels(spark, sf_dir), COLUMN)


def layer_winds(spark, sf_dir):
    found = masked_levels(spark, sf_dir)
    below = vertical.layer_properties(found, COLUMN, "wind_below").withColumnRenamed("value", "wind_below")
    shear = vertical.layer_properties(found, COLUMN, "directional_shear").withColumnRenamed("value", "directional_shear")
    return below.join(shear, COLUMN)


def unstable_mask(spark, sf_dir):
    states = levels(spark, sf_dir).select(*COLUMN, "level_height", (280 + F.col("value") / 10).alias("t"), (1000 - F.col("level_height") / 10).alias("p"), (0.85 + F.col("d")).alias("rh"))
    return diagnostics.unstable_layers(states, COLUMN).groupBy("model_name", "time").agg(F.sum("mask").alias("value"))


def vertical_interpolation(spark, sf_dir):
    found = vertical.interpolate(levels(spark, sf_dir), COLUMN, "level_height", [-20.0, 150.0, 500.0, 2000.0])
    return found.groupBy("model_name", "time", "level_height").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def rain_rates(spark, sf_dir):
    series = ["model_name", "iy", "ix"]
    return vertical.rain_rate(adapters.field(spark, sf_dir).select(*series, "time", "value"), series)


KEEP = ["model_name", "time"]


def axis(spark, n, step, start=0.0):
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (start + F.col("id") * step).alias("c"))


def own_axes(spark):
    return axis(spark, 5, 10.0), axis(spark, 8, 10.0)


def linear_regrid(spark, sf_dir):
    return regrid.regrid_onto(adapters.field(spark, sf_dir), own_axes(spark), (axis(spark, 7, 7.0, -2.0), axis(spark, 9, 9.0)), KEEP)


def nearest_regrid(spark, sf_dir):
    axes = own_axes(spark)
    return regrid.regrid_onto(adapters.field(spark, sf_dir), axes, tuple(regrid.spaced_axis(a, 7.5) for a in axes), KEEP, "Nearest")


def single_point(spark, sf_dir):
    return regrid.single_point(adapters.field(spark, sf_dir), own_axes(spark), 17.0, -324.0, KEEP, margin=1)


def vector_winds(spark, sf_dir):
    """Eastward winds on the given grid, northward ones on a coarser grid."""
    rows = adapters.lines(spark, sf_dir)
    u = rows.groupBy(*KEEP, "iy", "ix").agg(F.avg(F.col("value") - 24.9).alias("value")).withColumn("units", F.lit("m s-1"))
    coarse = [(F.col(c) % n).cast("int").alias(c) for c, n in (("iy", 3), ("ix", 4))]
    v = rows.groupBy(*KEEP, *coarse).agg(F.avg(100 * F.col("l_discount") - 4.7).alias("value")).withColumn("units", F.lit("m s-1"))
    return align.vector_wind(u, v, own_axes(spark), (axis(spark, 3, 15.0), axis(spark, 4, 20.0)), KEEP)


def stations(spark):
    """30 places, some outside the grid."""
    return spark.range(30).select(F.col("id").alias("station"), (F.col("id") * 1.7 - 3).alias("y"), (F.col("id") * 2.9 - 5).alias("x"))


def station_values(spark, sf_dir):
    return regrid.interpolate_to_stations(adapters.field(spark, sf_dir), own_axes(spark), stations(spark), KEEP)


def station_bias(spark, sf_dir):
    """Model minus observation at stations, then the mean over stations, a time."""
    both = station_values(spark, sf_dir)
    base = both.where("model_name = 'A'").select("time", "station", F.col("value").alias("base"))
    return both.where("model_name <> 'A'").join(base, ["time", "station"]).groupBy(*KEEP).agg(F.avg(F.col("value") - F.col("base")).alias("value"))


def transect(spark, sf_dir):
    return regrid.transect(adapters.field(spark, sf_dir), own_axes(spark), (0.0, 4.0), (40.0, 66.0), 9, KEEP)


def rotated_poles(spark, sf_dir):
    places = adapters.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 150).alias("lat"), (F.col("s_suppkey") * 3.7 % 360 - 180).alias("lon"))
    lat, lon = regrid.rotate_pole(F.col("lat"), F.col("lon"), 37.5, 177.5)
    turned = places.withColumns({"rlat": lat, "rlon": lon})
    back_lat, back_lon = regrid.unrotate_pole(F.col("rlat"), F.col("rlon"), 37.5, 177.5)
    return turned.withColumns({"back_lat": back_lat, "back_lon": back_lon, "metres": regrid.haversine(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(0.0))})


SLAB = ["time", "part"]


def box_perturbation(spark, sf_dir):
    return slabs.perturbation(adapters.slabs(spark, sf_dir), SLAB, 3, gauss=False)


def gaussian_perturbation(spark, sf_dir):
    return slabs.perturbation(adapters.slabs(spark, sf_dir), SLAB, 4)


def smoothed_slabs(spark, sf_dir):
    return slabs.smoothed(adapters.slabs(spark, sf_dir), SLAB)


def power_spectrum(spark, sf_dir):
    return slabs.power_spectrum(adapters.slabs(spark, sf_dir), SLAB)


def slab_pairs(spark, sf_dir):
    cells = adapters.slabs(spark, sf_dir)
    other = cells.select((F.col("time") - 1).alias("time"), "part", "iy", "ix", F.col("value").alias("other"))
    return cells.withColumnRenamed("value", "base").join(other, [*SLAB, "iy", "ix"])


def similarity_map(spark, sf_dir):
    return slabs.similarity(slab_pairs(spark, sf_dir), SLAB)


def mean_similarity(spark, sf_dir):
    return slabs.mean_similarity(slab_pairs(spark, sf_dir), SLAB)


def found_features(spark, sf_dir):
    """A label's place in order is the frame; parts are series."""
    cells = adapters.slabs(spark, sf_dir).select(F.col("part").alias("series"), F.col("time").alias("frame"), "iy", "ix", "value")
    return cut(tracking.features(cells, ["series", "frame"], 0.05))


def feature_tracks(spark, sf_dir):
    return tracking.track(found_features(spark, sf_dir), ["series"])


def feature_motion(spark, sf_dir):
    return tracking.motion(found_features(spark, sf_dir), ["series"])


def feature_lineage(spark, sf_dir):
    found = found_features(spark, sf_dir)
    return tracking.lineage(found, ["series"], cut(tracking.links(found, ["series"])))


def feature_fields(spark, sf_dir):
    found = found_features(spark, sf_dir)
    return tracking.feature_fields(found, tracking.track(found, ["series"]), ["series"])


def age_of_air(spark, sf_dir):
    """Leads, columns and three levels of the base's monthly fields; winds from its values."""
    months = adapters.lines(spark, sf_dir).where("is_base").groupBy((F.year("time") * 12 + F.month("time") - 1995 * 12 - 1).alias("lead"), "iy", "ix").agg(F.round(F.avg("value"), 6).alias("q"), F.round(F.avg("l_discount"), 9).alias("d"))
    q, d = F.col("q") - 25, F.col("d") - 0.05
    columns = months.select(
        "lead", "iy", "ix", F.array(q / 20, q / 10, q / 5).alias("us"), F.array(d * 40, d * 20, d * 10).alias("vs"), F.array(q * 0.001, d, -d).alias("ws"), F.array(*(F.lit(z) for z in (0.0, 1000.0, 2500.0))).alias("zs")
    )
    places = columns.select("iy", "ix").distinct().withColumns({"lat": 50 + F.col("iy") * 0.1, "lon": F.col("ix") * 0.15})
    return tracking.age_of_air(columns, tracking.grid_spacing(places), 5, 8, 1.0, 1)


LEVELS = """lv AS (SELECT realization, model_name, time, iy, ix, 100.0 * realization + 10.0 * realization * realization AS z, avg(value) AS value, avg(d) AS d, avg(x) AS x
FROM (SELECT l_linenumber - 1 AS realization, l_returnflag AS model_name, date_trunc('month', l_shipdate)::TIMESTAMP AS time, (l_suppkey % 5)::INT AS iy, (l_partkey % 8)::INT AS ix, l_quantity AS value, l_discount AS d, l_tax AS x FROM lineitem) GROUP BY ALL)"""
NEXT = "OVER (PARTITION BY model_name, time, iy, ix ORDER BY z)"
RUNS = f"""{LEVELS}, m AS (SELECT *, value > 20 AS m, value - 24.9 AS u, 100 * d - 4.7 AS v FROM lv), n AS (SELECT *, (m AND NOT coalesce(lag(m) {NEXT}, false))::INT AS new FROM m), r AS (SELECT *, sum(new) {NEXT} AS run FROM n),
s AS (SELECT model_name, time, iy, ix, run, min(z) FILTER (m) AS base, max(z) FILTER (m) AS top FROM r GROUP BY ALL),
b AS (SELECT model_name, time, iy, ix, count(base) AS number, arg_max(base, (top - base) * 100000 - base) AS base, arg_max(top, (top - base) * 100000 - base) AS top FROM s GROUP BY ALL)"""


def weights_sql(name: str, n: int, step: float, targets: str, extrapolate: bool = True) -> str:
    """Bilinear weights of ``targets`` (i, c) on the axis 0, step, ... of n points."""
    inside = "" if extrapolate else f" WHERE c BETWEEN 0 AND {(n - 1) * step}"
    return f"""{name}0 AS (SELECT i, c, least(greatest(floor(c / {step}), 0), {n - 2})::INT AS k FROM ({targets}){inside}), {name} AS (SELECT * FROM (
SELECT i AS target, k AS source, 1 - (c / {step} - k) AS w FROM {name}0 UNION ALL SELECT i, k + 1, c / {step} - k FROM {name}0) WHERE w <> 0)"""


AT_STATIONS = f"""{weights_sql("wy", 5, 10.0, "SELECT range AS i, range * 1.7::DOUBLE - 3 AS c FROM range(30)", False)}, {weights_sql("wx", 8, 10.0, "SELECT range AS i, range * 2.9::DOUBLE - 5 AS c FROM range(30)", False)},
need AS (SELECT wy.target, wy.source AS iy, wx.source AS ix, wy.w * wx.w AS w, count(*) OVER (PARTITION BY wy.target) AS n FROM wy JOIN wx USING (target)),
at_ AS (SELECT model_name, time, target AS station, CASE WHEN count(*) = max(n) THEN sum(w * value) END AS value FROM field JOIN need USING (iy, ix) GROUP BY ALL)"""
ROTATED = """WITH p AS (SELECT s_suppkey, s_acctbal / 150 AS lat, fmod(s_suppkey * 3.7::DOUBLE, 360) - 180 AS lon FROM supplier), a AS (SELECT *, radians(lat) AS y, radians(lon - 177.5) AS x, radians(90 - 37.5::DOUBLE) AS t FROM p)
FINAL
SELECT s_suppkey, degrees(asin(sin(t) * cos(y) * cos(x) + cos(t) * sin(y))) AS rlat, degrees(atan2(-cos(y) * sin(x), -(cos(t) * cos(y) * cos(x) - sin(t) * sin(y)))) AS rlon, lat AS back_lat, lon AS back_lon,
2 * 6378000.0 * asin(sqrt(pow(sin(radians(51.5 - lat) / 2), 2) + cos(y) * cos(radians(51.5)) * pow(sin(radians(0 - lon) / 2), 2))) AS metres FROM a"""
SPECTRUM = """WITH size AS (SELECT time, part, max(iy) + 1 AS ny, 64 AS nx FROM slabs GROUP BY ALL), rows_ AS (SELECT slabs.time, part, ny, nx, k AS kx, iy, sum(value * cos(pi() * (2 * ix + 1) * k / (2 * nx)) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END)::DOUBLE / nx)) AS f
FROM slabs JOIN size USING (time, part), range(0, 64) AS r(k) GROUP BY ALL),
both_ AS (SELECT time, part, ny, nx, kx, k AS ky, sum(f * cos(pi() * (2 * iy + 1) * k / (2 * ny)) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END)::DOUBLE / ny)) AS f FROM rows_, range(0, 40) AS r(k) WHERE k < ny GROUP BY ALL),
rings AS (SELECT time, part, floor(sqrt(pow((ky + 1) / ny::DOUBLE, 2) + pow((kx + 1) / nx::DOUBLE, 2)) * (least(ny, nx) - 1) + 1e-12) AS k, avg(f * f / (ny * nx)) AS value FROM both_ GROUP BY ALL),
every_ AS (SELECT time, part, unnest(range(1, least(ny, nx))) AS k FROM size)
FINAL
SELECT time, part, k, coalesce(value, 0) AS value FROM every_ LEFT JOIN rings USING (time, part, k)"""
BOX = """WITH size AS (SELECT time, part, max(iy) AS y1 FROM slabs GROUP BY ALL), near AS (SELECT s.time, s.part, s.iy, s.ix, s.value, least(greatest(s.iy + dy, 0), y1) AS jy, least(greatest(s.ix + dx, 0), 63) AS jx
FROM slabs s JOIN size USING (time, part), range(-1, 2) AS a(dy), range(-1, 2) AS b(dx))
FINAL
SELECT n.time, n.part, n.iy, n.ix, n.value - sum(s.value) / 9 AS value FROM near n JOIN slabs s ON s.time = n.time AND s.part = n.part AND s.iy = n.jy AND s.ix = n.jx GROUP BY n.time, n.part, n.iy, n.ix, n.value"""


def smoothing_sql(source: str, values: str, sigma: float, reach: int, fold: str) -> str:
    """``values`` (name = expression, ...) of ``source`` (time, part, iy, ix, ...) under a Gaussian of ``reach`` cells each way, as view m."""
    names = [v.split("=")[0] for v in values.split(", ")]
    sums = lambda pick: ", ".join(f"sum({pick(v)} * w) AS {v.split('=')[0]}" for v in values.split(", "))
    at = lambda c, n: fold.format(c, n)
    return f"""taps AS (SELECT k, exp(-0.5 * pow(k / {sigma}, 2)) / sum(exp(-0.5 * pow(k / {sigma}, 2))) OVER () AS w FROM range({-reach}, {reach + 1}) AS r(k)),
size_ AS (SELECT time, part, max(iy) + 1 AS ny FROM {source} GROUP BY ALL), rows_ AS (SELECT DISTINCT s.time, s.part, s.iy, ny FROM {source} s JOIN size_ USING (time, part)),
wy AS (SELECT time, part, iy, {at("iy + k", "ny")} AS jy, sum(w) AS w FROM rows_, taps GROUP BY ALL), wx AS (SELECT ix, {at("ix + k", "64")} AS jx, sum(w) AS w FROM range(0, 64) AS r(ix), taps GROUP BY ALL),
half AS (SELECT wy.time, wy.part, wy.iy, s.ix, {sums(lambda v: v.split("=")[1])} FROM wy JOIN {source} s ON s.time = wy.time AND s.part = wy.part AND s.iy = wy.jy GROUP BY ALL),
m AS (SELECT time, part, iy, wx.ix, {sums(lambda v: v.split("=")[0])} FROM half JOIN wx ON half.ix = wx.jx GROUP BY ALL)"""


MIRROR = "(CASE WHEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) < {1} THEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) ELSE 2 * {1} - 1 - (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) END)"
CLAMP = "least(greatest({0}, 0), {1} - 1)"
SIMILAR = f"""b AS (SELECT s.time, s.part, s.iy, s.ix, s.value AS x, o.value AS y FROM slabs s JOIN slabs o ON o.time = s.time + 1 AND o.part = s.part AND o.iy = s.iy AND o.ix = s.ix),
{smoothing_sql("b", "mx=x, my=y, mxx=x*x, myy=y*y, mxy=x*y", 1.5, 5, MIRROR)}, reach_ AS (SELECT time, part, max(iy) + 1 AS ny, pow(0.01 * (max(x) - min(x)), 2) AS c1, pow(0.03 * (max(x) - min(x)), 2) AS c2 FROM b GROUP BY ALL),
q AS (SELECT time, part, iy, ix, iy BETWEEN 5 AND ny - 6 AND ix BETWEEN 5 AND 58 AS inside,
  (2 * mx * my + c1) * (2 * (mxy - mx * my) * 121 / 120 + c2) / ((mx * mx + my * my + c1) * ((mxx - mx * mx + myy - my * my) * 121 / 120 + c2)) AS value FROM m JOIN reach_ USING (time, part))"""
METRES = "2 * 6378000.0 * asin(sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({2}) / 2), 2)))"
AGES = f"""SELECT lead, iy, ix, age FROM (WITH RECURSIVE mo AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS lead, (l_suppkey % 5)::INT AS iy, (l_partkey % 8)::INT AS ix, round(avg(l_quantity), 6) - 25 AS q, round(avg(l_discount), 9) - 0.05::DOUBLE AS d
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
w AS (SELECT lead, iy, ix, [q / 20, q / 10, q / 5] AS us, [d * 40, d * 20, d * 10] AS vs, [q * 0.001, d, -d] AS ws, [0.0, 1000.0, 2500.0]::DOUBLE[] AS zs FROM mo),
sp AS (SELECT iy, ix, {METRES.format("(50 + iy * 0.1::DOUBLE)", "(50 + iy * 0.1::DOUBLE)", "0.15::DOUBLE")} AS dx, {METRES.format("(50 + iy * 0.1::DOUBLE)", "(50 + (iy + CASE WHEN iy < 4 THEN 1 ELSE -1 END) * 0.1::DOUBLE)", "0.0::DOUBLE")} AS dy
  FROM (SELECT DISTINCT iy, ix FROM mo)),
s AS (SELECT lead AS l0, iy AS y0, ix AS x0, dx, dy, lead, iy::DOUBLE AS y, ix::DOUBLE AS x, 2 AS k, NULL::DOUBLE AS first, 0 AS step, false AS gone, false AS lost FROM w JOIN sp USING (iy, ix) WHERE lead >= 1
  UNION ALL
  SELECT l0, y0, x0, dx, dy, lead, y, x, list_position(list_transform(zs, lambda z: abs(z - moved)), list_min(list_transform(zs, lambda z: abs(z - moved)))), coalesce(first, moved), step, coalesce(away, false), (y IS NULL OR x IS NULL) AND NOT coalesce(away, false)
  FROM (SELECT *, y < 0 OR y >= 5 OR x < 0 OR x >= 8 AS away FROM (
    SELECT l0, y0, x0, dx, dy, s.lead - 1 AS lead, round(y - vs[k] * 3600 / dy, 9) AS y, round(x - us[k] * 3600 / dx, 9) AS x, first, coalesce(first, zs[k]) - ws[k] * 3600 AS moved, zs, step + 1 AS step
    FROM s LEFT JOIN w ON w.lead = s.lead AND w.iy = floor(y) AND w.ix = floor(x) WHERE NOT gone AND NOT lost AND s.lead > 0)))
SELECT l0 AS lead, y0 AS iy, x0 AS ix, CASE WHEN gone THEN step - 1 WHEN NOT lost THEN l0 END::DOUBLE AS age FROM s WHERE gone OR lost OR lead = 0)"""
FEATURES = """WITH RECURSIVE cells AS MATERIALIZED (SELECT DISTINCT part AS series, time AS frame, iy, ix FROM slabs WHERE value > 0.05),
beside AS (SELECT a.series, a.frame, a.iy, a.ix, b.iy AS jy, b.ix AS jx FROM cells a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(dy, dx) JOIN cells b ON b.series = a.series AND b.frame = a.frame AND b.iy = a.iy + dy AND b.ix = a.ix + dx),
reach AS (SELECT series, frame, iy, ix, iy AS jy, ix AS jx FROM cells UNION SELECT r.series, r.frame, r.iy, r.ix, b.jy, b.jx FROM reach r JOIN beside b ON b.series = r.series AND b.frame = r.frame AND b.iy = r.jy AND b.ix = r.jx),
area AS (SELECT series, frame, iy, ix, min(jy * 64 + jx) AS least, count(*) AS size FROM reach GROUP BY ALL),
found AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY series, frame ORDER BY least) AS feature, iy // 32 AS ty, ix // 32 AS tx FROM area) WHERE size >= 4),
met AS (SELECT a.series, a.frame, a.ty, a.tx, dy, dx, count(*) AS n FROM found a, range(-8, 9) AS y(dy), range(-8, 9) AS x(dx) JOIN found b ON b.series = a.series AND b.frame = a.frame + 1 AND b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY ALL),
motion AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY series, frame, ty, tx ORDER BY n DESC, dy * dy + dx * dx, dy, dx) = 1),
main AS (SELECT * FROM (SELECT series, frame, feature, ty, tx, count(*) AS n FROM found GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series, frame, feature ORDER BY n DESC, ty, tx) = 1),
past AS (SELECT f.series, f.frame + 1 AS frame, f.feature AS parent, f.size AS theirs, f.iy + coalesce(dy, 0) AS iy, f.ix + coalesce(dx, 0) AS ix FROM found f JOIN main m USING (series, frame, feature) LEFT JOIN motion o ON o.series = m.series AND o.frame = m.frame AND o.ty = m.ty AND o.tx = m.tx),
edges AS (SELECT f.series, f.frame, f.feature, p.parent, count(*) AS shared FROM found f JOIN past p USING (series, frame, iy, ix) GROUP BY ALL HAVING count(*) >= 0.3::DOUBLE * least(max(f.size), max(p.theirs))),
follows AS (SELECT *, row_number() OVER (PARTITION BY series, frame, parent ORDER BY shared DESC, feature) = 1 AS continues FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY series, frame, feature ORDER BY shared DESC, parent) = 1)),
nodes AS (SELECT n.series, n.frame, n.feature, n.cy, n.cx, f.parent, coalesce(f.continues, false) AS continues FROM (SELECT series, frame, feature, avg(iy) AS cy, avg(ix) AS cx FROM found GROUP BY ALL) n LEFT JOIN follows f USING (series, frame, feature)),
lives AS (SELECT series, frame, feature, frame AS root_frame, feature AS root, 1 AS lifetime FROM nodes WHERE parent IS NULL UNION ALL
  SELECT n.series, n.frame, n.feature, CASE WHEN n.continues THEN l.root_frame ELSE n.frame END, CASE WHEN n.continues THEN l.root ELSE n.feature END, l.lifetime + 1 FROM lives l JOIN nodes n ON n.series = l.series AND n.frame = l.frame + 1 AND n.parent = l.feature),
tracks AS (SELECT l.*, l.lifetime = 1 AND NOT EXISTS (FROM found o JOIN lives p USING (series, frame, feature) WHERE p.lifetime > 1 AND o.series = l.series AND o.frame = l.frame AND pow(o.iy - n.cy, 2) + pow(o.ix - n.cx, 2) <= 25) AS initiation FROM lives l JOIN nodes n USING (series, frame, feature))
"""


def features_sql(tail: str) -> str:
    return f"SELECT * FROM ({FEATURES}{tail})"


LINEAGE = features_sql("""SELECT series, frame, feature, unnest([CASE WHEN up = 0 AND frame > first THEN 'initiation' END, CASE WHEN up > 1 THEN 'merge' END, CASE WHEN down > 1 THEN 'split' END,
  CASE WHEN down > 0 AND NOT heir THEN 'accretion' END, CASE WHEN down = 0 AND frame < last THEN 'dissipation' END]) AS event, unnest([up, up, down, down, down]) AS others FROM (
  SELECT n.series, n.frame, n.feature, (SELECT count(*) FROM edges e WHERE e.series = n.series AND e.frame = n.frame AND e.feature = n.feature) AS up, (SELECT count(*) FROM edges e WHERE e.series = n.series AND e.frame = n.frame + 1 AND e.parent = n.feature) AS down,
    EXISTS (FROM follows f WHERE f.continues AND f.series = n.series AND f.frame = n.frame + 1 AND f.parent = n.feature) AS heir, min(n.frame) OVER (PARTITION BY n.series) AS first, max(n.frame) OVER (PARTITION BY n.series) AS last FROM nodes n)""") + " WHERE event IS NOT NULL"
FIELDS = features_sql("""SELECT f.series, f.frame, f.iy, f.ix, i.feature_id, t.lifetime AS feature_lifetime, t.initiation::INT AS feature_init FROM found f JOIN tracks t USING (series, frame, feature)
JOIN (SELECT series, root_frame, root, row_number() OVER (PARTITION BY series ORDER BY root_frame, root) AS feature_id FROM tracks GROUP BY series, root_frame, root) i ON i.series = t.series AND i.root_frame = t.root_frame AND i.root = t.root""")
UNSTABLE = f"""WITH {LEVELS}, s AS (SELECT *, 280 + value / 10 AS t, 1000 - z / 10 AS p, 0.85 + d AS rh FROM lv), e AS (SELECT *, 6.1121 * exp(17.502 * (t - 273.15) / (240.97 + t - 273.15)) AS e FROM s),
w AS (SELECT *, 0.62197 * e / (p - e) * rh AS w FROM e), h AS (SELECT *, t / pow(p / 1000, 287.05 / 1005) * pow(rh, -w * 461.52 / 1005) * exp(2.501e6 * w / (1005 * t)) AS h FROM w),
n AS (SELECT *, (lead(h) {NEXT} - h) / (lead(z) {NEXT} - z) AS slope FROM h)
FINAL
SELECT model_name, time, sum((coalesce(slope < 0, false) AND rh > 0.9)::INT) AS value FROM n GROUP BY ALL"""

QUERIES = [
    Query(
        "vertical_slopes",
        "model_name:s time:t value:r level_height:r",
        vertical_slopes,
        "",
        f"WITH {LEVELS}, a AS (SELECT *, lead(z) {NEXT} AS z1, lead(value) {NEXT} AS v1 FROM lv)\nFINAL\nSELECT model_name, time, avg((v1 - value) / (z1 - z)) AS value, sum((z + z1) / 2) AS level_height FROM a WHERE z1 IS NOT NULL GROUP BY ALL",
    ),
    Query(
        "precipitable_water",
        "model_name:s time:t water:p saturation_water:p saturation_fraction:p",
        precipitable_water,
        "",
        f"""WITH {LEVELS}, q AS (SELECT *, d / 10 AS w, d / 10 / (0.1 + x) AS s FROM lv), a AS (SELECT *, lead(z) {NEXT} - z AS dz, lead(w) {NEXT} AS w1, lead(s) {NEXT} AS s1 FROM q),
        c AS (SELECT model_name, time, iy, ix, sum((w + w1) / 2 * dz) AS water, sum((s + s1) / 2 * dz) AS saturation_water FROM a GROUP BY ALL)
FINAL
SELECT model_name, time, avg(water) AS water, avg(saturation_water) AS saturation_water, avg(water / nullif(saturation_water, 0)) AS saturation_fraction FROM c GROUP BY ALL""",
    ),
    Query(
        "height_integral",
        "model_name:s time:t value:r",
        height_integral,
        "",
        f"""WITH {LEVELS}, a AS (SELECT *, lead(z) {NEXT} - z AS dz, lead(value) {NEXT} AS v1 FROM lv), c AS (SELECT model_name, time, iy, ix, sum((value + v1) / 2 * dz) AS value FROM a GROUP BY ALL)
FINAL
SELECT model_name, time, avg(value) AS value FROM c GROUP BY ALL""",
    ),
    Query("unstable_runs", "model_name:s time:t iy:i ix:i number:l depth:r base:r top:r", unstable_runs, "", f"WITH {RUNS}\nFINAL\nSELECT *, top - base AS depth FROM b"),
    Query(
        "layer_winds",
        "model_name:s time:t iy:i ix:i wind_below:p directional_shear:p",
        layer_winds,
        "",
        f"""WITH {RUNS}, w AS (SELECT m.*, base, top, fmod(degrees(atan2(-u, -v)) + 360, 360) AS dir FROM m JOIN b USING (model_name, time, iy, ix)),
        t AS (SELECT model_name, time, iy, ix, avg(sqrt(u * u + v * v)) FILTER (z < base) AS wind_below, round(max(dir) FILTER (z = top) - max(dir) FILTER (z = base), 9) AS d FROM w GROUP BY ALL)
FINAL
SELECT *, CASE WHEN d >= 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS directional_shear FROM t""",
    ),
    Query("unstable_mask", "model_name:s time:t value:r", unstable_mask, "", UNSTABLE),
    Query(
        "vertical_interpolation",
        "model_name:s time:t level_height:r value:r n:l",
        vertical_interpolation,
        "",
        f"""WITH {LEVELS}, a AS (SELECT *, lead(z) {NEXT} AS z1, lead(value) {NEXT} AS v1, lead(z, 2) {NEXT} AS z2, row_number() {NEXT} AS i FROM lv), t AS (SELECT unnest([-20.0, 150.0, 500.0, 2000.0]) AS level_height)
FINAL
SELECT model_name, time, level_height, avg(value + (v1 - value) / (z1 - z) * (level_height - z)) AS value, count(*) AS n FROM a, t
WHERE z1 IS NOT NULL AND (level_height >= z OR i = 1) AND (level_height < z1 OR z2 IS NULL) GROUP BY ALL""",
    ),
    Query(
        "rain_rates",
        "model_name:s iy:i ix:i time:t value:p",
        rain_rates,
        "field",
        """SELECT model_name, iy, ix, time, value / coalesce(epoch(lead(time) OVER w) - epoch(time), epoch(time) - epoch(lag(time) OVER w)) AS value FROM field WINDOW w AS (PARTITION BY model_name, iy, ix ORDER BY time)""",
    ),
    Query(
        "linear_regrid",
        "model_name:s time:t iy:i ix:i value:r",
        linear_regrid,
        "field",
        f"""WITH {weights_sql("wy", 5, 10.0, "SELECT range AS i, range * 7.0::DOUBLE - 2 AS c FROM range(7)")}, {weights_sql("wx", 8, 10.0, "SELECT range AS i, range * 9.0::DOUBLE AS c FROM range(9)")},
        need AS (SELECT wy.target AS ty, wx.target AS tx, wy.source AS iy, wx.source AS ix, wy.w * wx.w AS w, count(*) OVER (PARTITION BY wy.target, wx.target) AS n FROM wy, wx)
FINAL
SELECT model_name, time, ty AS iy, tx AS ix, CASE WHEN count(*) = max(n) THEN sum(w * value) END AS value FROM field JOIN need USING (iy, ix) GROUP BY ALL""",
    ),
    Query(
        "nearest_regrid",
        "model_name:s time:t iy:i ix:i value:r",
        nearest_regrid,
        "field",
        """WITH ay AS (SELECT range AS ty, ceil(range * 0.75 - 0.5)::INT AS iy FROM range(6)), ax AS (SELECT range AS tx, ceil(range * 0.75 - 0.5)::INT AS ix FROM range(10))
FINAL
SELECT model_name, time, ty AS iy, tx AS ix, value FROM field JOIN ay USING (iy) JOIN ax USING (ix)""",
    ),
    Query(
        "single_point",
        "model_name:s time:t value:r near_edge:b",
        single_point,
        "field",
        """WITH n AS (SELECT *, CASE iy WHEN 1 THEN 0.3 WHEN 2 THEN 0.7 END * CASE ix WHEN 3 THEN 0.4 WHEN 4 THEN 0.6 END AS w FROM field WHERE iy IN (1, 2) AND ix IN (3, 4))
FINAL
SELECT model_name, time, CASE WHEN count(*) = 4 THEN sum(w * value) END AS value, false AS near_edge FROM n GROUP BY ALL""",
    ),
    Query(
        "vector_winds",
        "model_name:s time:t iy:i ix:i variable:s units:s value:r",
        vector_winds,
        "ln field",
        f"""WITH {weights_sql("wy", 5, 10.0, "SELECT range AS i, range * 15.0::DOUBLE AS c FROM range(3)")}, {weights_sql("wx", 8, 10.0, "SELECT range AS i, range * 20.0::DOUBLE AS c FROM range(4)")},
        need AS (SELECT wy.target AS ty, wx.target AS tx, wy.source AS iy, wx.source AS ix, wy.w * wx.w AS w, count(*) OVER (PARTITION BY wy.target, wx.target) AS n FROM wy, wx),
        u AS (SELECT model_name, time, ty AS iy, tx AS ix, CASE WHEN count(*) = max(n) THEN sum(w * (value - 24.9)) END AS u FROM field JOIN need USING (iy, ix) GROUP BY ALL),
        v AS (SELECT l_returnflag AS model_name, date_trunc('month', l_shipdate)::TIMESTAMP AS time, (l_suppkey % 5 % 3)::INT AS iy, (l_partkey % 8 % 4)::INT AS ix, avg(100 * l_discount - 4.7) AS v FROM lineitem GROUP BY ALL),
        b AS (SELECT * FROM u JOIN v USING (model_name, time, iy, ix))
FINAL
SELECT model_name, time, iy, ix, 'wind_speed' AS variable, 'm s-1' AS units, sqrt(u * u + v * v) AS value FROM b UNION ALL
SELECT model_name, time, iy, ix, 'wind_from_direction', 'degrees', fmod(degrees(atan2(-u, -v)) + 360, 360) FROM b""",
    ),
    Query("station_values", "model_name:s time:t station:l value:p", station_values, "field", f"WITH {AT_STATIONS}\nFINAL\nSELECT * FROM at_"),
    Query(
        "station_bias",
        "model_name:s time:t value:r",
        station_bias,
        "field",
        f"WITH {AT_STATIONS}\nFINAL\nSELECT a.model_name, time, avg(a.value - b.value) AS value FROM at_ a JOIN at_ b USING (time, station) WHERE b.model_name = 'A' AND a.model_name <> 'A' GROUP BY ALL",
    ),
    Query(
        "transect",
        "model_name:s time:t point:i place:r value:r",
        transect,
        "field",
        """WITH l AS (SELECT range AS point, ceil(range * 5 / 10.0 - 0.5)::INT AS iy, ceil((4 + range * 7.75) / 10 - 0.5)::INT AS ix, 4 + range * 7.75 AS place FROM range(9))
FINAL
SELECT model_name, time, point, place, value FROM field JOIN l USING (iy, ix)""",
    ),
    Query("rotated_poles", "s_suppkey:l rlat:r rlon:r back_lat:r back_lon:r metres:r", rotated_poles, "", ROTATED),
    Query("box_perturbation", "time:i part:i iy:i ix:i value:r", box_perturbation, "slabs", BOX),
    Query(
        "gaussian_perturbation",
        "time:i part:i iy:i ix:i value:r",
        gaussian_perturbation,
        "slabs",
        f"WITH {smoothing_sql('slabs', 'v=value', 4.0, 16, MIRROR)}\nFINAL\nSELECT s.time, s.part, s.iy, s.ix, s.value - m.v AS value FROM slabs s JOIN m USING (time, part, iy, ix)",
    ),
    Query("power_spectrum", "time:i part:i k:i value:r", power_spectrum, "slabs", SPECTRUM),
    Query("similarity_map", "time:i part:i iy:i ix:i value:r", similarity_map, "slabs", f"WITH {SIMILAR}\nFINAL\nSELECT time, part, iy, ix, value FROM q"),
    Query("mean_similarity", "time:i part:i value:r", mean_similarity, "slabs", f"WITH {SIMILAR}\nFINAL\nSELECT time, part, avg(value) FILTER (inside) AS value FROM q GROUP BY ALL"),
    Query("feature_tracks", "series:i frame:i feature:i track:s lifetime:i initiation:b", feature_tracks, "slabs", features_sql("SELECT *, concat(root_frame, '_', root) AS track FROM tracks")),
    Query("feature_motion", "series:i frame:i ty:i tx:i dy:i dx:i", feature_motion, "slabs", features_sql("SELECT * FROM motion")),
    Query("feature_lineage", "series:i frame:i feature:i event:s others:l", feature_lineage, "slabs", LINEAGE),
    Query("feature_fields", "series:i frame:i iy:i ix:i feature_id:l feature_lifetime:i feature_init:i", feature_fields, "slabs", FIELDS),
    Query("smoothed_slabs", "time:i part:i iy:i ix:i value:r", smoothed_slabs, "slabs", f"WITH {smoothing_sql('slabs', 'v=value', 2.0, 8, CLAMP)}\nFINAL\nSELECT time, part, iy, ix, v AS value FROM m"),
    Query("age_of_air", "lead:i iy:i ix:i age:r", age_of_air, "", AGES),
]
