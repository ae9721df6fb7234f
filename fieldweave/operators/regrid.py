"""Regridding and interpolation by separable weights, transects and rotated poles.

Axes are small tables (one row a row or column of a grid), searched as one sorted array.
A target point's weights on a source axis are a few rows; both axes' weights are joined to the cells on (iy, ix),
and the weighted cells summed. Cells move once, already cut to those a target needs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXIS_MOST = 1_000_000
#: Stations of one box of cells that are joined to its fields in one piece.
STATIONS_AT_ONCE = 1024
#: Degrees that rounding may put a longitude of -180 below 180 (0.1 mm).
SEAM = 1e-9


def axis(cells: DataFrame, index: str, coordinate: str) -> DataFrame:
    """(index, coordinate): the distinct rows or columns of a grid."""
    return cells.select(index, coordinate).distinct()


class AxisSearch:
    """The sorted points of an axis (i, c), and the search among them; an axis is small beside its cells, and of AXIS_MOST points at most."""

    def __init__(self, axis: DataFrame):
        rows = axis.where(F.col("c").isNotNull()).select("i", F.col("c").cast("double").alias("c")).limit(AXIS_MOST + 1).toArrow()
        if rows.num_rows > AXIS_MOST:
            raise ValueError(f"an axis of over {AXIS_MOST} points")
        index, places = (rows.column(c).to_numpy() for c in ("i", "c"))
        order = np.argsort(places, kind="stable")
        self.index, self.places, self.kind = index[order], places[order], axis.schema["i"].dataType
        self.shared = axis.sparkSession.sparkContext.broadcast((self.index.astype(np.int64), self.places))

    def around(self, place: Column) -> Column:
        """The points (i0, c0) and (i1, c1) about ``place``, at the ends the outer two; of a single point both are it; null without a place or a point."""
        shared = self.shared

        @F.pandas_udf("i0 long, c0 double, i1 long, c1 double")
        def search(place: pd.Series) -> pd.DataFrame:
            index, places = shared.value
            t = place.to_numpy(float)
            if not len(places):
                return pd.DataFrame({"i0": [None] * len(t), "c0": None, "i1": None, "c1": None})
            low = np.clip(np.searchsorted(places, t, side="right") - 1, 0, max(len(places) - 2, 0))
            high = np.minimum(low + 1, len(places) - 1)
            return pd.DataFrame({"i0": index[low], "c0": places[low], "i1": index[high], "c1": places[high]})

        return F.when(place.isNotNull() & ~F.isnan(place), search(place))

    def holds(self, place: Column) -> Column:
        return place.between(float(self.places[0]), float(self.places[-1])) if len(self.places) else F.lit(False)

    def nearest(self, place: Column) -> Column:
        """The index of the point nearest to ``place``, the lower one halfway; null outside the axis."""
        near = self.around(place)
        lower = place - near["c0"] <= near["c1"] - place
        return F.when(self.holds(place), F.when(lower, near["i0"]).otherwise(near["i1"])).cast(self.kind)


def weights(source: DataFrame, target: DataFrame, method: str = "Linear", extrapolate: bool = True) -> DataFrame:
    """(target, source, weight) between two axes, both of (i, c).

    Linear: the two neighbours of a target, or beyond the ends the outer two, extended.
    Nearest: the nearer neighbour, the lower one halfway. Without ``extrapolate`` a
    target outside the axis has no rows, nor has any on an axis of one point. Each target
    searches the sorted axis; targets do not move.
    """
    if method not in ("Linear", "Nearest"):
        raise ValueError(f"unknown method {method}")
    axis = AxisSearch(source)
    if len(axis.places) < 2:
        target = target.limit(0)
    found = target.select(F.col("i").alias("target"), F.col("c").cast("double").alias("t")).where("t IS NOT NULL")
    if not extrapolate:
        found = found.where(axis.holds(F.col("t")))
    found = found.withColumn("near", axis.around(F.col("t"))).select("target", "t", F.col("near.i0").cast(axis.kind).alias("i0"), "near.c0", F.col("near.i1").cast(axis.kind).alias("i1"), "near.c1")
    part = (F.col("t") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    if method == "Nearest":
        return found.select("target", F.when(part <= 0.5, F.col("i0")).otherwise(F.col("i1")).alias("source"), F.lit(1.0).alias("weight"))
    both = F.array(F.struct(F.col("i0").alias("source"), (1 - part).alias("weight")), F.struct(F.col("i1").alias("source"), part.alias("weight")))
    return found.select("target", F.explode(both).alias("w")).select("target", "w.source", "w.weight").where("weight <> 0")


def regrid(cells: DataFrame, wy: DataFrame, wx: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, iy, ix, value) on the target grid; null where a cell with weight is null or absent."""
    wide = lambda w, i, s: w.select(F.col("target").alias(f"__{i}"), F.col("source").alias(i), F.col("weight").alias(s), F.count("*").over(Window.partitionBy("target")).alias(f"n{s}"))
    met = cells.join(wide(wy, "iy", "wy"), "iy").join(wide(wx, "ix", "wx"), "ix")
    total = F.sum(F.col("wy") * F.col("wx") * F.col("value"))
    out = met.groupBy(*keep, F.col("__iy").alias("iy"), F.col("__ix").alias("ix")).agg(F.when(F.count("value") == F.max(F.col("nwy") * F.col("nwx")), total).alias("value"))
    return out


def regrid_onto(cells: DataFrame, source_axes: tuple[DataFrame, DataFrame], target_axes: tuple[DataFrame, DataFrame], keep: list[str], method: str = "Linear") -> DataFrame:
    """``cells`` onto another grid; axes are (i, c) tables of y and x."""
    return regrid(cells, weights(source_axes[0], target_axes[0], method), weights(source_axes[1], target_axes[1], method), keep)


def spaced_axis(source: DataFrame, spacing: float) -> DataFrame:
    """(i, c) from the least coordinate of ``source`` on in steps of ``spacing``, the greatest excluded."""
    reach = source.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    n = F.ceil((F.col("hi") - F.col("lo")) / spacing).cast("int")
    return reach.where(n > 0).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "lo").select("i", (F.col("lo") + F.col("i") * spacing).alias("c"))


def single_point(cells: DataFrame, axes: tuple[DataFrame, DataFrame], y: float, x: float, keep: list[str], method: str = "Linear", margin: int = 8, pole: tuple[float, float] | None = None) -> DataFrame:
    """(keep, value, near_edge) at one place; an error outside the domain, after trying the longitude a turn away.

    With ``pole`` (latitude, longitude of the grid's north pole) y and x are true latitude and longitude.
    """
    if pole:
        y, x = cells.sparkSession.range(1).select(*rotate_pole(F.lit(float(y)), F.lit(float(x)), *pole)).first()
    reach = [a.agg(F.min("c"), F.max("c"), F.sort_array(F.collect_list("c"))).first() for a in axes]
    turns = [t for t in (0.0, 360.0, -360.0) if reach[1][0] <= x + t <= reach[1][1]]
    if not turns or not reach[0][0] <= y <= reach[0][1]:
        raise ValueError("the place is outside the domain")
    x += turns[0]
    spark = cells.sparkSession
    point = [spark.range(1).select(F.col("id").cast("int").alias("i"), F.lit(float(c)).alias("c")) for c in (y, x)]
    inside = all(len(r[2]) > 2 * margin and r[2][margin] <= c <= r[2][-1 - margin] for r, c in zip(reach, (y, x), strict=True))
    out = regrid(cells, weights(axes[0], point[0], method), weights(axes[1], point[1], method), keep)
    return out.select(*keep, "value", F.lit(not inside).alias("near_edge"))


def interpolate_to_stations(cells: DataFrame, axes: tuple[DataFrame, DataFrame], stations: DataFrame, keep: list[str], pole: tuple[float, float] | None = None) -> DataFrame:
    """(keep, station, value): bilinear at each of ``stations`` (station, y, x); null outside the domain.

    With ``pole`` (latitude, longitude of the grid's north pole) the stations' y and x are true latitudes and longitudes.

    The field is cut to the boxes of four cells that hold stations, a row a box and field,
    and these are joined to the stations; a result needs no grouping. A box of many
    stations is dealt out in pieces of about STATIONS_AT_ONCE.
    """
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    if pole:
        y, x = rotate_pole(y, x, *pole)
    sides = [AxisSearch(a) for a in axes]
    # As a generated row a place is turned once, whatever filters and columns use it.
    placed = stations.select("station", F.inline(F.array(F.struct(y.alias("y"), x.alias("x"))))).where(sides[0].holds(F.col("y")) & sides[1].holds(F.col("x")) & F.col("station").isNotNull())
    if min(len(side.places) for side in sides) < 2:
        placed = placed.limit(0)
    for side, c in zip(sides, "yx", strict=True):
        placed = placed.withColumn("near", side.around(F.col(c)))
        part = (F.col(c) - F.col("near.c0")) / (F.col("near.c1") - F.col("near.c0"))
        placed = placed.select("*", *(F.col(f"near.i{k}").cast(side.kind).alias(f"i{c}{k}") for k in (0, 1)), (1 - part).alias(f"w{c}0"), part.alias(f"w{c}1")).drop("near")
    box, corners = ["iy0", "ix0"], [(j, k) for j in (0, 1) for k in (0, 1)]
    boxes = placed.groupBy(*box, "iy1", "ix1").agg(F.ceil(F.count("*") / STATIONS_AT_ONCE).cast("int").alias("pieces"))
    spots = F.explode(F.array(*(F.struct(F.col(f"iy{j}").alias("iy"), F.col(f"ix{k}").alias("ix"), F.lit(f"{j}{k}").alias("corner")) for j, k in corners)))
    met = cells.join(boxes.select(*box, "pieces", spots.alias("s")).select(*box, "pieces", "s.*"), ["iy", "ix"])
    there = lambda j, k: F.when(F.col("corner") == f"{j}{k}", F.struct(F.col("value").cast("double").alias("value")))
    fields = met.groupBy(*keep, *box, "pieces").agg(*(F.max(there(j, k)).alias(f"v{j}{k}") for j, k in corners))
    fields = fields.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    dealt = placed.join(boxes.select(*box, "pieces"), box).withColumn("piece", F.pmod(F.xxhash64("station"), F.col("pieces")).cast("int"))
    both = fields.join(dealt.drop("y", "x", "iy1", "ix1", "pieces"), [*box, "piece"])
    weight = {(j, k): F.col(f"wy{j}") * F.col(f"wx{k}") for j, k in corners}
    needed = [(weight[c] != 0) & F.col("v{}{}".format(*c)).isNotNull() for c in corners]
    total = sum(F.when(weight[c] == 0, 0.0).otherwise(weight[c] * F.col("v{}{}.value".format(*c))) for c in corners)
    return both.where(needed[0] | needed[1] | needed[2] | needed[3]).select(*keep, "station", total.alias("value"))


def transect(cells: DataFrame, axes: tuple[DataFrame, DataFrame], start: tuple[float, float], end: tuple[float, float], points: int | None, keep: list[str]) -> DataFrame:
    """(keep, point, place, value) at ``points`` evenly spaced places from ``start`` to ``end`` (y, x): nearest cells.

    Without ``points`` there are as many as the length holds of the least spacing: of both
    axes, or of the one that the transect runs along. place is the coordinate, y or x, that spans more. Ends outside the domain are an error.
    """
    for a, ends in zip(axes, zip(start, end, strict=True), strict=True):
        lo, hi = a.agg(F.min("c"), F.max("c")).first()
        if not all(lo <= c <= hi for c in ends):
            raise ValueError("the transect leaves the domain")
    if points is None:
        gap = lambda a: a.select(F.abs(F.lead("c").over(Window.orderBy("c")) - F.col("c")).alias("g")).agg(F.min("g")).first()[0]
        along = [k for k in (0, 1) if start[k] != end[k]]
        points = int(math.hypot(end[0] - start[0], end[1] - start[1]) / min(gap(axes[k]) for k in along)) if along else 0
    if points < 2:
        raise ValueError("a transect needs two points")
    line = cells.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    at = lambda k: F.lit(float(start[k])) + F.col("i") * ((end[k] - start[k]) / (points - 1))
    near = [weights(axes[k], line.select("i", F.least(at(k), F.lit(float(max(start[k], end[k])))).alias("c")), "Nearest") for k in (0, 1)]
    place = at(0) if abs(end[0] - start[0]) > abs(end[1] - start[1]) else at(1)
    spots = near[0].select(F.col("target").alias("i"), F.col("source").alias("iy")).join(near[1].select(F.col("target").alias("i"), F.col("source").alias("ix")), "i")
    return cells.join(spots.withColumn("place", place), ["iy", "ix"]).select(*keep, F.col("i").alias("point"), "place", "value")


def rotate_pole(lat: Column, lon: Column, pole_lat: float | Column, pole_lon: float | Column) -> tuple[Column, Column]:
    """Latitude and longitude on a grid whose north pole stands at (pole_lat, pole_lon), in degrees; the pole's own meridian is at -180 beyond the pole."""
    tilt = F.radians(F.lit(90.0) - pole_lat)
    y, x = F.radians(lat), F.radians(lon - pole_lon)
    px, py, pz = F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)
    # Turned about the y axis, so that the pole comes to the top, seen from behind it.
    rx, rz = F.cos(tilt) * px - F.sin(tilt) * pz, F.sin(tilt) * px + F.cos(tilt) * pz
    # Spark's atan2 takes -0 for +0, which would put that meridian at 180.
    turned = F.when((py == 0) & (rx > 0), F.lit(-180.0)).otherwise(F.degrees(F.atan2(-py, -rx)))
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rz)))), turned


def unrotate_pole(lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """The inverse of ``rotate_pole``, longitude from -180 on and below 180; within SEAM below 180 it is -180."""
    tilt = F.radians(F.lit(90.0 - pole_lat))
    y, x = F.radians(lat), F.radians(lon)
    rx, py, rz = -F.cos(y) * F.cos(x), -F.cos(y) * F.sin(x), F.sin(y)
    px, pz = F.cos(tilt) * rx + F.sin(tilt) * rz, -F.sin(tilt) * rx + F.cos(tilt) * rz
    found = F.pmod(F.degrees(F.atan2(py, px)) + pole_lon + 180, F.lit(360.0))
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), pz)))), F.when(found > 360 - SEAM, F.lit(0.0)).otherwise(found) - 180


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = 6_378_000.0) -> Column:
    """Metres between two places along a great circle."""
    dy, dx = F.radians(lat1 - lat0) / 2, F.radians(lon1 - lon0) / 2
    a = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * (F.sin(dx) * F.sin(dx))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
