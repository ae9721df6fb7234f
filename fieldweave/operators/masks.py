"""Masks, subareas and radar quality weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.regrid import rotate_pole


def condition(value: Column, name: str, threshold: float) -> Column:
    """``value`` eq, ne, gt, ge, lt or le ``threshold``; null stays null."""
    tests = {"eq": value == threshold, "ne": value != threshold, "gt": value > threshold, "ge": value >= threshold, "lt": value < threshold, "le": value <= threshold}
    if name not in tests:
        raise ValueError(f"unknown condition {name}")
    return tests[name]


def mask(value: Column, name: str, threshold: float) -> Column:
    """1.0 where the condition holds, else 0.0; a missing value is only "ne"."""
    return F.coalesce(condition(value, name, threshold), F.lit(name == "ne")).cast("double")


def generate_mask(field: DataFrame, name: str, threshold: float) -> DataFrame:
    label = F.concat(F.lit("mask_for_"), F.col("variable"), F.lit(f"_{name}_{threshold:g}"))
    return field.withColumns({"value": mask(F.col("value"), name, threshold), "variable": label, "units": F.lit("1")})


def apply_mask(field: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """``field`` with value kept where the mask (same ``keys``, value) is not 0, else null; also null without a mask."""
    own = masks.select(*keys, F.col("value").alias("__mask"))
    return field.join(own, keys, "left").withColumn("value", F.when(F.col("__mask") != 0, F.col("value"))).drop("__mask")


def trim(field: DataFrame, axes: DataFrame, lower: int, left: int, upper: int, right: int) -> DataFrame:
    """Without so many rows and columns of cells at each edge; ``axes`` has ny and nx of each model, one row a model."""
    inside = F.col("iy").between(lower, F.col("ny") - 1 - upper) & F.col("ix").between(left, F.col("nx") - 1 - right)
    return field.join(axes.select("model_name", "ny", "nx"), "model_name").where(inside).drop("ny", "nx")


def subarea(field: DataFrame, axes: DataFrame, kind: str, extent: tuple[float, float, float, float], poles: DataFrame | None = None) -> DataFrame:
    """``field`` (model_name, iy, ix, ...) within a box of lower and upper latitude, left and right longitude, ends included.

    ``axes`` (model_name, axis, i, c) has the points of each model's axes y and x.
    ``modelrelative``: the box is in the model's own coordinates. ``realworld``: in true
    ones, and both corners are turned to the pole of the model's grid, as of ``poles``
    (model_name, pole_lat, pole_lon; models without a row or with nulls are not rotated).
    Longitudes are brought between -180 and 180, and points found whole turns away. An
    error if a model has no row or no column of points in its box.
    """
    if kind not in ("realworld", "modelrelative"):
        raise ValueError(f"unknown kind of subarea {kind}")
    low, high, left, right = map(float, extent)
    while left < -180:
        left, right = left + 360, right + 360
    while right > 180:
        left, right = left - 360, right - 360
    models = axes.select("model_name").distinct()
    if kind == "realworld" and poles is not None:
        boxes = models.join(poles.select("model_name", "pole_lat", "pole_lon"), "model_name", "left")
        corners = [rotate_pole(F.lit(y), F.lit(x), F.col("pole_lat"), F.col("pole_lon")) for y, x in ((low, left), (high, right))]
        is_turned = F.col("pole_lat").isNotNull() & F.col("pole_lon").isNotNull()
        placed = zip((corners[0][0], corners[1][0], corners[0][1], corners[1][1]), (low, high, left, right), strict=True)
        turned = [F.when(is_turned, c).otherwise(F.lit(plain)) for c, plain in placed]
    else:
        boxes, turned = models, [F.lit(v) for v in (low, high, left, right)]
    boxes = boxes.select("model_name", *(c.alias(f"__{n}") for c, n in zip(turned, ("low", "high", "left", "right"), strict=True)))
    along = F.pmod(F.col("c") - F.col("__left"), F.lit(360.0))
    inside = F.when(F.col("axis") == "y", F.col("c").between(F.col("__low"), F.col("__high"))).otherwise(along <= F.col("__right") - F.col("__left"))
    marked = axes.join(boxes, "model_name").withColumn("__in", inside)
    has = lambda a: F.coalesce(F.bool_or(F.when(F.col("axis") == a, F.col("__in"))), F.lit(False))
    checked = marked.groupBy("model_name").agg((has("y") & has("x")).alias("__ok"))
    outside = [r[0] for r in checked.where("NOT __ok").select("model_name").limit(1).collect()]  # of the axes, which are small
    if outside:
        raise ValueError(f"the box lies outside the grid of {outside[0]}")
    points = {a: marked.where((F.col("axis") == a) & F.col("__in")).select("model_name", F.col("i").alias(f"i{a}")) for a in "yx"}
    return field.join(points["y"], ["model_name", "iy"], "left_semi").join(points["x"], ["model_name", "ix"], "left_semi")


def radar_weights(radar: DataFrame, scan: list[str] | None = None) -> DataFrame:
    """``radar`` (scan, iy, ix, value, weight): values of weight under 11 are 0. ``scan``: the columns of one picture, time if not given.

    Weights of a picture that are all under 1 are packed, and stand for round(32 * weight).
    """
    scan = scan or ["time"]
    packed = radar.groupBy(*scan).agg((F.max("weight") < 1).alias("__packed"))
    weight = F.when(F.col("__packed"), F.rint(F.col("weight") * 32)).otherwise(F.col("weight"))
    return radar.join(packed, scan).withColumn("value", F.when(weight < 11, 0.0).otherwise(F.col("value"))).drop("__packed")
