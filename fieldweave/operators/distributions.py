"""Histograms, quantile pairs and two-dimensional frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators.collapse import exact_percentile

BINS = 50
RAIN_RATE_EDGES = [0.0, *(10 ** (k / 10) for k in range(-10, 27))]
RAIN_AMOUNT_EDGES = [0.0, *(0.02 * math.exp(0.1 * k) for k in range(100))]
LIGHTNING_EDGES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
SCATTER_PERCENTS = [1, 5, *range(10, 100, 10), 95, 99]


def equal_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal bin that holds ``value``; the last bin is closed, and floating error can't leave it."""
    return F.least(F.floor(F.try_divide((value - low) * bins, high - low)), F.lit(bins - 1))


def histogram(field: DataFrame, keep: list[str], bins: int = BINS) -> DataFrame:
    """(keep, bin, lower, upper, n, density) in equal bins between the least and greatest value of all groups; empty bins too."""
    reach = field.agg(F.struct(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))).scalar()
    wide = F.col("__r.hi") > F.col("__r.lo")
    low, high = F.when(wide, F.col("__r.lo")).otherwise(F.col("__r.lo") - 0.5), F.when(wide, F.col("__r.hi")).otherwise(F.col("__r.hi") + 0.5)
    placed = field.where("value IS NOT NULL").select(*keep, "value", reach.alias("__r")).select(*keep, equal_bin(F.col("value"), low, high, bins).alias("bin"))
    counts = placed.groupBy(*keep, "bin").agg(F.count("*").alias("n"))
    full = counts.select(*keep).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = full.join(counts, [*keep, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("__r", reach)
    total = F.sum("n").over(Window.partitionBy(*keep)) if keep else F.sum("n").over(Window.partitionBy())
    width = (high - low) / bins
    return out.select(*keep, "bin", (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"), "n", (F.col("n") / (total * width)).alias("density"))


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Index of the bin between ``edges`` that holds ``value``, null outside; the last bin is closed."""
    passed = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= value)) - 1
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(passed, F.lit(len(edges) - 2)))


def edge_histogram(field: DataFrame, keep: list[str], edges: list[float]) -> DataFrame:
    """(keep, bin, n) of values within ``edges``; bins without values are absent."""
    return field.withColumn("bin", edge_bin(F.col("value"), edges)).where("bin IS NOT NULL").groupBy(*keep, "bin").agg(F.count("*").alias("n"))


def contribution(counts: DataFrame, keep: list[str], edges: list[float]) -> DataFrame:
    """(keep, bin, value): what each bin adds to the mean, count * middle / all counts, without the first bin."""
    middles = F.array(*(F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)))
    total = F.sum("n").over(Window.partitionBy(*keep))
    return counts.select(*keep, "bin", (F.col("n") * F.get(middles, F.col("bin")) / total).alias("value")).where("bin > 0")


def quantile_pairs(pairs: DataFrame, percents: list[float], keep: list[str] | None = None) -> DataFrame:
    """(keep, percent, base, other): the same percentiles of both sides of the pairs."""
    keep = keep or []
    sides = pairs.select(*keep, F.explode(F.create_map(F.lit("base"), "base", F.lit("other"), "other")).alias("side", "value"))
    found = exact_percentile(sides, [*keep, "side"], [float(p) for p in percents])
    of = lambda side: F.max_by("value", F.col("side") == side)
    both = found.groupBy(*keep).agg(of("base").alias("b"), of("other").alias("o"))
    labelled = F.arrays_zip(F.array(*(F.lit(float(p)) for p in percents)).alias("percent"), F.col("b").alias("base"), F.col("o").alias("other"))
    return both.select(*keep, F.explode(labelled).alias("e")).select(*keep, "e.percent", "e.base", "e.other")


def hexagons(pairs: DataFrame, gridsize: int = 100, keep: list[str] | None = None) -> DataFrame:
    """(keep, hx, hy, n): pairs counted in hexagons, told by twice the indices of their centres.

    Two lattices of centres, one shifted by half a step both ways; a pair goes to the
    nearer centre, distances across counted three times as heavy as along. All of ``keep`` share the lattices.
    """
    keep = keep or []
    reach = pairs.agg(F.struct(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("base", "other") for n, f in (("lo", F.min), ("hi", F.max))))).scalar()
    rows = int(gridsize / math.sqrt(3))
    ends = lambda c: (F.col(f"__r.lo_{c}"), F.col(f"__r.hi_{c}"))
    unit = lambda c, n, lo, hi: (F.col(c) - lo) * (n / F.when(hi > lo, hi - lo).otherwise(1.0))
    placed = pairs.withColumn("__r", reach).select(*keep, unit("base", gridsize, *ends("base")).alias("x"), unit("other", rows, *ends("other")).alias("y"))
    ax, ay, bx, by = F.rint("x"), F.rint("y"), F.floor("x") + 0.5, F.floor("y") + 0.5
    far = lambda cx, cy: (F.col("x") - cx) * (F.col("x") - cx) + 3 * (F.col("y") - cy) * (F.col("y") - cy)
    first = far(ax, ay) < far(bx, by)
    return placed.select(*keep, (2 * F.when(first, ax).otherwise(bx)).cast("long").alias("hx"), (2 * F.when(first, ay).otherwise(by)).cast("long").alias("hy")).groupBy(*keep, "hx", "hy").agg(F.count("*").alias("n"))
