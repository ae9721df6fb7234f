"""Horizontal slices: smoothing, spectra, structural similarity, labels of connected areas.

Filters work on square tiles with a halo as wide as the filter, so a task holds a tile,
however large the slice; labels are made in tiles too, and joined across their edges. A
spectrum takes whole slices, one a task. Helpers are numpy only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.shared import cut, stored


#: Rows and columns of a tile.
TILE = 256


def dense(pdf: pd.DataFrame, column: str = "value") -> np.ndarray:
    """The slice as a (rows, columns) array; absent cells are NaN."""
    out = np.full((int(pdf["iy"].max()) + 1, int(pdf["ix"].max()) + 1), np.nan)
    out[pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf[column].to_numpy(float)
    return out


def spread(keys: dict, values: np.ndarray, column: str = "value") -> pd.DataFrame:
    iy, ix = np.indices(values.shape)
    return pd.DataFrame({**{k: np.repeat(v, values.size) for k, v in keys.items()}, "iy": iy.ravel(), "ix": ix.ravel(), column: values.ravel()})


def mirrored(n: int, reach: int, edge: str) -> np.ndarray:
    """Indices -reach .. n - 1 + reach folded into the axis: mirrored with the edge cell doubled, or the edge repeated."""
    at = np.arange(-reach, n + reach)
    if edge == "nearest":
        return np.clip(at, 0, n - 1)
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def convolve(padded: np.ndarray, taps: np.ndarray, left: int, halo: int) -> np.ndarray:
    """``padded`` smoothed by ``taps`` along both axes, without its ``halo``; ``left`` taps lie before a cell."""
    for axis in (0, 1):
        moved = np.moveaxis(padded, axis, 0)
        n = len(moved) - 2 * halo
        moved = sum(t * moved[halo - left + i : halo - left + i + n] for i, t in enumerate(taps))
        padded = np.moveaxis(moved, 0, axis)
    return padded


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def box_taps(size: int) -> np.ndarray:
    return np.full(size, 1 / size)


def apply(cells: DataFrame, slab: list[str], function, columns: str) -> DataFrame:
    """``function`` (a slice's frame to a frame) over each slice of ``cells``; ``columns`` of its result beside the slab's keys."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*slab).schema) + ", " + columns
    return cells.groupBy(*slab).applyInPandas(function, schema)


def tiled(cells: DataFrame, slab: list[str], values: list[str], halo: int, function, columns: str, edge: str = "reflect", tile: int = TILE) -> DataFrame:
    """``function`` over each tile of ``tile`` by ``tile`` cells of each slice of ``cells`` (slab, iy, ix, ``values``).

    A cell goes to every tile whose halo reaches it, so it moves (1 + 2 * halo / tile)**2
    times. ``function`` gets the padded arrays of ``values`` (absent cells NaN; beyond the
    slice's edges mirrored, or the edge repeated) and the slice's ny, nx and, for each of
    ``values``, its least and greatest in the slice; it returns arrays without the halo,
    one for each of ``columns`` after iy and ix. A column inside says which cells have no edge within the halo.
    """
    bounds = [f(c).alias(f"__{n}_{c}") for c in values for n, f in (("lo", F.min), ("hi", F.max))]
    sizes = cells.groupBy(*slab).agg((F.max("iy") + 1).alias("__ny"), (F.max("ix") + 1).alias("__nx"), *bounds)
    both = cells.select(*slab, "iy", "ix", *values).join(sizes, slab)

    def reached(c: str, n: str):
        first, last = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
        return F.explode(F.sequence(F.greatest(F.lit(0), first).cast("int"), F.least(F.floor((F.col(n) - 1) / tile), last).cast("int")))

    both = both.withColumn("__ty", reached("iy", "__ny")).withColumn("__tx", reached("ix", "__nx"))
    names = [c.split()[0] for c in columns.split(", ")[2:]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, at = (int(first["__ny"]), int(first["__nx"])), (int(first["__ty"]) * tile, int(first["__tx"]) * tile)
        folded = [mirrored(size, halo, edge)[lo : lo + 2 * halo + min(tile, size - lo)] for size, lo in zip(n, at, strict=True)]
        low = [f.min() for f in folded]
        padded = []
        for c in values:
            window = np.full([f.max() - f.min() + 1 for f in folded], np.nan)
            window[pdf["iy"].to_numpy() - low[0], pdf["ix"].to_numpy() - low[1]] = pdf[c].to_numpy(float)
            padded.append(window[np.ix_(folded[0] - low[0], folded[1] - low[1])])
        out = function(padded, *n, *(first[f"__{b}_{c}"] for c in values for b in ("lo", "hi")))
        frame = spread({k: first[k] for k in slab}, out[0], names[0])
        frame[["iy", "ix"]] += at
        for name, array in zip(names[1:], out[1:], strict=True):
            frame[name] = array.ravel()
        if "inside" in names:
            frame["inside"] = frame["iy"].between(halo, n[0] - 1 - halo) & frame["ix"].between(halo, n[1] - 1 - halo)
        return frame

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*slab).schema) + ", " + columns
    return both.groupBy(*slab, "__ty", "__tx").applyInPandas(run, schema)


def perturbation(cells: DataFrame, slab: list[str], scale: float = 40, gauss: bool = True, tile: int = TILE) -> DataFrame:
    """(slab, iy, ix, value): the field minus its smoothed self, by a Gaussian or a box of size ``scale``."""
    taps = gaussian_taps(scale) if gauss else box_taps(int(scale))
    halo = len(taps) // 2

    def run(padded, *_):
        return [padded[0][halo : len(padded[0]) - halo, halo : padded[0].shape[1] - halo] - convolve(padded[0], taps, halo, halo)]

    return tiled(cells, slab, ["value"], halo, run, "iy int, ix int, value double", tile=tile)


def smoothed(cells: DataFrame, slab: list[str], sigma: float = 2.0, tile: int = TILE) -> DataFrame:
    """(slab, iy, ix, value) smoothed by a Gaussian, edge values repeated."""
    taps = gaussian_taps(sigma)
    halo = len(taps) // 2
    return tiled(cells, slab, ["value"], halo, lambda padded, *_: [convolve(padded[0], taps, halo, halo)], "iy int, ix int, value double", "nearest", tile)


def cosine_matrix(n: int) -> np.ndarray:
    """The orthonormal type-II cosine transform."""
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def spectral_variance(cells: DataFrame, slab: list[str]) -> DataFrame:
    """(slab, ky, kx, ny, nx, value): the variance at each pair of wavenumbers, by two matrix products a slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = dense(pdf)
        ny, nx = values.shape
        f = cosine_matrix(ny) @ values @ cosine_matrix(nx).T
        return spread({k: pdf[k].iloc[0] for k in slab} | {"ny": ny, "nx": nx}, f * f / (ny * nx)).rename(columns={"iy": "ky", "ix": "kx"})

    return apply(cells.select(*slab, "iy", "ix", "value"), slab, run, "ny int, nx int, ky int, kx int, value double")


def power_spectrum(cells: DataFrame, slab: list[str]) -> DataFrame:
    """(slab, k, value): mean variance over rings of wavenumbers; a ring without any is 0.

    Ring k of 1 .. min(ny, nx) - 1 holds pairs, counted from 1, whose distance
    sqrt((ky / ny)^2 + (kx / nx)^2) is from k / (that number) to before the next. A slice
    of a single row or column has no ring.
    """
    each = spectral_variance(cells, slab)
    rings = F.least("ny", "nx") - 1
    y, x = (F.col("ky") + 1) / F.col("ny"), (F.col("kx") + 1) / F.col("nx")
    ring = F.floor(F.sqrt(y * y + x * x) * rings + 1e-12)
    means = each.withColumn("k", ring.cast("int")).where((F.col("k") >= 1) & (F.col("k") <= rings)).groupBy(*slab, "k").agg(F.avg("value").alias("value"))
    every = each.select(*slab, "ny", "nx").distinct().where(rings >= 1).select(*slab, F.explode(F.sequence(F.lit(1), rings.cast("int"))).alias("k"))
    return every.join(means, [*slab, "k"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def similarity(pairs: DataFrame, slab: list[str], sigma: float = 1.5, tile: int = TILE) -> DataFrame:
    """(slab, iy, ix, value, inside): the structural similarity map of base and other; inside is off the border of one radius."""
    taps = gaussian_taps(sigma, 3.5)
    halo = len(taps) // 2
    sample = len(taps) ** 2 / (len(taps) ** 2 - 1)

    def run(padded, ny, nx, low, high, *_):
        x, y = padded
        mx, my, mxx, myy, mxy = (convolve(a, taps, halo, halo) for a in (x, y, x * x, y * y, x * y))
        vx, vy, vxy = sample * (mxx - mx * mx), sample * (myy - my * my), sample * (mxy - mx * my)
        c1, c2 = (0.01 * (high - low)) ** 2, (0.03 * (high - low)) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
        return [found, np.zeros(found.shape, bool)]

    return tiled(pairs, slab, ["base", "other"], halo, run, "iy int, ix int, value double, inside boolean", tile=tile)


def mean_similarity(pairs: DataFrame, slab: list[str], sigma: float = 1.5) -> DataFrame:
    """(slab, value): the mean of the map off the border; null for a slice that is all border."""
    return similarity(pairs, slab, sigma).groupBy(*slab).agg(F.avg(F.when(F.col("inside"), F.col("value"))).alias("value"))


def connected_areas(inside: np.ndarray) -> np.ndarray:
    """Labels from 1 of areas of true cells that touch by an edge; 0 elsewhere. The least cell number spreads until it settles."""
    ny, nx = inside.shape
    far = ny * nx
    label = np.where(inside, np.arange(far).reshape(ny, nx), far)
    while True:
        padded = np.pad(label, 1, constant_values=far)
        least = np.minimum.reduce([label, padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        least = np.where(inside, least, far)
        # A cell's number may itself carry a smaller one by now.
        flat = np.append(least.ravel(), far)
        least = np.where(inside, np.minimum(least, flat[least]), far)
        if (least == label).all():
            break
        label = least
    _, out = np.unique(label, return_inverse=True)
    out = out.reshape(ny, nx)
    return np.where(inside, out + 1, 0)


def area_labels(cells: DataFrame, slab: list[str], tile: int = TILE) -> DataFrame:
    """(slab, iy, ix, area): connected areas of ``cells`` (slab, iy, ix), those inside; area names the area's first cell in reading order.

    Each tile labels its own cells. Labels that touch across tile edges are pairs of a
    graph, as small as the edges, in which the least label is handed on until it settles,
    each round also along what it has reached (so long chains take few rounds).
    """
    own = cells.select(*slab, "iy", "ix").withColumns({"__ty": F.floor(F.col("iy") / tile).cast("int"), "__tx": F.floor(F.col("ix") / tile).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["iy"].min()), int(pdf["ix"].min())
        iy, ix = pdf["iy"].to_numpy(np.int64), pdf["ix"].to_numpy(np.int64)
        inside = np.zeros((iy.max() - y0 + 1, ix.max() - x0 + 1), bool)
        inside[iy - y0, ix - x0] = True
        label = connected_areas(inside)[iy - y0, ix - x0]
        place = (iy << 32) | ix
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, place)
        return pdf.drop(columns=["__ty", "__tx"]).assign(area=least[label])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*slab).schema) + ", iy int, ix int, area long"
    labelled = cut(own.groupBy(*slab, "__ty", "__tx").applyInPandas(run, schema))
    last = lambda c: F.col(c) % tile == tile - 1
    edges = []
    for a, b in (("iy", "ix"), ("ix", "iy")):
        over = labelled.where(last(a)).select(*slab, (F.col(a) + 1).alias(a), b, F.col("area").alias("one"))
        edges.append(over.join(labelled.where(F.col(a) % tile == 0), [*slab, "iy", "ix"]).select(*slab, "one", F.col("area").alias("two")))
    links = stored(edges[0].union(edges[1]).distinct())
    if links.isEmpty():
        return labelled
    links = stored(links.union(links.select(*slab, F.col("two").alias("one"), F.col("one").alias("two"))))
    state = links.groupBy(*slab, F.col("one").alias("node")).agg(F.least(F.min("one"), F.min("two")).alias("root"))
    while True:
        state = stored(state)
        near = links.join(state.select(*slab, F.col("node").alias("two"), "root"), [*slab, "two"]).groupBy(*slab, F.col("one").alias("node")).agg(F.min("root").alias("near"))
        jump = state.select(*slab, F.col("node").alias("root"), F.col("root").alias("far"))
        moved = state.join(near, [*slab, "node"]).join(jump, [*slab, "root"]).select(*slab, "node", "root", F.least("near", "far").alias("new"))
        moved = stored(moved)
        if moved.where("new < root").isEmpty():
            break
        state = moved.select(*slab, "node", F.least("root", "new").alias("root"))
    roots = state.select(*slab, F.col("node").alias("area"), "root")
    return labelled.join(roots, [*slab, "area"], "left").select(*slab, "iy", "ix", F.coalesce("root", "area").alias("area"))
