"""Feature tracking, and the age of air by back-trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators import slabs
from fieldweave.operators.regrid import haversine
from fieldweave.shared import cut, fresh_path, stored


#: Rows and columns of the squares that move together, and cells that one may move in a frame.
SQUARE, REACH = 32, 8


def features(cells: DataFrame, slab: list[str], threshold: float, under: bool = False, min_size: int = 4, tile: int = slabs.TILE) -> DataFrame:
    """(slab, feature, iy, ix): cells of connected areas above (or under) the threshold with ``min_size`` cells or more.

    Features are numbered in the order of their first cells, small ones counted. Only cells
    beyond the threshold move; a field of any size is labelled in tiles.
    """
    beyond = F.col("value") < threshold if under else (F.col("value") > threshold) & ~F.isnan("value")
    labelled = slabs.area_labels(cells.where(beyond), slab, tile)
    areas = labelled.groupBy(*slab, "area").agg(F.count("*").alias("__n"))
    areas = areas.withColumn("feature", F.row_number().over(Window.partitionBy(*slab).orderBy("area"))).where(F.col("__n") >= min_size)
    return labelled.join(areas, [*slab, "area"]).select(*slab, "iy", "ix", "feature")


def motion(found: DataFrame, series: list[str], reach: int = REACH, square: int = SQUARE) -> DataFrame:
    """(series, frame, ty, tx, dy, dx): how far each square of a frame's features moves until the next frame.

    The shift, of at most ``reach`` cells each way, at which most of the square's feature
    cells meet feature cells of the next frame, by cross-correlation (ties: the shortest,
    then the least dy, dx). Squares are worked on side by side, each with the next frame's
    cells up to ``reach`` around it. Squares that meet nothing have no row.
    """
    at = lambda c, d=0: F.floor((F.col(c) + d) / square).cast("int")
    spans = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), at(c, -reach)), at(c, reach)))
    now = found.select(*series, "frame", at("iy").alias("ty"), at("ix").alias("tx"), "iy", "ix", F.lit(False).alias("late"))
    late = found.select(*series, (F.col("frame") - 1).alias("frame"), spans("iy").alias("ty"), "iy", "ix").select(*series, "frame", "ty", spans("ix").alias("tx"), "iy", "ix", F.lit(True).alias("late"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, size = pdf.iloc[0], square + 2 * reach
        grids = np.zeros((2, size, size))
        grids[pdf["late"].to_numpy().astype(int), pdf["iy"].to_numpy() - first["ty"] * square + reach, pdf["ix"].to_numpy() - first["tx"] * square + reach] = 1
        wave = np.fft.rfft2(grids)
        met = np.rint(np.fft.irfft2(np.conj(wave[0]) * wave[1], (size, size))).astype(int)
        steps = np.arange(-reach, reach + 1)
        met = met[np.ix_(steps, steps)].ravel()
        dy, dx = (g.ravel() for g in np.meshgrid(steps, steps, indexing="ij"))
        best = np.lexsort((dx, dy, dy * dy + dx * dx, -met))[0]
        keys = {k: [first[k]] for k in (*series, "frame", "ty", "tx")}
        return pd.DataFrame({**keys, "dy": [dy[best]], "dx": [dx[best]]}) if met[best] else pd.DataFrame({**{k: [] for k in keys}, "dy": [], "dx": []})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.select(*series, "frame", "ty", "tx").schema) + ", dy int, dx int"
    return now.unionByName(late).groupBy(*series, "frame", "ty", "tx").applyInPandas(run, schema)


def links(found: DataFrame, series: list[str], overlap: float = 0.3, reach: int = REACH, square: int = SQUARE) -> DataFrame:
    """(series, frame, feature, parent, shared): features of a frame and of the one before that overlap.

    The features of the frame before are first projected onto the time of the frame: each
    moves by the shift of the square that holds most of its cells (ties: the first one).
    Overlap counts where the shared cells are at least ``overlap`` of the smaller of both.
    With ``reach`` 0 features are compared where they stand.
    """
    keys = [*series, "frame", "feature"]
    places = found
    if reach:
        square_of = {"ty": F.floor(F.col("iy") / square).cast("int"), "tx": F.floor(F.col("ix") / square).cast("int")}
        main = found.withColumns(square_of).groupBy(*keys, "ty", "tx").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "ty", "tx")).alias("m"))
        shifts = main.select(*keys, "m.ty", "m.tx").join(motion(found, series, reach, square), [*series, "frame", "ty", "tx"]).select(*keys, "dy", "dx")
        moved = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        places = found.join(shifts, keys, "left").select(*keys, moved("iy", "dy"), moved("ix", "dx"))
    before = places.select(*series, (F.col("frame") + 1).alias("frame"), F.col("feature").alias("parent"), "iy", "ix")
    shared = found.join(before, [*series, "frame", "iy", "ix"]).groupBy(*series, "frame", "feature", "parent").agg(F.count("*").alias("shared"))
    sizes = found.groupBy(*keys).agg(F.count("*").alias("size"))
    theirs = sizes.select(*series, (F.col("frame") + 1).alias("frame"), F.col("feature").alias("parent"), F.col("size").alias("theirs"))
    met = shared.join(sizes, keys).join(theirs, [*series, "frame", "parent"])
    return met.where(F.col("shared") >= overlap * F.least("size", "theirs")).select(*keys, "parent", "shared")


def followed(edges: DataFrame, series: list[str]) -> DataFrame:
    """``edges`` of each feature to the parent with which it shares most (ties: the least number), and whether it is the one that continues its track."""
    best = lambda by, other: F.row_number().over(Window.partitionBy(*series, "frame", by).orderBy(F.desc("shared"), other))
    return edges.withColumn("__a", best("feature", "parent")).where("__a = 1").withColumn("continues", best("parent", "feature") == 1).drop("__a")


def earliest(nodes: DataFrame, series: list[str]) -> DataFrame:
    """(series, frame, feature, root_frame, root): the first feature before each one, along its parent in the frame before.

    Only the small table of features is followed, by doubling steps.
    """
    state = nodes.select(*series, "frame", "feature", F.when(F.col("parent").isNull(), F.col("frame")).otherwise(F.col("frame") - 1).alias("root_frame"), F.coalesce("parent", "feature").alias("root"))
    while True:
        state = stored(state)
        ahead = state.select(*series, F.col("frame").alias("root_frame"), F.col("feature").alias("root"), F.col("root_frame").alias("__f"), F.col("root").alias("__r"))
        moved = state.join(ahead, [*series, "root_frame", "root"])
        if moved.where("__f <> root_frame").isEmpty():
            return state
        state = moved.select(*series, "frame", "feature", F.col("__f").alias("root_frame"), F.col("__r").alias("root"))


def track(found: DataFrame, series: list[str], overlap: float = 0.3, retain_lifetime_on_split: bool = True, nbhood: int = 5, reach: int = REACH, square: int = SQUARE, edges: DataFrame | None = None) -> DataFrame:
    """(series, frame, feature, track, lifetime, initiation) of ``found`` features (series, frame, feature, iy, ix).

    A feature follows the one of the frame before with which it shares most cells, once
    that is projected onto its time (``links``; ties: the least number). Of several that
    follow one, the one that shares most continues its track; the others are parts split
    off, with tracks of their own, whose lifetime goes on from the feature they left, or
    with ``retain_lifetime_on_split`` false starts at 1. initiation: lifetime 1, and no
    cell of a feature with a longer one within ``nbhood`` cells of the centre. Frames are
    matched in parallel; ``edges`` can be given where they are known.
    """
    keys = [*series, "frame", "feature"]
    edges = links(found, series, overlap, reach, square) if edges is None else edges
    centres = found.groupBy(*keys).agg(F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    follows = cut(centres.join(followed(edges, series).select(*keys, "parent", "continues"), keys, "left"))
    # Tracks and lives are followed together: the same chain, but for parts split off.
    alive = F.col("parent") if retain_lifetime_on_split else F.when(F.col("continues"), F.col("parent"))
    kinds = F.array(F.struct(F.lit(True).alias("life"), alive.alias("parent")), F.struct(F.lit(False).alias("life"), F.when(F.col("continues"), F.col("parent")).alias("parent")))
    roots = earliest(follows.select(*keys, F.inline(kinds)), [*series, "life"])
    lives = roots.where("life").select(*keys, (F.col("frame") - F.col("root_frame") + 1).alias("lifetime"))
    name = F.concat_ws("_", F.col("root_frame"), F.col("root"))
    out = cut(roots.where("NOT life").select(*keys, name.alias("track")).join(lives, keys).join(follows.select(*keys, "cy", "cx"), keys))
    old = found.join(out.where("lifetime > 1").select(*keys), keys).select(*series, "frame", F.col("iy").alias("oy"), F.col("ix").alias("ox"))
    # Cells of a frame in squares as wide as the reach: those near a centre lie in nine of them.
    side = float(max(nbhood, 1))
    near_square = lambda c, d=0: (F.floor(c / side) + d).cast("long")
    around = F.array(*(F.struct(near_square(F.col("cy"), dy).alias("sy"), near_square(F.col("cx"), dx).alias("sx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    fresh = out.where("lifetime = 1").select(*keys, "cy", "cx", F.explode(around).alias("s")).select(*keys, "cy", "cx", "s.sy", "s.sx")
    squares = old.withColumns({"sy": near_square(F.col("oy")), "sx": near_square(F.col("ox"))})
    far = (F.col("oy") - F.col("cy")) * (F.col("oy") - F.col("cy")) + (F.col("ox") - F.col("cx")) * (F.col("ox") - F.col("cx"))
    spawned = fresh.join(squares, [*series, "frame", "sy", "sx"]).where(far <= nbhood * nbhood).select(*keys).distinct().withColumn("__near", F.lit(True))
    done = out.join(spawned, keys, "left")
    return done.select(*keys, "track", "lifetime", ((F.col("lifetime") == 1) & F.col("__near").isNull()).alias("initiation"))


def lineage(found: DataFrame, series: list[str], edges: DataFrame) -> DataFrame:
    """(series, frame, feature, event, others): what became of features, by the ``edges`` between frames.

    initiation: no feature of the frame before leads to it (the series' first frame has
    none). merge: several do. split: it leads to several of the next frame. accretion: it
    leads on, but into tracks of others only. dissipation: it leads to none (the last
    frame has none). others: how many features stand on the other side. A feature can
    have several events.
    """
    keys = [*series, "frame", "feature"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parents = edges.groupBy(*keys).agg(F.count("*").alias("n_parents"))
    earlier = [*series, (F.col("frame") - 1).alias("frame"), F.col("parent").alias("feature")]
    children = edges.select(*earlier).groupBy(*keys).agg(F.count("*").alias("n_children"))
    heirs = followed(edges, series).where("continues").select(*earlier, F.lit(True).alias("heir"))
    span = found.groupBy(*series).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    nodes = found.select(*keys).distinct().join(parents, keys, "left").join(children, keys, "left").join(heirs, keys, "left").join(span, series)
    up, down = zero("n_parents"), zero("n_children")
    cases = (
        ("initiation", (up == 0) & (F.col("frame") > F.col("first")), up),
        ("merge", up > 1, up),
        ("split", down > 1, down),
        ("accretion", (down > 0) & F.col("heir").isNull(), down),
        ("dissipation", (down == 0) & (F.col("frame") < F.col("last")), down),
    )
    events = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("event"), n.alias("others"))) for name, when, n in cases)))
    return nodes.select(*keys, F.inline(events))


def feature_fields(found: DataFrame, tracks: DataFrame, series: list[str]) -> DataFrame:
    """(series, frame, iy, ix, feature_id, feature_lifetime, feature_init) at each cell of a feature; other cells have none.

    feature_id numbers a series' tracks from 1 in the order in which they begin, and stays
    with a feature as long as it is followed.
    """
    keys = [*series, "frame", "feature"]
    begun = tracks.groupBy(*series, "track").agg(F.min(F.struct("frame", "feature")).alias("at"))
    numbered = begun.select(*series, "track", F.row_number().over(Window.partitionBy(*series).orderBy("at")).alias("feature_id"))
    named = tracks.join(numbered, [*series, "track"]).select(*keys, "feature_id", F.col("lifetime").alias("feature_lifetime"), F.col("initiation").cast("int").alias("feature_init"))
    return found.join(named, keys).select(*series, "frame", "iy", "ix", "feature_id", "feature_lifetime", "feature_init")


def grid_spacing(places: DataFrame) -> DataFrame:
    """(iy, ix, dx, dy) in metres from ``places`` (iy, ix, lat, lon): to the next cell, at the edge from the one before."""
    along = lambda part, order: Window.partitionBy(part).orderBy(order)
    near = lambda c, w: F.coalesce(F.lead(c).over(w), F.lag(c).over(w))
    wx, wy = along("iy", "ix"), along("ix", "iy")
    here = (F.col("lat"), F.col("lon"))
    return places.select("iy", "ix", haversine(*here, near("lat", wx), near("lon", wx)).alias("dx"), haversine(*here, near("lat", wy), near("lon", wy)).alias("dy"))


def bucketed(df: DataFrame, keys: list[str]) -> tuple[str, DataFrame]:
    """A table of ``df`` in the shared folder, in buckets of ``keys``, and its name: joins on them don't move it."""
    spark = df.sparkSession
    path = fresh_path(spark)
    name = f"winds_{path.rsplit('/', 1)[-1]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return name, spark.table(name)


def age_of_air(winds: DataFrame, spacing: DataFrame, ny: int, nx: int, hours: float, level: int, steps: int | None = None, cyclic: bool = False) -> DataFrame:
    """(lead, iy, ix, age): whole steps, in hours, that air at ``level`` has been in the domain; all hours since lead 0 if it never came in.

    ``winds`` (lead, iy, ix, us, vs, ws, zs): a row a column and lead, with arrays over
    levels of winds in m s-1 and heights in m; ``spacing`` as of ``grid_spacing``, that of
    the seed's own cell counting all the way. Air is followed back one lead a step: it
    moves by minus the wind, and takes the level whose height is nearest to the height of
    its first step plus the present step's own rise. Places are kept to nine digits of a cell,
    so that air blown forth and back comes to the cell it left. Winds are written once in
    buckets of lead and cell; each step moves only the seeds still under way to the buckets, then is cut; a cyclic domain wraps in x.

    Every column of a lead from 1 on gives a row. Air is followed until none is under
    way, or for ``steps`` steps. The age is null where air comes to a place without winds
    while it is in the domain, and where it is still under way after ``steps``.
    """
    seconds = hours * 3600
    name, winds = bucketed(winds.select("lead", "iy", "ix", "us", "vs", "ws", "zs"), ["lead", "iy", "ix"])
    seeds = winds.where(F.col("lead") >= 1).select("lead", "iy", "ix").join(spacing, ["iy", "ix"], "left")
    seeds = seeds.select(
        F.col("lead").alias("seed_lead"), F.col("iy").alias("seed_iy"), F.col("ix").alias("seed_ix"), "lead", F.col("iy").cast("double").alias("y"), F.col("ix").cast("double").alias("x"), F.lit(level).alias("k"), F.lit(None).cast("double").alias("first"), "dx", "dy"
    )
    done, keys, step = None, ["lead", "iy", "ix"], 0
    seed = ["seed_lead", "seed_iy", "seed_ix"]
    while steps is None or step < steps:
        here = seeds.withColumns({"iy": F.floor("y").cast("int"), "ix": F.floor("x").cast("int")}).join(winds, keys, "left")
        at = lambda c: F.get(c, F.col("k"))
        y, x = F.round(F.col("y") - at("vs") * seconds / F.col("dy"), 9), F.round(F.col("x") - at("us") * seconds / F.col("dx"), 9)
        x = F.pmod(x, F.lit(float(nx))) if cyclic else x
        moved = F.coalesce("first", at("zs")) - at("ws") * seconds
        here = here.withColumns({"y": y, "x": x, "moved": moved, "first": F.coalesce("first", moved)})
        gaps = F.transform("zs", lambda z: F.abs(z - F.col("moved")))
        here = here.withColumn("k", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))
        out = (F.col("y") < 0) | (F.col("y") >= ny) | (F.col("x") < 0) | (F.col("x") >= nx)
        # Without a place the air is lost, unless the other axis alone has left the domain.
        lost = (F.col("y").isNull() | F.col("x").isNull()) & ~F.coalesce(out, F.lit(False))
        here = cut(here.select(*seed, (F.col("lead") - 1).alias("lead"), "y", "x", "k", "first", "dx", "dy", F.coalesce(out, F.lit(False)).alias("out"), lost.alias("lost")))
        age = F.when(F.col("out"), F.lit(step * hours)).when(~F.col("lost"), F.col("seed_lead") * F.lit(hours))
        ended = here.where(F.col("out") | F.col("lost") | (F.col("lead") == 0)).select(*seed, age.alias("age"))
        done = ended if done is None else done.union(ended)
        seeds, step = here.where(~F.col("out") & ~F.col("lost") & (F.col("lead") > 0)).drop("out", "lost"), step + 1
        if seeds.isEmpty():
            break
    winds.sparkSession.sql(f"DROP TABLE {name}")
    left = seeds.select(*seed, F.lit(None).cast("double").alias("age"))
    done = left if done is None else done.union(left)
    return done.select(F.col("seed_lead").alias("lead"), F.col("seed_iy").alias("iy"), F.col("seed_ix").alias("ix"), "age")
