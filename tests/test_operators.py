"""Hand-made cases of the operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.functions import constraints, surface, thermo, units
from fieldweave.operators import align, collapse, distributions, masks, observations, regrid, scores, slabs, tracking, vertical
from fieldweave.sources import ingest, io
from fieldweave.streaming import observations as streams

T = datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scores_of_known_pairs(spark):
    pairs = frame(spark, [(0.0, 1.0)] * 4, "forecast double, observed double")
    row = scores.scores(pairs, []).first()
    assert (row.rmse, row.mae, row.additive_bias, row.pearson) == (1.0, 1.0, -1.0, None)


@pytest.mark.parametrize(
    "observed, forecast, pod, ets",
    [([12, 5, 15, 8], [14, 20, 7, 4], 0.5, 0.0), ([12, 12, 5, 5], [5, 5, 12, 12], 0.0, -1 / 3)],
)
def test_detection(spark, observed, forecast, pod, ets):
    pairs = frame(spark, list(zip(map(float, forecast), map(float, observed))), "forecast double, observed double")
    row = scores.detection(scores.contingency(pairs, [], "gt", [10.0])).first()
    assert row.pod == pod and row.ets == pytest.approx(ets)


def test_detection_without_an_event_is_zero(spark):
    row = scores.detection(scores.contingency(frame(spark, [(1.0, 1.0)], "forecast double, observed double"), [], "gt", [5.0])).first()
    assert row.pod == 0.0 and row.ets is None
    with pytest.raises(ValueError):
        scores.event(F.lit(1), "ge", 1.0)


def test_crps_sees_a_shared_field_as_perfect(spark):
    field = frame(spark, [(0, i, m, 2.0) for i in range(3) for m in range(4)], "time int, iy int, realization int, value double")
    assert scores.crps(field, ["time"], ["time", "iy"]).first().crps == 0.0


def test_rain_rate_takes_the_step_to_the_next_time(spark):
    rows = [("a", T + timedelta(hours=h), v) for h, v in ((0, 1.0), (1, 2.0), (3, 3.0))]
    found = vertical.rain_rate(frame(spark, rows, "s string, time timestamp, value double"), ["s"]).orderBy("time").collect()
    assert [r.value for r in found] == [1 / 3600, 2 / 7200, 3 / 7200]
    with pytest.raises(Exception, match="positive duration"):
        vertical.rain_rate(frame(spark, rows[:1], "s string, time timestamp, value double"), ["s"]).collect()


def test_hour_of_day_is_a_mean_of_means(spark):
    rows = [(T, T + timedelta(minutes=m), 0.0) for m in (0, 10, 20)] + [(T + timedelta(days=1), T + timedelta(days=1), 4.0)]
    cases = frame(spark, rows, "forecast_reference_time timestamp, time timestamp, value double").withColumn("k", F.lit(1))
    assert collapse.by_hour_of_day(cases, ["k"], "MEAN").first().value == 2.0


def test_cases_must_overlap(spark):
    cases = frame(spark, [(T, 0.0, 1.0), (T, 1.0, 1.0)], "forecast_reference_time timestamp, forecast_period double, value double").withColumn("k", F.lit(1))
    with pytest.raises(Exception, match="overlap"):
        collapse.by_validity_time(cases, ["k"], "MEAN").collect()


def test_rolling_gives_full_windows_only(spark):
    rows = [("a", T + timedelta(hours=h), float(h)) for h in range(10)]
    found = collapse.rolling(frame(spark, rows, "s string, time timestamp, value double"), ["s"], "MEAN", 4).orderBy("time").collect()
    assert len(found) == 7 and found[0].time == T + timedelta(hours=1.5) and found[0].value == 1.5


def test_missing_values_are_left_out(spark):
    field = frame(spark, [(1, 1.0), (1, float("nan")), (1, float("inf")), (1, None), (1, 3.0)], "k int, value double").transform(ingest.clean)
    row = field.groupBy("k").agg(*(collapse.aggregate(m, F.col("value")).alias(m) for m in ("MEAN", "MAX", "RANGE"))).first()
    assert (row.MEAN, row.MAX, row.RANGE) == (2.0, 3.0, 2.0)
    assert collapse.proportion(field, ["k"], "gt", 2.0).first().value == 0.5
    marks = field.select(masks.mask(F.col("value"), "ne", 1.0).alias("ne"), masks.mask(F.col("value"), "gt", 1.0).alias("gt")).collect()
    assert [r.ne for r in marks] == [0, 1, 1, 1, 1] and [r.gt for r in marks] == [0, 0, 0, 0, 1]


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        collapse.aggregate("MODE", F.lit(1))
    with pytest.raises(ValueError):
        collapse.aggregate("PERCENTILE", F.lit(1))
    with pytest.raises(ValueError):
        masks.condition(F.lit(1), "about", 1)
    with pytest.raises(ValueError):
        collapse.whole_hours("PT30M")
    with pytest.raises(ValueError):
        constraints.hours(3, 24)
    with pytest.raises(TypeError):
        constraints.area(1, "2", 3, 4)
    with pytest.raises(ValueError):
        units.factors("K", "m")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30), st.sampled_from([0, 10, 50, 90, 100]))
def test_percentile_by_counts_is_exact(spark, values, percent):
    field = frame(spark, [(1, v) for v in values], "k int, value double")
    assert collapse.exact_percentile(field, ["k"], percent).first().value == pytest.approx(np.percentile(values, percent), abs=1e-9)


def test_winds(spark):
    rows = [(0.0, -1.0), (-1.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    found = frame(spark, rows, "u double, v double").select(surface.wind_direction(F.col("u"), F.col("v")).alias("d"), surface.wind_speed(F.col("u"), F.col("v")).alias("s")).collect()
    assert [r.d for r in found] == pytest.approx([0, 90, 180, 270]) and {r.s for r in found} == {1.0}


def test_unit_conversion(spark):
    field = frame(spark, [("Celsius", 0.0), ("K", 1.0), ("Fahrenheit", 32.0)], "units string, value double")
    assert [r.value for r in units.convert_units(field, "K").collect()] == pytest.approx([273.15, 1.0, 273.15])
    with pytest.raises(Exception, match="can't convert"):
        units.convert_units(frame(spark, [("m", 1.0)], "units string, value double"), "K").collect()


def test_formulas_outside_their_range_are_missing(spark):
    hot, dry = thermo.dewpoint_temperature(F.lit(320.0), F.lit(0.5)), thermo.wet_bulb_temperature(F.lit(290.0), F.lit(3.0))
    assert one(spark, hot, dry) == (None, None)


def test_iso_times():
    assert constraints.parse_time("2024-02") == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999999))
    assert constraints.parse_time("2024-02-01T06+01:00")[0] == datetime(2024, 2, 1, 5)
    assert constraints.parse_time("20240201T0630Z")[0] == datetime(2024, 2, 1, 6, 30)
    with pytest.raises(ValueError):
        constraints.parse_time("soon")


def test_area_is_strict_and_wraps(spark):
    cells = frame(spark, [(0.0, 350.0), (0.0, 5.0), (0.0, 100.0), (10.0, 0.0)], "y double, x double")
    assert {(r.y, r.x) for r in cells.where(constraints.area(-10, 10, 340, 20)).collect()} == {(0.0, 350.0), (0.0, 5.0)}
    assert cells.where(constraints.area()).count() == 4


def test_cell_methods(spark):
    schema = "n string, cell_methods array<struct<method:string,coord:string,interval:string,comment:string>>"
    rows = frame(spark, [("p", [("point", "time", None, None)]), ("s", [("sum", "time", "1 hour", None)]), ("none", None)], schema)
    names = lambda c: {r.n for r in rows.where(c).collect()}
    assert names(constraints.cell_methods([])) == {"p", "none"}
    assert names(constraints.cell_methods([], "lightning_flash")) == {"s"}
    assert names(constraints.cell_methods(["sum"], interval="1 hour")) == {"s"}


def test_common_points_need_every_model(spark):
    rows = [("a", t, 1.0) for t in (0, 24, 48)] + [("b", t, 2.0) for t in (24, 48, 72)]
    fields = frame(spark, rows, "model_name string, time int, value double")
    assert {r.time for r in align.common_points(fields, ["time"]).collect()} == {24, 48}
    with pytest.raises(Exception, match="common"):
        align.common_points(fields.where("(model_name = 'a' AND time < 24) OR (model_name = 'b' AND time > 48)"), ["time"]).collect()


def test_a_field_minus_itself_is_nothing(spark):
    rows = [(m, m == "a", i, float(i)) for m in "ab" for i in range(5)]
    fields = frame(spark, rows, "model_name string, is_base boolean, iy int, value double")
    assert {r.value for r in align.difference(fields, ["iy"]).collect()} == {0.0}
    assert {r.value for r in align.pivoted_difference(fields, ["iy"], "b").collect()} == {0.0}


def axis(spark, points):
    return frame(spark, list(enumerate(map(float, points))), "i int, c double")


def test_regridding_onto_itself_changes_nothing(spark):
    cells = frame(spark, [(0, y, x, float(3 * y + x * x)) for y in range(4) for x in range(5)], "t int, iy int, ix int, value double")
    axes = axis(spark, range(4)), axis(spark, range(5))
    found = regrid.regrid_onto(cells, axes, axes, ["t"])
    assert {(r.iy, r.ix): r.value for r in found.collect()} == {(y, x): float(3 * y + x * x) for y in range(4) for x in range(5)}


def test_a_missing_neighbour_makes_a_missing_value(spark):
    cells = frame(spark, [(0, y, x, None if (y, x) == (0, 1) else 1.0) for y in range(2) for x in range(3)], "t int, iy int, ix int, value double")
    found = regrid.regrid_onto(cells, (axis(spark, range(2)), axis(spark, range(3))), (axis(spark, [0, 1]), axis(spark, [0.5, 2])), ["t"])
    assert {(r.iy, r.ix): r.value for r in found.collect()} == {(0, 0): None, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}


def test_a_place_outside_the_domain(spark):
    cells = frame(spark, [(0, y, x, 1.0) for y in range(3) for x in range(3)], "t int, iy int, ix int, value double")
    axes = axis(spark, range(3)), axis(spark, range(3))
    with pytest.raises(ValueError, match="outside"):
        regrid.single_point(cells, axes, 9, 1, ["t"])
    with pytest.raises(ValueError, match="leaves"):
        regrid.transect(cells, axes, (0, 0), (5, 1), 3, ["t"])
    assert regrid.interpolate_to_stations(cells, axes, frame(spark, [(1, 9.0, 1.0)], "station int, y double, x double"), ["t"]).count() == 0


def test_rotated_pole_round_trip_and_distance(spark):
    lat, lon = regrid.rotate_pole(F.lit(50.0), F.lit(-3.0), 37.5, 177.5)
    back = regrid.unrotate_pole(lat, lon, 37.5, 177.5)
    assert one(spark, *back) == pytest.approx((50.0, -3.0))
    assert one(spark, *regrid.rotate_pole(F.lit(52.5), F.lit(-2.5), 37.5, 177.5)) == pytest.approx((0.0, 0.0), abs=1e-9)
    metres = regrid.haversine(F.lit(51.5072), F.lit(-0.1276), F.lit(-26.2056), F.lit(28.0337))
    assert one(spark, metres)[0] == pytest.approx(9_068_670, abs=20_000)


def test_layers(spark):
    rows = [(1, float(z), m) for z, m in enumerate([0, 1, 1, 0, 1, 1, 0, 1])] + [(2, float(z), 0) for z in range(3)]
    found = {r.c: r for r in vertical.layers(frame(spark, rows, "c int, level_height double, mask int"), ["c"]).collect()}
    assert (found[1].number, found[1].depth, found[1].base) == (3, 1.0, 1.0)
    assert (found[2].number, found[2].depth, found[2].base) == (0, None, None)
    with pytest.raises(Exception, match="0 or 1"):
        vertical.layers(frame(spark, [(1, 0.0, 2)], "c int, level_height double, mask int"), ["c"]).collect()


def test_vertical_interpolation_extends_the_ends(spark):
    column = frame(spark, [(1, 0.0, 0.0), (1, 10.0, 20.0), (1, 20.0, 30.0)], "c int, z double, value double")
    found = {r.z: r.value for r in vertical.interpolate(column, ["c"], "z", [-5, 0, 5, 15, 40]).collect()}
    assert found == {-5.0: -10.0, 0.0: 0.0, 5.0: 10.0, 15.0: 25.0, 40.0: 50.0}


def test_histogram_keeps_the_greatest_value(spark):
    field = frame(spark, [(1, v) for v in (0.0, 0.5, 1.0, None)], "k int, value double")
    found = distributions.histogram(field, ["k"], 4).orderBy("bin").collect()
    assert [r.n for r in found] == [1, 0, 1, 1] and sum(r.density * 0.25 for r in found) == pytest.approx(1)
    assert distributions.histogram(field.where("false"), ["k"], 4).count() == 0


def test_spectrum_of_a_constant_field_is_nothing(spark):
    cells = frame(spark, [(t, y, x, 5.0) for t in range(2) for y in range(4) for x in range(6)], "t int, iy int, ix int, value double")
    found = slabs.power_spectrum(cells, ["t"]).collect()
    assert len(found) == 6 and all(r.value == pytest.approx(0, abs=1e-12) or r.k == 1 for r in found)


def test_smoothing_a_constant_and_similarity_to_itself(spark):
    cells = frame(spark, [(0, y, x, float(y * x % 7)) for y in range(14) for x in range(13)], "t int, iy int, ix int, value double")
    flat = slabs.perturbation(cells.withColumn("value", F.lit(3.0)), ["t"], 2).collect()
    assert max(abs(r.value) for r in flat) < 1e-12
    pairs = cells.select("t", "iy", "ix", F.col("value").alias("base"), F.col("value").alias("other"))
    assert slabs.mean_similarity(pairs, ["t"]).first().value == pytest.approx(1)


def test_a_moving_square_keeps_its_track(spark):
    def inside(t, y, x):
        return 2 + t <= y <= 5 + t and 2 + t <= x <= 5 + t

    cells = frame(spark, [(0, t, y, x, float(inside(t, y, x))) for t in range(3) for y in range(10) for x in range(10)], "series int, frame int, iy int, ix int, value double")
    found = tracking.track(tracking.features(cells, ["series", "frame"], 0.5), ["series"]).orderBy("frame").collect()
    assert [r.lifetime for r in found] == [1, 2, 3] and len({r.track for r in found}) == 1 and [r.initiation for r in found] == [True, False, False]


def brute_tracks(frames, overlap, retain, nbhood):
    """{(frame, feature): (track, lifetime, initiation)} of frames, each {feature: set of cells}."""
    out, old = {}, {}
    for t, here in enumerate(frames):
        follows = {}
        for f, cells in sorted(here.items()):
            near = [(-len(cells & other), p) for p, other in old.items() if len(cells & other) and len(cells & other) >= overlap * min(len(cells), len(other))]
            if near:
                follows[f] = min(near)
        heir = {}
        for f, (shared, p) in sorted(follows.items()):
            if p not in heir or (shared, f) < heir[p]:
                heir[p] = (shared, f)
        for f in here:
            p = follows[f][1] if f in follows else None
            goes_on = p is not None and heir[p][1] == f
            track, life = out[t - 1, p][:2] if p is not None else (None, 0)
            out[t, f] = (track if goes_on else f"{t}_{f}", life + 1 if goes_on or (p is not None and retain) else 1, None)
        grown = {c for f, cells in here.items() if out[t, f][1] > 1 for c in cells}
        for f, cells in here.items():
            cy, cx = (sum(c[i] for c in cells) / len(cells) for i in (0, 1))
            close = any((y - cy) ** 2 + (x - cx) ** 2 <= nbhood**2 for y, x in grown)
            out[t, f] = (*out[t, f][:2], out[t, f][1] == 1 and not close)
        old = here
    return out


@pytest.mark.parametrize("retain, nbhood", [(True, 5), (False, 2)])
def test_tracks_that_split_and_spawn(spark, retain, nbhood):
    rng, frames = np.random.default_rng(4), []
    for t in range(7):
        field = np.zeros((20, 24), bool)
        for k in range(6):
            y, x = (3 + 5 * (k % 3) + t // 2) % 17, (2 + 7 * (k // 3) + t) % 21
            field[y : y + 3, x : x + 4] |= rng.random() < 0.85
        field[:, 8 + t] &= rng.random(20) < 0.3  # cuts features apart
        labels = slabs.connected_areas(field)
        frames.append({int(f): {(int(y), int(x)) for y, x in zip(*np.nonzero(labels == f))} for f in np.unique(labels[labels > 0])})
    rows = [(0, t, f, y, x) for t, here in enumerate(frames) for f, cells in here.items() for y, x in cells]
    found = tracking.track(frame(spark, rows, "series int, frame int, feature int, iy int, ix int"), ["series"], 0.3, retain, nbhood, reach=0).collect()
    wanted = brute_tracks(frames, 0.3, retain, nbhood)
    assert {(r.frame, r.feature): (r.track, r.lifetime, r.initiation) for r in found} == wanted
    assert any(life > 2 for _, life, _ in wanted.values())
    assert len({track for track, _, _ in wanted.values()}) > 5 and {init for _, _, init in wanted.values()} == {True, False}


def test_connected_areas_join_round_corners():
    inside = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [1, 0, 1, 0]], bool)
    assert len(np.unique(slabs.connected_areas(inside))) == 4


def test_age_of_air_in_a_steady_wind(spark):
    rows = [(t, y, x, [3.0], [0.0], [0.0], [0.0]) for t in range(4) for y in range(2) for x in range(5)]
    winds = frame(spark, rows, "lead int, iy int, ix int, us array<double>, vs array<double>, ws array<double>, zs array<double>")
    spacing = frame(spark, [(y, x, 3 * 3600.0, 1e9) for y in range(2) for x in range(5)], "iy int, ix int, dx double, dy double")
    found = {(r.lead, r.ix): r.age for r in tracking.age_of_air(winds, spacing, 2, 5, 1.0, 0, 3).where("iy = 0").collect()}
    assert found[(3, 0)] == 0.0 and found[(3, 1)] == 1.0 and found[(3, 4)] == 3.0 and found[(1, 4)] == 1.0
    around = tracking.age_of_air(winds, spacing, 2, 5, 1.0, 0, 3, cyclic=True)
    assert {(r.lead, r.age) for r in around.collect()} == {(1, 1.0), (2, 2.0), (3, 3.0)}


def test_grid_spacing_looks_back_at_the_edge(spark):
    places = frame(spark, [(y, x, float(y), float(x)) for y in range(2) for x in range(3)], "iy int, ix int, lat double, lon double")
    found = {(r.iy, r.ix): (r.dx, r.dy) for r in tracking.grid_spacing(places).collect()}
    degree = 6_378_000 * np.pi / 180
    assert found[(0, 2)] == pytest.approx((degree, degree)) and found[(1, 0)][0] < degree


def test_difference_on_another_grid(spark):
    rows = [("a", True, "v", y, x, float(10 * x)) for y in range(2) for x in range(3)] + [("b", False, "v", y, x, float(5 * x + 1)) for y in range(2) for x in range(5)]
    fields = frame(spark, rows, "model_name string, is_base boolean, variable string, iy int, ix int, value double")
    y = axis(spark, range(2))
    found = align.regridded_difference(fields, (y, axis(spark, [0, 2, 4])), (y, axis(spark, range(5))), [])
    assert found.count() == 10 and {r.value for r in found.collect()} == {1.0}
    same = align.regridded_difference(fields.where("ix < 3"), (y, axis(spark, range(3))), (y, axis(spark, range(3))), [], same_grid=True)
    assert same.count() == 6 and {r.value for r in same.collect()} == {1.0, -4.0, -9.0}


def test_rain_depths_become_rates_and_others_pass(spark):
    rows = [("rainfall_amount", "cm", T + timedelta(hours=h), 0.36) for h in range(2)] + [("rainfall_rate", "kg m-2 s-1", T, 5.0), ("air_temperature", "m", T, 1.0)]
    found = vertical.rainfall_to_rate(frame(spark, rows, "variable string, units string, time timestamp, value double").withColumn("k", F.lit(1)), ["k"])
    assert sorted((r.variable, r.units, round(r.value, 9)) for r in found.collect()) == [
        ("air_temperature", "m", 1.0), ("rainfall_amount", "kg m-2 s-1", 0.001), ("rainfall_amount", "kg m-2 s-1", 0.001), ("rainfall_rate", "kg m-2 s-1", 5.0)
    ]


def test_metadata_projections(spark):
    fields = frame(spark, [("v", {"a": "1", "b": "2"}, 1, 1.0), ("v", {"b": "2"}, 1, 2.0)], "variable string, attributes map<string,string>, height int, value double")
    assert io.rename(fields, "w").first().variable == "w"
    assert io.remove_attributes(fields, ["a", "zz"]).first().attributes == {"b": "2"}
    assert io.remove_constant_columns(fields, ["height", "value", "zz"]).columns == ["variable", "attributes", "value"]
    assert io.select_fields(fields, F.col("value") > 1, F.col("value") > 5).count() == 1
    with pytest.raises(ValueError):
        io.select_fields(fields)
    with pytest.raises(ValueError):
        io.select_fields(fields, F.col("value") > 5)


def test_observations_in_a_window(spark):
    forecasts = frame(spark, [(1, T, 1.0)], "station int, time timestamp, value double")
    reports = frame(spark, [(1, T + timedelta(seconds=s), float(s)) for s in (-1801, -1800, 0, 1800, 1801)], "station int, time timestamp, value double")
    assert sorted(r.observed for r in observations.match_window(forecasts, reports, ["station"]).collect()) == [-1800, 0, 1800]


def test_pseudo_forecasts_lie_within_the_reanalysis(spark):
    hourly = frame(spark, [("v", T + timedelta(hours=h), float(h)) for h in range(25)], "variable string, time timestamp, value double")
    from datetime import timezone

    at = lambda h: (T + timedelta(hours=h)).replace(tzinfo=timezone.utc)
    found = observations.pseudo_forecasts(hourly, at(0), at(24), 6, 12).collect()
    assert {r.forecast_reference_time.hour for r in found} == {0, 6, 12} and len(found) == 39 and max(r.forecast_period for r in found) == 12
    with pytest.raises(ValueError, match="no cycle"):
        observations.pseudo_forecasts(hourly, at(48), at(60), 6, 12)


def test_reports_are_coded_and_deduped(spark):
    rows = [("k", 1, 5.0), ("k", 3, 7.0), ("j", 2, 1.0)]
    found = {r.key: r.obs for r in observations.keep_last(frame(spark, rows, "key string, pos int, obs double"), ["key"], "pos").collect()}
    assert found == {"k": 7.0, "j": 1.0}
    assert one(spark, observations.report_time(F.lit(20010101), F.lit(305)), observations.message_type(F.lit("AIREP"), F.lit(3)), observations.message_type(F.lit(None).cast("string"), F.lit(3))) == (datetime(2001, 1, 1, 0, 3, 5), "AIRCFT", "3")


def test_sources(spark, tmp_path):
    for name, v in (("a", 1.0), ("b", 2.0)):
        frame(spark, [("t", v)], "variable string, value double").write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / n) for n in "ab"]
    fields = io.read_fields(spark, paths, ["one", "two"])
    assert {(r.model_name, r.is_base, r.value) for r in fields.collect()} == {("one", True, 1.0), ("two", False, 2.0)}
    with pytest.raises(ValueError):
        io.read_fields(spark, paths, ["one"])
    with pytest.raises(ValueError, match="more than one"):
        io.one_field(fields)
    io.write_field(fields, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(TypeError):
        io.combine(fields, 3)


def test_report_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("SHID YR MN DY HR MI  TT\n'A 1'  2001 1 2 3 4 10.0\n")
    row = io.read_surface_reports(spark, str(tmp_path / "in.txt")).first()
    assert (row.SHID, row.vld, row.TT) == ("A 1", datetime(2001, 1, 2, 3, 4), 283.15)
    reports = frame(spark, [("ADPSFC", datetime(2001, 1, 1, 1), None, 40.0)], "kind string, time timestamp, level double, obs double")
    io.write_point_reports(reports, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["ADPSFC\t20010101_0100\tNA\t40.0"]


def test_ingest_steps(spark):
    rows = frame(spark, [({"uuid": "1", "um_stash_source": "['m02s01i001', 'm01s01i001']", "keep": "x", "geospatial_lat_min": "1", "geospatial_lat_max": "3"}, None)], "attributes map<string,string>, y double").withColumn("x", F.lit(1.0))
    row = rows.transform(ingest.drop_file_attributes).transform(ingest.coordinates_from_attributes).first()
    assert "uuid" not in row.attributes and row.attributes["um_stash_source"] == "m01s01i001,m02s01i001" and row.y == 2.0
    levels = frame(spark, [("air_pressure", "Pa", 85000.0), ("model_level_number", "1", 3.0)], "level_type string, level_units string, level double").transform(ingest.pressure_levels).collect()
    assert [(r.level_type, r.level) for r in levels] == [("pressure", 850.0), ("model_level_number", 3.0)]


def test_stream_means_equal_batch_means(spark, tmp_path):
    rows = [("a", T + timedelta(minutes=17 * i), float(i % 7)) for i in range(200)]
    batch = frame(spark, rows, "variable string, time timestamp, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = streams.by_time(stream, ["variable"], "MEAN", "PT6H").writeStream.outputMode("append").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.time, r.value) for r in spark.table("means").collect()}
    wanted = {(r.time, r.value) for r in collapse.by_time(batch, ["variable"], "MEAN", "PT6H").collect()}
    assert got and got <= wanted and len(wanted) - len(got) <= 2


def test_stream_dedupe_keeps_one_report_a_key(spark, tmp_path):
    rows = [("a", T, 1.0), ("a", T + timedelta(minutes=1), 2.0), ("b", T, 3.0)]
    batch = frame(spark, rows, "sid string, time timestamp, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = streams.first_reports(stream, ["sid"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.sid for r in spark.table("firsts").collect()) == ["a", "b"]


def blobs(t, ny=40, nx=70):
    """Two blobs, one that moves further than its own width each frame, one slower the other way."""
    field = np.zeros((ny, nx), bool)
    field[4 + t : 7 + t, 3 + 6 * t : 7 + 6 * t] = True
    field[36 - 2 * t : 39 - 2 * t, 50 - t : 55 - t] = True
    return field


def rows_of(frames):
    return [(0, t, int(y), int(x), 1.0) for t, f in enumerate(frames) for y, x in zip(*np.nonzero(f), strict=True)]


CELLS = "series int, frame int, iy int, ix int, value double"


def test_a_blob_that_outruns_its_width_keeps_its_track(spark):
    cells = frame(spark, rows_of([blobs(t) for t in range(6)]), CELLS)
    found = tracking.features(cells, ["series", "frame"], 0.5)
    tracks = tracking.track(found, ["series"]).collect()
    assert len(tracks) == 12 and len({r.track for r in tracks}) == 2
    assert sorted(r.lifetime for r in tracks) == sorted([1, 2, 3, 4, 5, 6] * 2)
    still = tracking.track(found, ["series"], reach=0).collect()
    assert len({r.track for r in still}) > 2


def test_motion_is_the_shift_of_most_cells_met(spark):
    rng, reach, square = np.random.default_rng(8), 3, 8
    frames = [rng.random((21, 30)) < 0.2 for _ in range(3)]
    found = frame(spark, [(s, t, 1, y, x) for s, t, y, x, _ in rows_of(frames)], "series int, frame int, feature int, iy int, ix int")
    got = {(r.frame, r.ty, r.tx): (r.dy, r.dx) for r in tracking.motion(found, ["series"], reach, square).collect()}
    wanted = {}
    for t, now in enumerate(frames[:-1]):
        late = np.pad(frames[t + 1], reach)
        for ty in range(3):
            for tx in range(4):
                own = np.zeros_like(now)
                own[ty * square : (ty + 1) * square, tx * square : (tx + 1) * square] = now[ty * square : (ty + 1) * square, tx * square : (tx + 1) * square]
                met = [(-int((own & late[reach + dy : reach + dy + 21, reach + dx : reach + dx + 30]).sum()), dy * dy + dx * dx, dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
                if min(met)[0]:
                    wanted[t, ty, tx] = min(met)[2:]
    assert got == wanted and len(got) > 15


def test_lineage_tells_merges_splits_and_ends(spark):
    two, one = np.zeros((8, 20), bool), np.zeros((8, 20), bool)
    two[2:5, 2:6] = two[2:5, 8:12] = True
    one[2:5, 2:12] = True
    other = two.copy()
    other[2:5, 15:19] = True
    frames = [two, one, other, np.zeros((8, 20), bool) | (np.arange(20) > 14) & (np.arange(8) > 1)[:, None] & (np.arange(8) < 5)[:, None]]
    found = tracking.features(frame(spark, rows_of(frames), CELLS), ["series", "frame"], 0.5)
    edges = tracking.links(found, ["series"], reach=2)
    got = sorted((r.frame, r.feature, r.event, r.others) for r in tracking.lineage(found, ["series"], edges).collect())
    assert got == [(0, 2, "accretion", 1), (1, 1, "merge", 2), (1, 1, "split", 2), (2, 1, "dissipation", 0), (2, 2, "dissipation", 0), (2, 3, "initiation", 0)]
    tracks = tracking.track(found, ["series"], edges=edges)
    fields = tracking.feature_fields(found, tracks, ["series"]).collect()
    assert len(fields) == found.count() and {r.feature_id for r in fields} == {1, 2, 3, 4}
    assert {(r.frame, r.feature_id, r.feature_lifetime) for r in fields if r.feature_id == 1} == {(0, 1, 1), (1, 1, 2), (2, 1, 3)}


@pytest.mark.parametrize("tile", [3, 7, 256])
def test_tiles_give_what_whole_fields_give(spark, tile):
    rng = np.random.default_rng(tile)
    fields = [rng.normal(size=(17, 23)), rng.normal(size=(5, 31))]
    rows = [(t, y, x, float(f[y, x])) for t, f in enumerate(fields) for y in range(f.shape[0]) for x in range(f.shape[1])]
    cells = frame(spark, rows, "t int, iy int, ix int, value double").repartition(5)

    def whole(values, taps, edge):
        half = len(taps) // 2
        for axis in (0, 1):
            n = values.shape[axis]
            index = slabs.mirrored(n, half, edge)
            values = sum(w * np.take(values, index[k : k + n], axis) for k, w in enumerate(taps))
        return values

    for found, wanted in (
        (slabs.perturbation(cells, ["t"], 2, tile=tile), [f - whole(f, slabs.gaussian_taps(2), "reflect") for f in fields]),
        (slabs.perturbation(cells, ["t"], 3, gauss=False, tile=tile), [f - whole(f, np.full(3, 1 / 3), "reflect") for f in fields]),
        (slabs.smoothed(cells, ["t"], 1.5, tile=tile), [whole(f, slabs.gaussian_taps(1.5), "nearest") for f in fields]),
    ):
        got = {(r.t, r.iy, r.ix): r.value for r in found.collect()}
        assert len(got) == len(rows) and all(got[t, y, x] == pytest.approx(wanted[t][y, x], abs=1e-12) for t, y, x in got)
    pairs = cells.select("t", "iy", "ix", F.col("value").alias("base"), (F.col("value") * F.col("value") + F.col("ix")).alias("other"))
    maps = [{(r.t, r.iy, r.ix): (r.value, r.inside) for r in slabs.similarity(pairs, ["t"], 0.8, n).collect()} for n in (tile, 1000)]
    assert maps[0].keys() == maps[1].keys() and all(maps[0][k] == pytest.approx(maps[1][k]) for k in maps[0])


@pytest.mark.parametrize("tile", [2, 5, 256])
def test_areas_join_across_tiles(spark, tile):
    rng = np.random.default_rng(11)
    fields = [rng.random((20, 26)) < p for p in (0.45, 0.62)]
    fields.append(np.zeros((9, 9), bool))
    fields[2][::2] = fields[2][:, 0] = True  # a comb: one area
    cells = frame(spark, [(t, int(y), int(x), 1.0) for t, f in enumerate(fields) for y, x in zip(*np.nonzero(f), strict=True)], "t int, iy int, ix int, value double")
    got = {(r.t, r.iy, r.ix): r.feature for r in tracking.features(cells, ["t"], 0.5, min_size=1, tile=tile).collect()}
    wanted = {(t, int(y), int(x)): int(slabs.connected_areas(f)[y, x]) for t, f in enumerate(fields) for y, x in zip(*np.nonzero(f), strict=True)}
    assert got == wanted


def test_axis_search_brackets_and_joins_without_loops(spark):
    places = [0.0, 1.0, 4.0, 4.5, 9.0]
    axis = frame(spark, [(10 - i, c) for i, c in enumerate(places)], "i int, c double").repartition(3)
    targets = [(0, -1.0), (1, 0.0), (2, 0.5), (3, 4.25), (4, 9.0), (5, 11.0), (6, None), (7, float("nan")), (8, 2.5)]
    target = frame(spark, targets, "i long, c double")
    got = {r.target: r.source for r in regrid.weights(axis, target, "Nearest", False).collect()}
    assert got == {1: 10, 2: 10, 3: 8, 4: 6, 8: 9}
    linear = regrid.weights(axis, target)
    sums = {r.target: r.c for r in linear.join(axis.withColumnRenamed("i", "source"), "source").groupBy("target").agg(F.sum(F.col("weight") * F.col("c")).alias("c")).collect()}
    assert sums == pytest.approx({0: -1.0, 1: 0.0, 2: 0.5, 3: 4.25, 4: 9.0, 5: 11.0, 8: 2.5})
    assert regrid.weights(axis.limit(1), target).count() == 0 and regrid.weights(axis.where("false"), target, extrapolate=False).count() == 0
    stations = spark.range(1000).select(F.col("id").alias("station"), (F.col("id") % 9).cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    cells = frame(spark, [(y, x, 1.0) for y in range(6, 11) for x in range(6, 11)], "iy int, ix int, value double")
    plan = regrid.interpolate_to_stations(cells, (axis, axis), stations, [])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_subareas_turn_corners_and_refuse_empty_boxes(spark):
    axes = frame(spark, [(m, a, i, -20.0 + 5 * i + (360 if m == "far" and a == "x" else 0)) for m in ("near", "far") for a in "yx" for i in range(9)], "model_name string, axis string, i int, c double")
    field = frame(spark, [(m, y, x, 1.0) for m in ("near", "far") for y in range(9) for x in range(9)], "model_name string, iy int, ix int, value double")
    got = masks.subarea(field, axes, "modelrelative", (-10, 0, -365, -350)).groupBy("model_name").agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).collect()
    assert {tuple(r) for r in got} == {("near", 2, 4, 3, 6), ("far", 2, 4, 3, 6)}
    poles = frame(spark, [("far", 37.5, 177.5), ("near", None, None)], "model_name string, pole_lat double, pole_lon double")
    lat, lon = one(spark, *regrid.rotate_pole(F.lit(48.0), F.lit(-8.0), 37.5, 177.5)), one(spark, *regrid.rotate_pole(F.lit(58.0), F.lit(4.0), 37.5, 177.5))
    turned = masks.subarea(field.where("model_name = 'far'"), axes.where("model_name = 'far'"), "realworld", (48, 58, -8, 4), poles).agg(F.min("iy"), F.max("iy")).first()
    inside = [i for i in range(9) if lat[0] <= -20 + 5 * i <= lon[0]]
    assert tuple(turned) == (inside[0], inside[-1])
    with pytest.raises(Exception, match="outside the grid"):
        masks.subarea(field, axes, "realworld", (80, 85, 0, 5)).collect()
    with pytest.raises(ValueError):
        masks.subarea(field, axes, "elsewhere", (0, 1, 0, 1))


def test_observations_meet_the_nearest_cell_and_time(spark):
    axes = tuple(frame(spark, [(i, 10.0 * i) for i in range(3)], "i int, c double") for _ in range(2))
    forecasts = frame(spark, [(m, T + timedelta(minutes=20 * k), y, x, float(100 * k + 10 * y + x)) for m in "ab" for k in range(4) for y in range(3) for x in range(3)], "model string, time timestamp, iy int, ix int, value double")
    obs = [(1, 4.9, 5.1, T + timedelta(minutes=10), 1.0), (2, 20.0, 0.0, T + timedelta(minutes=90), 2.0), (3, 20.0, 0.0, T + timedelta(minutes=91), 3.0), (4, -0.1, 0.0, T, 4.0), (5, None, 0.0, T, 5.0), (6, 0.0, 0.0, None, 6.0)]
    reports = frame(spark, [*obs, obs[0]], "station int, y double, x double, time timestamp, value double")
    got = sorted((r.model, r.station, r.iy, r.ix, r.forecast, r.observed) for r in observations.match_nearest(forecasts, reports, axes, ["model"], 1800).collect())
    assert got == [(m, *rest) for m in "ab" for rest in ((1, 0, 1, 1.0, 1.0), (2, 2, 0, 320.0, 2.0))]


def test_scores_say_their_times_and_carry_coordinates(spark):
    rows = [(s, T + timedelta(hours=h), 50.0 + s, float(h), None if h == 5 else float(h + s)) for s in (1, 2) for h in range(6)] + [(3, T, 53.0, None, 1.0)]
    pairs = frame(spark, rows, "station int, time timestamp, lat double, forecast double, observed double")
    got = {r.station: r for r in scores.scores(pairs, ["lat"], {"lat": "station"}).collect()}
    assert set(got) == {1, 2} and got[2].lat == 52.0 and got[2].rmse == 2.0 and got[2].n == 5
    assert (got[1].time_start, got[1].time, got[1].time_end) == (T, T + timedelta(hours=2, minutes=30), T + timedelta(hours=5))
    assert "time_start" not in scores.scores(pairs, ["time"]).columns
    bounds = pairs.withColumns({"time_lower": F.expr("time - INTERVAL 1 HOUR"), "time_upper": F.col("time")})
    assert scores.scores(bounds, []).first().time_start == T - timedelta(hours=1)


@pytest.mark.parametrize("width", [1, 4, 9])
def test_rolling_medians_cross_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(collapse, "BLOCK", 3)
    rng = np.random.default_rng(width)
    values = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 9, 25)]
    series = frame(spark, [(k, T + timedelta(hours=i), v) for k in ("a", None) for i, v in enumerate(values)], "s string, time timestamp, value double").repartition(4)
    for percent, method in ((50, "MEDIAN"), (80, "PERCENTILE")):
        got = sorted(((r.s or "", r.time, r.value) for r in collapse.rolling(series, ["s"], method, width, percent).collect()), key=lambda r: r[:2])
        windows = [[v for v in values[i : i + width] if v is not None] for i in range(len(values) - width + 1)]
        wanted = [(s, T + timedelta(minutes=60 * i + 30 * (width - 1)), float(np.percentile(w, percent)) if w else None) for s in ("", "a") for i, w in enumerate(windows)]
        assert [r[:2] for r in got] == [r[:2] for r in wanted]
        assert all(a == b if b is None else a == pytest.approx(b) for (*_, a), (*_, b) in zip(got, wanted, strict=True))


def test_attributes_that_differ_go(spark):
    a = frame(spark, [(1, {"x": "1", "y": "2", "z": None}), (2, {"x": "1", "y": "2", "z": None})], "k int, attributes map<string,string>")
    b = frame(spark, [(3, {"x": "1", "y": "3", "z": None})], "k int, attributes map<string,string>")
    left, right = ingest.equalise([a, b])
    assert {tuple(sorted(r.attributes)) for r in [*left.collect(), *right.collect()]} == {("x", "z")}
    assert {tuple(sorted(r.attributes)) for f in ingest.equalise([a, a]) for r in f.collect()} == {("x", "y", "z")}
    assert [r.attributes for f in ingest.equalise([a, b.withColumn("attributes", F.lit(None).cast("map<string,string>"))]) for r in f.collect()] == [{}, {}, None]


def test_winds_of_two_grids_need_the_same_units(spark):
    u = frame(spark, [(0, y, x, "m s-1", float(x)) for y in range(2) for x in range(3)], "t int, iy int, ix int, units string, value double")
    v = frame(spark, [(0, y, x, "m s-1", 1.0) for y in range(2) for x in range(5)], "t int, iy int, ix int, units string, value double")
    axis = lambda n, step: frame(spark, [(i, step * i) for i in range(n)], "i int, c double")
    axes = (axis(2, 1.0), axis(3, 2.0)), (axis(2, 1.0), axis(5, 1.0))
    got = {(r.iy, r.ix, r.variable): (r.units, r.value) for r in align.vector_wind(u, v, *axes, ["t"]).collect()}
    assert len(got) == 20 and got[1, 3, "wind_speed"] == ("m s-1", pytest.approx(np.hypot(1.5, 1)))
    assert got[0, 0, "wind_from_direction"] == ("degrees", 180.0)
    with pytest.raises(Exception, match="same units"):
        align.vector_wind(u, v.withColumn("units", F.lit("knots")), *axes, ["t"]).collect()


def test_winds_stay_in_their_buckets(spark):
    cells = frame(spark, [(t, y, 0, 1.0) for t in range(4) for y in range(3)], "lead int, iy int, ix int, us double")
    name, winds = tracking.bucketed(cells, ["lead", "iy", "ix"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cells.repartition(7).join(winds, ["lead", "iy", "ix"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    right = plan[plan.index("SortMergeJoin") :].split("FileScan")[-2]
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" in plan, right
