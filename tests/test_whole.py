"""Queries on tables that a cut would show on: every row of the input counts."""

import duckdb
import numpy as np
import pytest

from fieldweave.jobs.queries import QUERIES
from fieldweave.operators import regrid, tracking

LABELS = {0: 45, 1: 85, 2: 81}


def oracle(name, tables):
    db = duckdb.connect()
    for table, path in tables.items():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    names = [c for c, _ in QUERIES[name].kinds()]
    return db.sql(f"SELECT {', '.join(names)} FROM ({QUERIES[name].oracle()})").fetchall()


def close(found, wanted):
    found, wanted = sorted(map(tuple, found)), sorted(wanted)
    assert len(found) == len(wanted) and [r[:-1] for r in found] == [r[:-1] for r in wanted]
    assert [r[-1] for r in found] == pytest.approx([r[-1] for r in wanted], abs=2e-6)


@pytest.fixture(scope="module")
def vectors(tmp_path_factory, spark):
    path, rng = tmp_path_factory.mktemp("vectors"), np.random.default_rng(5)
    rows = [(100 * label + i, [float(x) for x in rng.normal(size=64)], label) for label, n in LABELS.items() for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def parts(n):
    return [min(40, n - k) for k in range(0, n, 40)]


def test_slabs_hold_every_vector(spark, vectors):
    cells = {(label, part, iy) for label, n in LABELS.items() for part, size in enumerate(parts(n)) for iy in range(size)}
    for name in ("gaussian_perturbation", "smoothed_slabs", "box_perturbation"):
        found = QUERIES[name](spark, vectors).collect()
        assert len(found) == 64 * sum(LABELS.values()) and {(r.time, r.part, r.iy) for r in found} == cells
    tables = {"embeddings": f"{vectors}/embeddings.parquet/*.parquet"}
    for name in ("box_perturbation", "power_spectrum"):
        close(QUERIES[name](spark, vectors).collect(), oracle(name, tables))
    # Label 2's third slab is a single row, which has no ring.
    assert {(r.time, r.part) for r in QUERIES["power_spectrum"](spark, vectors).collect()} == {(t, p) for t, p, _ in cells} - {(2, 2)}
    shared = {(t, p, y) for t, p, y in cells if (t + 1, p, y) in cells}
    assert {(r.time, r.part, r.iy) for r in QUERIES["similarity_map"](spark, vectors).collect()} == shared
    means = {(r.time, r.part): r.value for r in QUERIES["mean_similarity"](spark, vectors).collect()}
    assert set(means) == {(t, p) for t, p, _ in shared} and means[(0, 0)] is not None and means[(1, 2)] is None
    assert {r.series for r in QUERIES["feature_tracks"](spark, vectors).collect()} >= {0, 1}


def brute_age(winds, spacing, ny, nx, hours, level, cyclic):
    """Each seed by itself; None where it comes to a place without winds."""
    ages, seconds = {}, hours * 3600
    for lead, iy, ix in (k for k in winds if k[0] >= 1):
        y, x, k, first, age = float(iy), float(ix), level, None, lead * hours
        for n in range(lead):
            column = winds.get((lead - n, int(y), int(x)))
            if column is None:
                age = None
                break
            us, vs, ws, zs = column
            dx, dy = spacing[iy, ix]
            moved = (zs[k] if first is None else first) - ws[k] * seconds
            first = moved if first is None else first
            y, x = y - vs[k] * seconds / dy, x - us[k] * seconds / dx
            x = x % nx if cyclic else x
            k = int(np.argmin([abs(z - moved) for z in zs]))
            if not (0 <= y < ny and 0 <= x < nx):
                age = n * hours
                break
        ages[lead, iy, ix] = age
    return ages


@pytest.mark.parametrize("cyclic", [False, True])
def test_age_of_air_follows_every_seed(spark, cyclic):
    rng, ny, nx, leads = np.random.default_rng(3), 3, 4, 15
    column = lambda: tuple([float(x) for x in rng.normal(0, s, 3)] for s in (0.5, 0.3, 0.2)) + ([0.0, 500.0, 1500.0],)
    winds = {(t, y, x): column() for t in range(leads) for y in range(ny) for x in range(nx) if rng.random() > 0.02}
    spacing = {(y, x): (5000.0 + 100 * y, 6000.0 + 100 * x) for y in range(ny) for x in range(nx)}
    rows = spark.createDataFrame([(*k, *v) for k, v in winds.items()], "lead int, iy int, ix int, us array<double>, vs array<double>, ws array<double>, zs array<double>")
    sizes = spark.createDataFrame([(*k, *v) for k, v in spacing.items()], "iy int, ix int, dx double, dy double")
    wanted = brute_age(winds, spacing, ny, nx, 1.0, 1, cyclic)
    found = {(r.lead, r.iy, r.ix): r.age for r in tracking.age_of_air(rows, sizes, ny, nx, 1.0, 1, cyclic=cyclic).collect()}
    assert found == wanted
    assert None in wanted.values() and max(a for a in wanted.values() if a is not None) > 8
    few = {(r.lead, r.iy, r.ix): r.age for r in tracking.age_of_air(rows, sizes, ny, nx, 1.0, 1, 2, cyclic).collect()}
    assert set(few) == set(wanted) and None in few.values()


def test_age_of_air_has_every_lead(spark):
    sf = "/root/testdata/sf0.001"
    month = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"
    wanted = duckdb.sql(f"SELECT DISTINCT {month}, l_suppkey % 5, l_partkey % 8 FROM '{sf}/lineitem.parquet' WHERE l_returnflag = 'A' AND {month} >= 1").fetchall()
    found = [(r.lead, r.iy, r.ix) for r in QUERIES["age_of_air"](spark, sf).collect()]
    assert sorted(found) == sorted(wanted) and max(found)[0] > 8


def test_rain_rates_of_every_cell(spark):
    sf = "/root/testdata/sf0.001"
    cells = duckdb.sql(f"SELECT DISTINCT l_returnflag, l_suppkey % 5, l_partkey % 8, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') FROM '{sf}/lineitem.parquet'").fetchall()
    found = QUERIES["rain_rates"](spark, sf).collect()
    assert sorted((r.model_name, r.iy, r.ix, r.time) for r in found) == sorted(cells) and all(r.value > 0 for r in found)


def test_matched_points_of_every_cell_and_member(spark):
    sf = "/root/testdata/sf0.001"
    points = duckdb.sql(f"SELECT DISTINCT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S'), l_suppkey % 5, l_partkey % 8, l_linenumber - 1 FROM '{sf}/lineitem.parquet'").fetchall()
    found = [(r.time, r.iy, r.ix, r.realization) for r in QUERIES["matched_points"](spark, sf).collect()]
    assert sorted(found) == sorted(points)


def test_wind_speeds_count_every_line(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_linenumber > 3").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["wind_speeds"](spark, str(tmp_path)).collect()
    assert len({r.variable for r in found}) == 3
    close([(r.model_name, r.time, r.variable, r.n, r.value) for r in found], oracle("wind_speeds", {"lineitem": f"{tmp_path}/lineitem.parquet/*.parquet"}))


def test_rotated_poles_at_the_seam(spark, tmp_path):
    """Suppliers on the pole's meridian, at -180 beyond the pole, and on the antimeridian, at -180 too."""
    rows = [(k, round(-999.99 + 7.31 * (k // 25 * 37 % 1500), 2)) for k in (*range(875, 60_000, 1800), *range(0, 60_000, 1800))]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["rotated_poles"](spark, str(tmp_path)).collect()
    assert -180 in {r.rlon for r in found} and -180 in {r.back_lon for r in found} and 180 not in {x for r in found for x in (r.rlon, r.back_lon)}
    close(found, oracle("rotated_poles", {"supplier": f"{tmp_path}/supplier.parquet/*.parquet"}))


def test_many_stations_of_one_box(spark):
    """Over 1,024 stations in one box, beside missing and null cells; no row of a station and field is grouped again."""
    rng, cells = np.random.default_rng(3), {(t, y, x): float(10 * t + 3 * y + x * x) for t in range(3) for y in range(3) for x in range(3)}
    del cells[1, 0, 0]
    cells[2, 1, 1] = None
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0.01, 0.99, (3000, 2)))] + [(3000, 1.0, 1.0), (3001, 2.0, 1.5), (3002, 0.0, 0.0), (3003, 2.1, 1.0), (3004, None, 1.0)]
    axis = spark.createDataFrame([(i, float(i)) for i in range(3)], "i int, c double")
    field = spark.createDataFrame([(*k, v) for k, v in cells.items()], "t int, iy int, ix int, value double")
    found = regrid.interpolate_to_stations(field, (axis, axis), spark.createDataFrame(places, "station long, y double, x double"), ["t"])
    wanted = {}
    for t in range(3):
        for i, y, x in (p for p in places if p[1] is not None and p[1] <= 2):
            near = {(j, k): (1 - abs(y - j)) * (1 - abs(x - k)) for j in range(3) for k in range(3) if abs(y - j) < 1 and abs(x - k) < 1}
            if any((t, *c) in cells for c in near):
                values = [cells.get((t, *c)) for c in near]
                wanted[t, i] = None if None in values else sum(w * v for w, v in zip(near.values(), values, strict=True))
    rows = {(r.t, r.station): r.value for r in found.collect()}
    assert rows.keys() == wanted.keys() and found.count() == len(rows) and None in rows.values()
    assert all(rows[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in wanted.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate [" in line and "station#" in line.split("Aggregate [")[1].split("]")[0]]
