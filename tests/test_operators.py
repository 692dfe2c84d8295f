"""Missing values, odd grids and numerical cross-checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.cube import Cube, axis_of, parse_axes
from gridlark.operators import anomaly as an
from gridlark.operators import bioclim, combine, regrid, resample, rolling, select, telemap
from gridlark.operators import reduce as rd
from gridlark.operators.eof import eof


def make(spark, values, dims=("t", "y", "x"), name="v"):
    """A cube from {(coordinates): value}; days since 2000-01-01 as t."""
    rows = [(*k, v) for k, v in values.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{d} {'int' if d in 'te' else 'double'}" for d in dims) + f", {name} double")
    if "t" in dims:
        df = df.withColumn("t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("t")))
    return Cube(df, tuple(dims), (name,))


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(0)
    values = {}
    for t in range(6):
        for y in (60.0, 0.0, -30.0):
            for x in (0.0, 90.0, 180.0, 270.0):
                values[t, y, x] = None if rng.random() < 0.25 or y == 0.0 and x == 90.0 else float(rng.normal())
    values[0, 60.0, 0.0] = float("nan")
    return Cube.of(make(spark, values).df), {k: (math.nan if v is None else v) for k, v in values.items()}


def array(values):
    return np.array([[[values[t, y, x] for x in (0.0, 90.0, 180.0, 270.0)] for y in (60.0, 0.0, -30.0)] for t in range(6)])


def test_reductions_skip_missing_values(holes):
    cube, values = holes
    a = array(values)
    got = {(r["y"], r["x"]): r["v"] for r in rd.reduce(cube, "std", "t").df.collect()}
    with np.testing.suppress_warnings() as quiet:
        quiet.filter(RuntimeWarning)
        want = np.nanstd(a, axis=0)
    for i, y in enumerate((60.0, 0.0, -30.0)):
        for j, x in enumerate((0.0, 90.0, 180.0, 270.0)):
            assert (got[y, x] is None) if math.isnan(want[i, j]) else abs(got[y, x] - want[i, j]) < 1e-12
    sums = {(r["y"], r["x"]): r["v"] for r in rd.reduce(cube, "sum", "t").df.collect()}
    assert sums[0.0, 90.0] == 0.0


def test_weighted_mean_masks_its_weights(holes):
    cube, values = holes
    a, w = array(values), np.cos(np.radians([60.0, 0.0, -30.0]))[None, :, None]
    mask = ~np.isnan(a)
    want = np.nansum(a * w, axis=(1, 2)) / (mask * w).sum(axis=(1, 2))
    got = [r["v"] for r in rd.reduce(cube, "ave", "xy").df.orderBy("t").collect()]
    assert np.allclose(got, want)
    (row,) = rd.reduce(cube, "ave", "txy").df.collect()
    assert abs(row["v"] - want.mean()) < 1e-12
    (joint,) = rd.reduce(cube, "ave", "txy", joint=True).df.collect()
    assert abs(joint["v"] - np.nansum(a * w) / (mask * w).sum()) < 1e-12


def test_anomalies_have_no_mean_and_norms_unit_spread(holes):
    cube, _ = holes
    for r in rd.reduce(an.anomaly(cube, "t"), "mean", "t").df.collect():
        assert r["v"] is None or abs(r["v"]) < 1e-12
    for r in rd.reduce(an.norm(cube, "xy"), "std", "xy").df.collect():
        assert abs(r["v"] - 1) < 1e-9
    flat = cube.with_df(cube.df.withColumn("v", F.lit(3.0)))
    assert {r["v"] for r in an.norm(flat, "t").df.collect()} == {None}


def test_axes_are_required_and_known(holes):
    cube, _ = holes
    with pytest.raises(ValueError):
        rd.reduce(cube, "mean", "")
    with pytest.raises(ValueError):
        rd.reduce(cube, "mean", "z")
    assert parse_axes("txy") == ["t", "x", "y"]
    assert [axis_of(n) for n in ("longitude", "lat", "plev", "Time", "ens", "value")] == ["x", "y", "z", "t", "e", None]


def test_windows_count_rows(spark):
    values = {(t, 0.0, 0.0): float(t) for t in (0, 1, 2, 4, 5)} | {(t, 0.0, 1.0): 1.0 for t in range(6)}
    got = {(r["t"].day - 1, r["x"]): r["v"] for r in rolling.lowpass(make(spark, values), 3).df.collect()}
    assert got[3, 0.0] == 3.0 and got[2, 0.0] == 1.5 and got[0, 0.0] == 0.5 and got[4, 1.0] == 1.0
    gone = rolling.detrend(make(spark, values), 3).df.where("x = 0 and v is null").count()
    assert gone == 1


def test_selection_of_points_positions_and_months(holes):
    cube, values = holes
    point = select.select_point(cube, 100.0, 29.0)
    assert point.dims == ("t",) and point.df.count() == 6
    some = select.subset(cube, select.Domain.parse({"name": "d", "lat": {"start": 2, "end": 2, "system": "indices"}}))
    assert {r["y"] for r in some.df.collect()} == {60.0}
    assert select.subset(some, select.Domain("d", ())) is some
    with pytest.raises(ValueError):
        select.Domain.parse({"name": "d", "lat": {"start": 2, "end": 3}})
    with pytest.raises(ValueError):
        select.check_time(cube, select.Domain.parse({"name": "d", "time": {"start": "1990-01-01", "end": "1991-01-01", "system": "values"}}))


def test_telemap_is_one_at_its_centre(spark):
    rng = np.random.default_rng(3)
    values = {(t, y, x): float(rng.normal()) for t in range(8) for y in (0.0, 10.0) for x in (0.0, 10.0)}
    got = {(r["y"], r["x"]): r["v"] for r in telemap.telemap(make(spark, values), 1.0, 9.0).df.collect()}
    assert abs(got[0.0, 10.0] - 1) < 1e-12 and all(abs(v) <= 1 + 1e-12 for v in got.values())
    series = {c: [values[t, *c] for t in range(8)] for c in got}
    assert abs(got[10.0, 0.0] - np.corrcoef(series[10.0, 0.0], series[0.0, 10.0])[0, 1]) < 1e-12


def test_eof_equals_svd(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(9, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    values = {(t, float(s // 4), float(s % 4)): float(a[t, s]) for t in range(9) for s in range(12)}
    values |= {(t, 9.0, 9.0): 1.0 for t in range(5)}  # lacks steps
    found = eof(make(spark, values), 3)
    c = a - a.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(found.fractions, (s**2 / (s**2).sum())[:3])
    maps = {(r["m"], r["y"], r["x"]): r["value"] for r in found.maps.collect()}
    pcs = {}
    for r in found.pcs.collect():
        pcs.setdefault(r["m"], {})[r["t"]] = r["value"]
    assert len(maps) == 36
    for k in range(3):
        e = np.array([maps[k, float(i // 4), float(i % 4)] for i in range(12)])
        assert abs(np.linalg.norm(e) - 1) < 1e-9 and e[np.abs(e).argmax()] > 0
        assert np.allclose(np.abs(e @ vt[k]), 1)
        assert np.allclose([v for _, v in sorted(pcs[k].items())], c @ e)
    empty = make(spark, {(0, 0.0, 0.0): 1.0})
    assert eof(empty.with_df(empty.df.where("x > 5")), 3).fractions == []


def test_regrid_keeps_constants_and_area_means(spark):
    rng = np.random.default_rng(5)
    values = {(0, y, x): float(rng.normal()) for y in (-60.0, -20.0, 20.0, 60.0) for x in (45.0, 135.0, 225.0, 315.0)}
    cube = make(spark, values)
    out = regrid.regrid(cube, "uniform~80x180")
    assert sorted({(r["y"], r["x"]) for r in out.df.collect()}) == [(-40.0, 90.0), (-40.0, 270.0), (40.0, 90.0), (40.0, 270.0)]
    band = lambda y: math.sin(math.radians(y + 20)) - math.sin(math.radians(y - 20))
    want = sum(values[0, y, x] * band(y) for y in (20.0, 60.0) for x in (45.0, 135.0)) / (2 * (band(20) + band(60)))
    assert abs(out.df.where("y = 40 and x = 90").first()["v"] - want) < 1e-12
    flat = cube.with_df(cube.df.withColumn("v", F.lit(2.5)))
    for grid in ("uniform~.5x90", "gaussian~16", "uniform~-40:2:40x0:4:90"):
        assert all(abs(r["v"] - 2.5) < 1e-9 for r in regrid.regrid(flat, grid).df.collect())
    with pytest.raises(ValueError):
        regrid.regrid(cube, "hexagons~3")


def test_bilinear_values_and_alignment(spark):
    fine = make(spark, {(0, float(y), float(x)): 2.0 * y + x for y in range(5) for x in range(5)})
    coarse = make(spark, {(0, y, x): 2.0 * y + x for y in (0.0, 4.0) for x in (0.0, 4.0)})
    a, b = regrid.align([fine, coarse], "highest")
    assert a is fine and all(abs(r["v"] - 2 * r["y"] - r["x"]) < 1e-9 for r in b.df.collect())
    (row,) = rd.reduce(rd.reduce(combine.diff(a, b), "max", "xy"), "max", "t").df.collect()
    assert abs(row["v"]) < 1e-9
    hole = coarse.with_df(coarse.df.withColumn("v", F.when((F.col("x") == 0) & (F.col("y") == 0), None).otherwise(F.col("v"))))
    assert regrid.interpolate(hole, np.array([2.0]), np.array([2.0])).df.first()["v"] is None


def test_bioclim_wraps_a_year_and_reads_kelvin(spark):
    rows = [(m, 0.0, 0.0, 280.0 + m, 290.0 + m, float(m % 12)) for m in range(12)]
    df = spark.createDataFrame(rows, "m int, y double, x double, lo double, hi double, wet double").withColumn("t", F.make_date(F.lit(2001), F.col("m") + 1, F.lit(1)))
    cube = Cube(df.select("t", "y", "x", "lo", "hi", "wet"), ("t", "y", "x"), ("lo", "hi", "wet"))
    with pytest.raises(ValueError):
        bioclim.world_clim(cube, "lo", "hi", "wet")
    (r,) = bioclim.world_clim(cube, "lo", "hi", "wet", wrap=True).collect()
    assert r["bio12"] == 66.0 and r["bio16"] == 9 + 10 + 11 and r["bio17"] == 0 + 1 + 2 and r["bio5"] == 301.0 and r["bio2"] == 20.0
    assert bioclim.celsius(cube, "lo").df.first()["lo"] < 30


def test_resample_counts_and_fills(spark):
    cube = make(spark, {(t, 0.0, 0.0): 1.0 for t in (0, 1, 10)})
    assert resample.time_resample(cube, "1D", "sum").df.count() == 3
    filled = resample.time_resample(cube, "1D", "sum", fill=True)
    assert filled.df.count() == 11 and filled.df.where("`sum[v]` is null").count() == 8
    months = Cube(spark.sql("SELECT explode(sequence(date'1980-01-15', date'2012-12-15', interval 1 month)) AS t").withColumn("v", F.lit(1.0)), ("t",), ("v",))
    assert resample.time_resample(months, "season").df.count() == 133
    assert resample.time_agg(months, "season").df.count() == 4


def test_arithmetic_and_merges(spark):
    a = make(spark, {(0, 0.0, 0.0): 6.0, (1, 0.0, 0.0): 1.0})
    b = make(spark, {(0, 0.0, 0.0): 3.0, (2, 0.0, 0.0): 0.0})
    assert [r["v"] for r in combine.arithmetic("/", a, b).df.collect()] == [2.0]
    assert combine.arithmetic("/", a, 0.0).df.where("v is not null").count() == 0
    both = combine.merge([a, b.rename({"v": "w"})])
    assert both.df.count() == 3 and both.variables == ("v", "w")
    with pytest.raises(ValueError):
        combine.merge([a, b])
    assert combine.ensemble([a, b]).shape()["e"] == 2


def test_eof_by_iteration_equals_the_decomposition(spark, monkeypatch):
    from gridlark.operators import eof as module

    rng = np.random.default_rng(17)
    values = {(t, float(s), 0.0): float(rng.normal() * (5 if s < 3 else 1) + (3 * math.sin(t) if s % 2 else 0)) for t in range(40) for s in range(15)}
    whole = module.eof(make(spark, values), 3)
    monkeypatch.setattr(module, "MAX_STEPS", 10)
    found = module.eof(make(spark, values), 3)
    assert np.allclose(found.fractions, whole.fractions, atol=1e-8)
    a, b = ({(r["m"], r["y"]): r["value"] for r in f.maps.collect()} for f in (found, whole))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)
    cube = Cube(found.pcs.withColumnRenamed("value", "pcs"), ("t", "m"), ("pcs",))
    apart = module.by_mode(cube)
    assert sorted(apart) == [0, 1, 2] and apart[0].dims == ("t",) and apart[0].size() == 40
    assert module.maps_and_components([cube, apart[0], Cube(found.maps, ("y", "x", "m"), ("value",))])[0][0].dims == ("y", "x", "m")


def test_complete_cubes_are_not_densified(spark):
    cube = make(spark, {(t, y, 0.0): 1.0 for t in range(4) for y in (0.0, 1.0)})
    assert rolling.densify(cube) is cube
    assert rolling.densify(cube.with_df(cube.df.where("y = 0 or day(t) > 1"))).size() == 8


def test_cubes_that_share_no_dimension_do_not_match(spark):
    a = make(spark, {(0, 0.0, 0.0): 6.0})
    with pytest.raises(ValueError):
        combine.diff(rd.reduce(a, "mean", "xy"), rd.reduce(a, "mean", "t"))
    assert combine.diff(a, rd.reduce(a, "mean", "txy")).df.first()["v"] == 0.0
