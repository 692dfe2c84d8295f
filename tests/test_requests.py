"""Requests, sources, archives, calendars and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.functions.calendar import bytes_of, months_of, parse_frequency, parse_offset
from gridlark.plans.registry import KERNELS, describe, register
from gridlark.plans.request import Operation, Request, parse_connectors
from gridlark.plans.workflow import Engine
from gridlark.sources.fixtures import month_cube, other_cube
from gridlark.sources.readers import Address, Archive, Catalogue, Policy, parse_rainfall, parse_variables
from gridlark.streaming import resample as streams

SF = "/root/testdata/sf0.001"


def test_month_selectors():
    assert months_of("aug") == months_of(8) == months_of("month=aug") == [8]
    assert months_of("djf") == [12, 1, 2] and months_of("jjas") == [6, 7, 8, 9]
    assert months_of("mam") == [3, 4, 5] and months_of("may") == [5]
    for bad in ("", "13", "xyz", "0"):
        with pytest.raises(ValueError):
            months_of(bad)


def test_offsets_frequencies_and_sizes():
    assert parse_offset("5y,3m,6d") == {"years": 5, "months": 3, "days": 6}
    assert parse_offset("2mi,-3h,4w,1s") == {"mins": 2, "hours": -3, "weeks": 4, "secs": 1}
    assert parse_frequency("t.season") == (1, "Q-FEB") and parse_frequency("6H") == (6, "H")
    assert bytes_of("500M") == 500_000_000 and bytes_of("1.5g") == 1_500_000_000
    with pytest.raises(ValueError):
        parse_offset("5 parsecs")


def test_json_requests():
    import json

    spec = {"domain": [{"name": "d0", "lat": {"start": 0, "end": 50.5, "system": "values"}, "lev": 500}], "variable": [{"uri": "view:m", "name": ["a:v0", "b:v1"]}], "operation": [{"name": "cube.ave", "input": "v0,v1:x", "axes": "xy", "archive": "true", "merge": "min:loss"}]}
    request = Request.parse(json.dumps(spec))
    assert request == Request.parse(spec)
    assert request.operations[0].connectors[0].inputs == ("v0", "v1") and request.operations[0].archive
    assert Operation.parse(json.loads(request.operations[0].serialise())) == request.operations[0]


def test_connectors_and_names():
    assert [(c.inputs, c.output) for c in parse_connectors("v0:a;v1,v2:b", "r")] == [(("v0",), "a"), (("v1", "v2"), "b")]
    assert [(c.inputs, c.output) for c in parse_connectors("v0;v1", "r")] == [(("v0", "v1"), "r")]
    assert parse_variables("tas:v0,pr|v1,hur") == [("tas", "v0"), ("pr", "v1"), ("hur", "hur")]


def test_requests_are_checked():
    ok = {"variable": [{"uri": "view:m", "name": "tas:v0"}], "operation": [{"name": "cube.ave", "input": "v0", "axes": "t"}]}
    Request.parse(ok)
    for change in ({"variable": [{"uri": "view:m", "name": "tas:v9"}]}, {"operation": [{"name": "cube.ave", "input": "v0:v0"}]}, {"variable": [{"uri": "view:m", "name": "tas:v0", "domain": "none"}]}, {"variable": [{"uri": "view:m", "name": "tas:v0", "cache": "perhaps"}]}):
        with pytest.raises(ValueError):
            Request.parse(ok | change)


def test_every_operation_runs(spark):
    sf = "/root/testdata/sf0.01"  # where all cells have all months
    engine = Engine(spark, cubes={"a": month_cube(spark, sf), "b": other_cube(spark, sf)})
    params = {"filter": {"sel": "aug"}, "telemap": {"lat": 0, "lon": 60}, "regrid": {"gridder": "uniform~60x120"}, "cache": {"result": "kept"}, "eof": {"modes": 2}, "worldclim": {}}
    for op in sorted(KERNELS):
        two = {"diff": "v0,w0", "worldclim": "v0,v1,v2"}.get(op, "v0")
        spec = {
            "variable": [{"uri": "view:a", "name": "tas:v0,tasmin:v1,tasmax:v3,pr:v2"}, {"uri": "view:b", "name": "tas:w0"}],
            "operation": [{"name": f"cube.{op}", "input": two, "axes": "" if op in ("filter", "worldclim") else "t", **params.get(op, {})}],
        }
        if op == "worldclim":
            spec["operation"][0] |= {"input": "v1,v3,v2", "minTemp": "v1", "maxTemp": "v3", "moist": "v2"}
        frames = engine.frames(spec)
        assert frames and all(df.limit(1).count() for df in frames.values()), op
    assert spark.table("kept").count() > 0
    with pytest.raises(ValueError):
        engine.run({"variable": [{"uri": "view:a", "name": "tas:v0"}], "operation": [{"name": "telemap", "input": "v0"}]})
    with pytest.raises(KeyError):
        engine.run({"variable": [{"uri": "view:a", "name": "tas:v0"}], "operation": [{"name": "cube.nothing", "input": "v0"}]})


def test_own_operations_can_be_registered(spark):
    @register("double", "twice the value")
    def _(cubes, axes, keys, p):
        return [c.with_df(c.df.withColumns({v: c.value(v) * 2 for v in c.variables})) for c in cubes]

    try:
        engine = Engine(spark, cubes={"a": month_cube(spark, SF)})
        (df,) = engine.frames({"variable": [{"uri": "view:a", "name": "tas:v0"}], "operation": [{"name": "my.double", "input": "v0"}]}).values()
        assert "double[v0]" in df.columns and "time" in df.columns
        assert any(d["name"] == "double" for d in describe())
    finally:
        del KERNELS["double"]
    assert engine.capabilities().count() == len(KERNELS) and engine.metrics().count() == 4


def test_addresses_follow_the_policy():
    assert Address.parse("collection:cip").kind == "collection"
    assert Address.parse("file:///data/x.parquet").path == "/data/x.parquet"
    assert Address.parse("key@archive:a/b").auth == "key"
    with pytest.raises(PermissionError):
        Address.parse("https://data.example.org/x")
    policy = Policy(("dap",), ("data.example.org",))
    assert Address.parse("https://data.example.org/x", policy).path == "https://data.example.org/x"
    for bad in ("https://data.example.org.evil.net/x", "http://x/"):
        with pytest.raises(PermissionError):
            Address.parse(bad, policy)
    with pytest.raises(ValueError):
        Address.parse("gopher:x")


def test_archive_round_trip(spark, tmp_path):
    archive = Archive(str(tmp_path), "proj", "exp")
    cube = month_cube(spark, SF).select("tas")
    archive.save(cube, "r1")
    back = archive.open(spark, "r1")
    assert back.dims == ("t", "y", "x") and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, cube.df.collect()))
    assert archive.path("other/r1").endswith("/proj/other/r1")
    with pytest.raises(ValueError):
        archive.path("../../etc")
    engine = Engine(spark, archive=archive)
    (df,) = engine.frames({"variable": [{"uri": "archive:r1", "name": "tas:v0"}], "operation": [{"name": "cube.max", "axes": "t", "input": "v0"}]}).values()
    assert df.count() == 30


def test_catalogue_prunes_files(spark, tmp_path):
    catalogue = Catalogue(str(tmp_path))
    cube = month_cube(spark, SF).select("tas", "pr")
    records = [f"P;base.path;{tmp_path}", "A;lat;lat;5", "V;tas;time lat lon", "other;x"]
    for year in range(1995, 2002):
        cube.df.where(F.year("t") == year).write.parquet(f"{tmp_path}/{year}.parquet")
        minutes = (datetime.date(year, 1, 1) - datetime.date(1970, 1, 1)).days * 1440
        records.append(f"F;{minutes};1;{year}.parquet")
    (tmp_path / "agg.ag1").write_text("\n".join(records))
    catalogue.write(spark, "coll", {"tas": "agg", "pr": "agg"}, {"title": "test"})
    assert catalogue.collection(spark, "coll") == {"tas": "agg", "pr": "agg"} and catalogue.options["title"] == "test"
    minute = lambda *d: (datetime.date(*d) - datetime.date(1970, 1, 1)).days * 1440
    assert [p[-12:-8] for p in catalogue.files(spark, "agg", minute(1996, 5, 1), minute(1997, 2, 1))] == ["1996", "1997"]
    engine = Engine(spark, catalogue=catalogue)
    (df,) = engine.frames({"variable": [{"uri": "collection:coll", "name": "tas:v0"}], "operation": [{"name": "cube.ave", "axes": "xyt", "input": "v0"}]}).values()
    assert df.count() == 1
    spec = {"domain": [{"name": "d", "time": {"start": "1996-03-01", "end": "1996-12-31", "system": "values"}}], "variable": [{"uri": "collection:coll", "name": "tas:v0", "domain": "d"}], "operation": [{"name": "cube.subset", "input": "v0"}]}
    (df,) = engine.frames(spec).values()
    assert {p.rsplit("/", 2)[-2][:4] for p in df.inputFiles()} == {"1996"} and df.select("time").distinct().count() == 10
    assert sorted(map(tuple, catalogue.listing(spark, "coll").collect())) == [("pr", "agg", 7, 7, "lat:5", None), ("tas", "agg", 7, 7, "lat:5", "time lat lon")]
    with pytest.raises(KeyError):
        catalogue.open(spark, "coll", ["hur"])


def test_rainfall_text(spark):
    line = "1871" + "".join(f"{v:7.1f}" for v in range(1, 13)) + f"{78.0:7.1f}" + " " * 7 + f"{3.0:7.1f}{4.0:7.1f}{5.0:7.1f}"
    df = spark.createDataFrame([("YEAR JAN FEB",), (line,), ("9999   1.0",), (None,), ("",)], "value string")
    got = {(r["t"].month, r["series"]): r["value"] for r in parse_rainfall(df).collect()}
    assert len(got) == 17 and got[3, "month"] == 3.0 and got[6, "ANN"] == 78.0 and got[2, "JF"] is None and got[11, "OND"] == 5.0


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) AS ts, cast(id % 2 AS int) AS k FROM range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = streams.run_available(streams.windowed(stream, "ts", ["k"], {"n": F.count(F.lit(1))}, "6 hours", "3 hours"), f"{tmp_path}/a")
    want = rows.groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "k").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    found = streams.run_available(streams.sessions(stream, "ts", ["k"], "15 minutes"), f"{tmp_path}/b")
    assert found.agg(F.sum("n")).first()[0] == 200


def test_cube_names_and_shapes(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, float("nan"), "u")], "time int, latitude double, lon double, tas double, unit string").drop("unit")
    cube = Cube.of(df)
    assert cube.dims == ("t", "y", "x") and cube.df.first()["tas"] is None
    assert cube.standard().columns == ["time", "lat", "lon", "tas"]
    assert cube.transpose("x", "y", "t").df.columns == ["x", "y", "t", "tas"] and cube.size() == 1 and cube.shape() == {"t": 1, "y": 1, "x": 1}
    assert cube.named("ave").variables == ("ave[tas]",) and cube.matching("^t").variables == ("tas",)


def ask(engine, variables, *operations, domains=()):
    return engine.run({"domain": list(domains), "variable": variables, "operation": list(operations)})


def test_options_are_honoured_or_refused(spark, tmp_path):
    engine = Engine(spark, archive=Archive(str(tmp_path)), cubes={"a": month_cube(spark, SF)})
    v = [{"uri": "view:a", "name": "tas:v0"}]
    with pytest.raises(ValueError, match="groups"):
        ask(engine, v, {"name": "cube.lowpass", "input": "v0", "axes": "t", "groupby": "t.month"})
    with pytest.raises(ValueError, match="no parameter"):
        ask(engine, v, {"name": "cube.ave", "input": "v0", "axes": "t", "windowsize": 3})
    with pytest.raises(ValueError, match="t among"):
        ask(engine, v, {"name": "cube.anomaly", "input": "v0", "axes": "xy", "groupby": "t.month"})
    ((by_month,),) = ask(engine, v, {"name": "cube.anomaly", "input": "v0", "axes": "t", "groupby": "t.month"}).values()
    ((cycle,),) = ask(engine, v, {"name": "cube.decycle", "input": "v0"}).values()
    rows = lambda c: {(r["t"], r["y"], r["x"]): r[3] for r in c.df.collect()}
    a, b = rows(by_month), rows(cycle)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    ((yearly,),) = ask(engine, v, {"name": "cube.lowpass", "input": "v0", "axes": "t", "resample": "year", "wsize": 1}).values()
    assert yearly.coordinates("t")["t"][0] == datetime.date(1995, 12, 31)


def test_time_ranges_without_data_and_steps(spark):
    engine = Engine(spark, cubes={"a": month_cube(spark, SF)})
    none = {"name": "d", "time": {"start": "1890-01-01", "end": "1891-01-01", "system": "values"}}
    with pytest.raises(ValueError, match="no data"):
        ask(engine, [{"uri": "view:a", "name": "tas:v0", "domain": "d"}], {"name": "cube.ave", "input": "v0", "axes": "t"}, domains=[none])
    some = {"name": "d", "lat": {"start": -60, "end": 60, "system": "values", "step": 2}, "time": {"start": 1, "end": 9, "system": "indices", "step": 4}}
    ((c,),) = ask(engine, [{"uri": "view:a", "name": "tas:v0", "domain": "d"}], {"name": "cube.noop", "input": "v0"}, domains=[some]).values()
    assert c.coordinates("y")["y"] == [-60.0, 0.0, 60.0] and len(c.coordinates("t")["t"]) == 3


def test_inputs_are_brought_to_one_grid_and_each_others_domains(spark):
    engine = Engine(spark, cubes={"a": month_cube(spark, SF), "b": other_cube(spark, SF, 3)})
    v = [{"uri": "view:a", "name": "tas:v0", "domain": "d"}, {"uri": "view:b", "name": "tas:v1"}]
    d = [{"name": "d", "time": {"start": "1996-01-01", "end": "1996-12-31", "system": "values"}}]
    ((c,),) = ask(engine, v, {"name": "cube.ave", "axes": "e", "input": "v0,v1"}, domains=d).values()
    assert c.coordinates("y", "x") == {"y": [-60.0, 0.0, 60.0], "x": [0.0, 120.0, 240.0]} and len(c.coordinates("t")["t"]) == 12
    names = [{"name": "d", "names": {"breite": "lat"}, "breite": {"start": 0, "end": 0, "system": "indices"}}]
    ((c,),) = ask(engine, [v[0]], {"name": "cube.noop", "input": "v0"}, domains=names).values()
    assert c.coordinates("y")["y"] == [-60.0]


def test_results_are_archived_with_their_axes(spark, tmp_path):
    archive = Archive(str(tmp_path), "p", "e")
    engine = Engine(spark, archive=archive, cubes={"a": month_cube(spark, "/root/testdata/sf0.01")})
    for groupby in ("t.year", "t.season", "t.month", "t.week", None):
        spec = {"name": "cube.ave", "axes": "t" if groupby else "y", "input": "v0", "result": "r", "archive": True} | ({"groupby": groupby} if groupby else {})
        ((saved,),) = ask(engine, [{"uri": "view:a", "name": "tas:v0"}], spec).values()
        ((plain,),) = ask(engine, [{"uri": "view:a", "name": "tas:v0"}], spec | {"archive": False}).values()
        assert saved.dims == plain.dims and saved.variables == plain.variables and saved.df.dtypes == plain.df.dtypes
        close = lambda c: sorted((tuple(r)[:-1], round(r[-1], 6)) for r in c.df.collect())
        assert close(saved) == close(plain) and saved.attrs["rid"] == "cube.ave[r]"
    archive.save(month_cube(spark, SF).select("tas"), "years")
    spec = {"domain": [{"name": "d", "time": {"start": "1996-03-01", "end": "1996-12-31", "system": "values"}}], "variable": [{"uri": "archive:years", "name": "tas:v0", "domain": "d"}], "operation": [{"name": "cube.subset", "input": "v0"}]}
    (df,) = engine.frames(spec).values()
    assert df.select("time").distinct().count() == 10
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(_year" in plan


def test_kept_inputs_branches_and_the_best_result(spark):
    engine = Engine(spark, cubes={"a": month_cube(spark, SF)})
    with pytest.raises(KeyError):
        ask(engine, [{"uri": "view:a", "name": "tas:v0", "cache": "req"}], {"name": "cube.noop", "input": "v0"})
    ask(engine, [{"uri": "view:a", "name": "tas:v0", "cache": "opt"}], {"name": "cube.noop", "input": "v0"})
    engine.cubes.clear()
    ((c,),) = ask(engine, [{"uri": "view:a", "name": "tas:v0", "cache": "req"}], {"name": "cube.noop", "input": "v0"}).values()
    assert c.df.count() > 0 and engine.kept.get("input:v0").df.is_cached
    engine.kept.limit = "1k"
    engine.kept.put("other", c)
    assert engine.kept.get("input:v0") is None
    engine.kept.drop()
    assert not engine.kept.cubes
    from dataclasses import replace

    engine.cubes = {"a": replace(month_cube(spark, SF), attrs={"loss": "3"}), "b": replace(other_cube(spark, SF), attrs={"loss": "2"})}
    found = ask(engine, [{"uri": "view:a", "name": "tas:v0"}, {"uri": "view:b", "name": "tas:v1"}], {"name": "cube.noop", "input": "v0,v1", "merge": "min:loss"})
    ((c,),) = found.values()
    assert c.attrs["loss"] == "2"
    from gridlark.plans.workflow import by_operation

    assert list(by_operation(found, "noop")) == list(found) and by_operation(found, "ave") == {}


def test_listing_and_remapped_paths(spark, tmp_path):
    (tmp_path / "agg.ag1").write_text("\n".join(["P;base.path;/far/away", "A;lat;5", "A;lon;6", "V;tas;K;time lat lon", "F;0;10;x.parquet"]))
    (tmp_path / "coll.csv").write_text("tas,agg\npr,agg")
    catalogue = Catalogue(str(tmp_path), remap={"/far": "/near"}, most_partitions=2)
    assert catalogue.files(spark, "agg") == ["/near/away/x.parquet"]
    got = {r["variable"]: (r["axes"], r["shape"]) for r in catalogue.listing(spark, "coll").collect()}
    assert got == {"tas": ("lat:5 lon:6", "K time lat lon"), "pr": ("lat:5 lon:6", None)}
    engine = Engine(spark, catalogue=catalogue)
    assert engine.capabilities(["coll"]).where("kind = 'variable'").count() == 2


def test_ranges_of_time(spark):
    from gridlark.functions.calendar import contains, extended

    df = spark.sql("SELECT timestamp_ntz'2001-03-31 00:00:00' AS a, timestamp_ntz'2001-05-01 00:00:00' AS b")
    (r,) = df.select(contains(F.col("a"), "2001-03-31", "2001-04-01").alias("i"), extended(F.col("a"), F.col("b"), "2m")[1].alias("later"), extended(F.col("a"), F.col("b"), "-1m")[0].alias("sooner")).collect()
    assert r["i"] and str(r["later"]) == "2001-07-01 00:00:00" and str(r["sooner"]) == "2001-02-28 00:00:00"
