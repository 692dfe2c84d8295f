"""Registered queries over the cubes of ``sources.fixtures``, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.operators import anomaly as an
from gridlark.operators import bioclim, combine, regrid, resample, rolling, select, telemap
from gridlark.operators import reduce as rd
from gridlark.operators.eof import eof
from gridlark.plans.workflow import Engine
from gridlark.sources.fixtures import event_cube, month_cube, other_cube
from gridlark.sources.readers import Archive, Catalogue, parse_rainfall, work_folder
from gridlark.streaming.resample import stream_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def r(e: str) -> str:
    """Round in a way that Spark and SQL do alike: to four digits, by floor, with halves going up for sure."""
    return f"floor(({e}) * 10000::double + 0.500001::double) / 10000::double"


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    cast = {"int": "bigint"}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c not in keys and kinds[c] == "double":
            col = (F.floor(col * 10000.0 + 0.500001).cast("double") / 10000.0).alias(c)
        elif kinds[c] in cast:
            col = col.cast(cast[kinds[c]]).alias(c)
        out.append(col)
    return df.select(*out)


def tidy(c: Cube, **names: str) -> DataFrame:
    """Rounded values under plain names: ``result="op[v]"``, or the variables as they are."""
    if names:
        c = c.with_df(c.df.select(*c.dims, *[F.col(f"`{v}`").alias(n) for n, v in names.items()]), variables=names)
    return rounded(c.df, list(c.dims))


def thousands(c: Cube) -> Cube:
    """The same with ``tas`` in thousands."""
    return c.with_df(c.df.withColumn("tas", F.col("tas") / 1000))


_MEAN = "sum({0}::decimal(18,2))::double / count(*)"
_MONTH = "make_date(year({0})::int, month({0})::int, 1)"
CUBE = f"""cube AS (SELECT {_MONTH.format("l_shipdate")} AS t, (-60 + 30 * (l_suppkey % 5))::double AS y, (60 * (l_partkey % 6))::double AS x,
  {_MEAN.format("l_extendedprice")} AS tas, {_MEAN.format("l_quantity")} AS pr, min(l_extendedprice) AS tasmin, max(l_extendedprice) AS tasmax FROM lineitem GROUP BY 1, 2, 3)"""
OTHER = f"""other AS (SELECT {_MONTH.format("o_orderdate")} AS t, (-60 + 30 * (o_custkey % 5))::double AS y, (60 * (o_orderkey % 6))::double AS x, {_MEAN.format("o_totalprice")} AS tas FROM orders GROUP BY 1, 2, 3)"""
COARSE = f"""coarse AS (SELECT {_MONTH.format("o_orderdate")} AS t, (-60 + 60 * (o_custkey % 3))::double AS y, (120 * (o_orderkey % 3))::double AS x, {_MEAN.format("o_totalprice")} AS tas FROM orders GROUP BY 1, 2, 3)"""
EVENTS = """ev AS (SELECT date_trunc('hour', ts)::timestamp AS t, (user_id % 5)::double AS y,
  (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::double AS x, sum(value::decimal(18,2))::double / count(*) AS v FROM events GROUP BY 1, 2, 3)"""
W = "cos(y * (3.1415926536::double / 180::double))"


def query(name: str, sql: str | None, *ctes: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (f"WITH {', '.join(ctes or [CUBE])} " if ctes != ("",) else "") + sql
        return f

    return add


# --- reductions ---------------------------------------------------------------------------------


def _reduction(name: str, op: str, axes: str, sql: str) -> None:
    query(name, sql)(lambda s, d: tidy(rd.reduce(month_cube(s, d).select("tas", "pr"), op, axes)))


def _agg(op: str, v: str) -> str:
    return {"ave": f"avg({v})", "mean": f"avg({v})", "max": f"max({v})", "min": f"min({v})", "sum": f"sum({v})", "med": f"median({v})", "std": f"stddev_pop({v})", "var": f"var_pop({v})"}[op]


for _op in ("ave", "mean", "max", "min", "sum", "med", "std", "var"):
    _reduction(f"{_op}_t", _op, "t", f"SELECT y, x, {r(_agg(_op, 'tas'))} AS tas, {r(_agg(_op, 'pr'))} AS pr FROM cube GROUP BY y, x")
    _w = (lambda v: f"sum({v} * {W}) / sum({W})") if _op == "ave" else (lambda v, o=_op: _agg(o, v))
    _reduction(f"{_op}_xy", _op, "xy", f"SELECT t, {r(_w('tas'))} AS tas, {r(_w('pr'))} AS pr FROM cube GROUP BY t")
    _inner = ", ".join(f"{_w(v)} AS {v}" for v in ("tas", "pr"))
    if _op == "var":  # prices in thousands: four digits of their variances' variance are then within a double
        query("var_txy", f"SELECT {r('var_pop(tas)')} AS tas, {r('var_pop(pr)')} AS pr FROM (SELECT t, var_pop(tas / 1000) AS tas, var_pop(pr) AS pr FROM cube GROUP BY t)")(lambda s, d: tidy(rd.reduce(thousands(month_cube(s, d).select("tas", "pr")), "var", "txy")))
        continue
    _reduction(f"{_op}_txy", _op, "txy", f"SELECT {r(_agg(_op, 'tas'))} AS tas, {r(_agg(_op, 'pr'))} AS pr FROM (SELECT t, {_inner} FROM cube GROUP BY t)")
_reduction("max_yt", "max", "yt", f"SELECT x, {r('max(tas)')} AS tas, {r('max(pr)')} AS pr FROM cube GROUP BY x")
_reduction("ave_y", "ave", "y", f"SELECT t, x, {r(f'sum(tas * {W}) / sum({W})')} AS tas, {r(f'sum(pr * {W}) / sum({W})')} AS pr FROM cube GROUP BY t, x")


@query("std_txy_joint", f"SELECT {r('stddev_pop(tas)')} AS tas FROM cube")
def _(s, d):
    return tidy(rd.reduce(month_cube(s, d).select("tas"), "std", "txy", joint=True))


@query("argmax_t", "SELECT y, x, min(t) AS t FROM (SELECT *, max(tas) OVER (PARTITION BY y, x) AS top FROM cube) WHERE tas = top GROUP BY y, x")
def _(s, d):
    return rd.arg_extreme(month_cube(s, d), "tas", "t").df


# --- regions ------------------------------------------------------------------------------------


def _region(name: str, where: str, columns: str = "t, y, x", **bounds) -> None:
    spec = {"name": name, **bounds}
    query(name, f"SELECT {columns}, {r('tas')} AS tas FROM cube WHERE {where}")(lambda s, d: tidy(select.subset(month_cube(s, d).select("tas"), select.Domain.parse(spec))))


_v = lambda a, b: {"start": a, "end": b, "system": "values"}
_region("subset_values", "y BETWEEN -30 AND 30 AND x BETWEEN 0 AND 120", lat=_v(-30, 30), lon=_v(0, 120))
_region("subset_time", "t BETWEEN date '1994-03-01' AND date '1995-06-01'", time=_v("1994-03-01", "1995-06-01"))
_region("subset_lon_wrap", "x IN (300, 0) OR x - 360 BETWEEN -90 AND 30", lon=_v(-90, 30))
_region("subset_point_nearest", "y = 30 AND x = 60", "t", lat=20, lon=70)
_region("subset_level_ignored", "y BETWEEN 0 AND 60", lat=_v(0, 60), lev=500)
_index = "SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {0} AS v FROM cube)) WHERE i BETWEEN {1} AND {2}"
_region("subset_index", f"t IN ({_index.format('t', 10, 15)}) AND y IN ({_index.format('y', 1, 2)})", time={"start": 10, "end": 15, "system": "indices"}, lat={"start": 1, "end": 2, "crs": "indices"})
_region("subset_time_nearest", "t = (SELECT min_by(t, abs(epoch(t::timestamp) - epoch(timestamp '1995-06-20'))) FROM cube)", "y, x", time="1995-06-20")


@query("subset_intersection", f"SELECT t, y, x, {r('tas')} AS tas FROM cube WHERE y BETWEEN 0 AND 30 AND x BETWEEN 60 AND 240")
def _(s, d):
    a = select.Domain.parse({"name": "a", "lat": _v(-30, 30), "lon": _v(0, 240)})
    b = select.Domain.parse({"name": "b", "lat": _v(0, 90), "lon": _v(60, 360)})
    return tidy(select.subset(month_cube(s, d).select("tas"), a & b))


for _name, _selector, _months in (("filter_month", "aug", "8"), ("filter_season_wrap", "djf", "12, 1, 2"), ("filter_jjas", "jjas", "6, 7, 8, 9")):
    query(_name, f"SELECT t, y, x, {r('tas')} AS tas, {r('pr')} AS pr FROM cube WHERE month(t) IN ({_months})")(lambda s, d, m=_selector: tidy(select.filter_months(month_cube(s, d).select("tas", "pr"), m)))


@query("offset_lag_diff", f"SELECT a.t, a.y, a.x, {r('b.tas - a.tas')} AS tas FROM cube a JOIN cube b ON b.y = a.y AND b.x = a.x AND (b.t - INTERVAL 3 MONTH)::date = a.t")
def _(s, d):
    c = month_cube(s, d).select("tas")
    return tidy(combine.diff(select.lagged(c, "3m"), c))


# --- departures ---------------------------------------------------------------------------------

_AXES = {"xy": ("t", f"sum(tas * {W}) OVER w / sum({W}) OVER w"), "t": ("y, x", "avg(tas) OVER w")}
for _a, (_by, _mean) in _AXES.items():
    _win = f"WINDOW w AS (PARTITION BY {_by})"
    query(f"anomaly_{_a}", f"SELECT t, y, x, {r(f'tas - {_mean}')} AS tas FROM cube {_win}")(lambda s, d, a=_a: tidy(an.anomaly(month_cube(s, d).select("tas"), a)))
    query(f"norm_{_a}", f"SELECT t, y, x, {r(f'(tas - {_mean}) / nullif(stddev_pop(tas) OVER w, 0)')} AS tas FROM cube {_win}")(lambda s, d, a=_a: tidy(an.norm(month_cube(s, d).select("tas"), a)))
_season = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) <= 5 THEN 'MAM' WHEN month({0}) <= 8 THEN 'JJA' ELSE 'SON' END"
for _n, _g, _key, _do in (("decycle_month", "t.month", "month(t)", False), ("decycle_month_norm", "t.month", "month(t)", True), ("decycle_season", "t.season", _season.format("t"), False)):
    _e = "tas - avg(tas) OVER w"
    _e = f"({_e}) / nullif(stddev_pop(tas) OVER w, 0)" if _do else _e
    query(_n, f"SELECT t, y, x, {r(_e)} AS tas FROM cube WINDOW w AS (PARTITION BY y, x, {_key})")(lambda s, d, g=_g, n=_do: tidy(an.decycle(month_cube(s, d).select("tas"), g, n)))


# --- time ---------------------------------------------------------------------------------------

for _n, _p, _name, _key in (("groupby_season", "t.season", "season", _season.format("t")), ("groupby_year", "t.year", "year", "year(t)"), ("groupby_month", "t.month", "m", "month(t)")):
    query(_n, f"SELECT y, x, {_key} AS {_name}, {r('avg(tas)')} AS tas FROM cube GROUP BY ALL")(lambda s, d, p=_p: tidy(rd.reduce(month_cube(s, d).select("tas"), "ave", "t", resample.grouping(groupby=p))))

_QFEB = "last_day((date_trunc('quarter', t + INTERVAL 1 MONTH) + INTERVAL 1 MONTH)::date)"


@query("resample_season_qfeb", f"SELECT {_QFEB} AS t, y, x, {r('avg(tas)')} AS tas FROM cube GROUP BY ALL")
def _(s, d):
    return tidy(resample.time_resample(month_cube(s, d).select("tas"), "season", "mean"), tas="mean[tas]")


@query("resample_season_filled", f"SELECT b.t, c.y, c.x, {r('a.tas')} AS tas FROM (SELECT DISTINCT y, x FROM cube WHERE t < date '1993-06-01') c CROSS JOIN (SELECT last_day(unnest(generate_series(date '1992-02-01', date '1993-05-01', INTERVAL 3 MONTH))::date) AS t) b LEFT JOIN (SELECT {_QFEB} AS t, y, x, avg(tas) AS tas FROM cube WHERE t < date '1993-06-01' AND month(t) NOT IN (9, 10, 11) GROUP BY ALL) a USING (t, y, x)")
def _(s, d):
    c = month_cube(s, d).select("tas")
    c = c.with_df(c.df.where("t < date'1993-06-01' and month(t) not in (9, 10, 11)"))
    return tidy(resample.time_resample(c, "Q-FEB", "mean", fill=True), tas="mean[tas]")


for _n, _f, _label in (("resample_year", "year", "make_date(year(t)::int, 12, 31)"), ("resample_quarter", "Q", "last_day((date_trunc('quarter', t) + INTERVAL 2 MONTH)::date)"), ("resample_month_start", "MS", "date_trunc('month', t)::date")):
    query(_n, f"SELECT {_label} AS t, y, x, {r('max(tas)')} AS tas FROM cube GROUP BY ALL")(lambda s, d, f=_f: tidy(resample.time_resample(month_cube(s, d).select("tas"), f, "max"), tas="max[tas]"))

_ops = ("mean", "max", "min", "sum", "std")


def _multi(v: str) -> str:
    return ", ".join(f"{r(_agg(o, v))} AS {o}_{v}" for o in _ops)


@query("timeagg_month_multi", f"SELECT y, x, month(t) AS m, {_multi('tas')} FROM cube GROUP BY ALL")
def _(s, d):
    return tidy(resample.time_agg(month_cube(s, d).select("tas"), "month", ",".join(_ops)), **{f"{o}_tas": f"{o}[tas]" for o in _ops})


for _p, _key in (("day", "day(t)"), ("hour", "hour(t)"), ("week", "week(t)"), ("dayofweek", "isodow(t) - 1")):
    query(f"timeagg_{_p}", f"SELECT y, x, {_key} AS {'d' if _p == 'day' else _p}, {r('avg(v)')} AS v FROM ev GROUP BY ALL", EVENTS)(lambda s, d, p=_p: tidy(resample.time_agg(event_cube(s, d), p, "ave"), v="ave[v]"))


@query("timeresample_daily_multi", f"SELECT t::date AS t, y, x, {_multi('v')} FROM ev GROUP BY t::date, y, x", EVENTS)
def _(s, d):
    return tidy(resample.time_resample(event_cube(s, d), "1D", _ops), **{f"{o}_v": f"{o}[v]" for o in _ops})


@query("timeresample_6h", f"SELECT time_bucket(INTERVAL 6 HOUR, t, timestamp '1970-01-01') AS t, y, x, {r('avg(v)')} AS v FROM ev GROUP BY ALL", EVENTS)
def _(s, d):
    return tidy(resample.time_resample(event_cube(s, d), "6H"), v="mean[v]")


@query("timeresample_week", f"SELECT (date_trunc('week', t) + INTERVAL 6 DAY)::date AS t, y, x, {r('min(v)')} AS v FROM ev GROUP BY ALL", EVENTS)
def _(s, d):
    return tidy(resample.time_resample(event_cube(s, d), "W", "min"), v="min[v]")


@query("timeresample_daily_then_monthly", f"SELECT y, x, month(t) AS m, {r('avg(v)')} AS ave_v, {r('stddev_pop(v)')} AS std_v FROM (SELECT t::date AS t, y, x, max(v) AS v FROM ev GROUP BY t::date, y, x) GROUP BY ALL", EVENTS)
def _(s, d):
    daily = resample.time_resample(event_cube(s, d), "1D", "max").rename({"max[v]": "v"})
    return tidy(resample.time_agg(daily, "month", "ave,std"), ave_v="ave[v]", std_v="std[v]")


# --- windows ------------------------------------------------------------------------------------

_DENSE = "dense AS (SELECT g.t, g.y, g.x, tas FROM (SELECT * FROM (SELECT DISTINCT t FROM cube) CROSS JOIN (SELECT DISTINCT y, x FROM cube)) g LEFT JOIN cube c ON c.t = g.t AND c.y = g.y AND c.x = g.x)"
_roll = lambda w: f"avg(tas) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING)"
for _size in (4, 5):
    query(f"lowpass_t_{_size}", f"SELECT t, y, x, {r(_roll(_size))} AS tas FROM dense", CUBE, _DENSE)(lambda s, d, w=_size: tidy(rolling.lowpass(month_cube(s, d).select("tas"), w)))
    query(f"detrend_t_{_size}", f"SELECT t, y, x, {r(f'tas - {_roll(_size)}')} AS tas FROM dense", CUBE, _DENSE)(lambda s, d, w=_size: tidy(rolling.detrend(month_cube(s, d).select("tas"), w)))


@query("lowpass_default", f"SELECT t, y, x, {r('avg(tas) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)')} AS tas FROM dense", CUBE, _DENSE)
def _(s, d):
    return tidy(rolling.lowpass(month_cube(s, d).select("tas")))


@query("smooth_t", f"SELECT t, y, x, {r('0.13::double * coalesce(lag(tas, 2) OVER w, 0) + 0.23::double * coalesce(lag(tas, 1) OVER w, 0) + 0.28::double * coalesce(tas, 0) + 0.23::double * coalesce(lead(tas, 1) OVER w, 0) + 0.13::double * coalesce(lead(tas, 2) OVER w, 0)')} AS tas FROM dense WINDOW w AS (PARTITION BY y, x ORDER BY t)", CUBE, _DENSE)
def _(s, d):
    return tidy(rolling.smooth(month_cube(s, d).select("tas")))


@query("decycle_detrend", f"SELECT t, y, x, {r(f'tas - {_roll(12)}')} AS tas FROM (SELECT t, y, x, tas - avg(tas) OVER (PARTITION BY y, x, month(t)) AS tas FROM dense)", CUBE, _DENSE)
def _(s, d):
    return tidy(rolling.detrend(an.decycle(month_cube(s, d).select("tas")), 12))


# --- several cubes ------------------------------------------------------------------------------


@query("telemap", f"SELECT a.y, a.x, {r('corr(a.tas, c.tas)')} AS tas FROM cube a JOIN cube c ON c.t = a.t AND c.y = 30 AND c.x = 120 GROUP BY a.y, a.x")
def _(s, d):
    return tidy(telemap.telemap(month_cube(s, d).select("tas"), lat=33.0, lon=140.0))


_both = "FROM cube a JOIN other b ON b.t = a.t AND b.y = a.y AND b.x = a.x"
query("diff_models", f"SELECT a.t, a.y, a.x, {r('a.tas - b.tas')} AS tas {_both}", CUBE, OTHER)(lambda s, d: tidy(combine.diff(month_cube(s, d).select("tas"), other_cube(s, d))))
for _n, _o in (("ds_sub", "-"), ("ds_mul", "*"), ("ds_div", "/")):
    query(_n, f"SELECT a.t, a.y, a.x, {r(f'a.tas {_o} b.tas')} AS tas, {r('a.pr')} AS pr {_both}", CUBE, OTHER)(lambda s, d, o=_o: tidy(combine.arithmetic(o, month_cube(s, d).select("tas", "pr"), other_cube(s, d), by_name=True)))


@query("ds_add", f"SELECT a.t, a.y, a.x, {r('a.tas + b.tas')} AS tas, {r('b.tas * 2')} AS twice {_both}", CUBE, OTHER)
def _(s, d):
    b = other_cube(s, d)
    both = b.with_df(b.df.withColumn("twice", F.col("tas") * 2), variables=["tas", "twice"])
    return tidy(combine.arithmetic("+", month_cube(s, d).select("tas"), both, by_name=True))


query("ds_div_scalar", f"SELECT t, y, x, {r('tas / 7::double')} AS tas FROM cube")(lambda s, d: tidy(combine.arithmetic("/", month_cube(s, d).select("tas"), 7)))


@query("broadcast_climatology", f"SELECT a.t, a.y, a.x, {r('a.tas - c.tas')} AS tas FROM cube a JOIN (SELECT y, x, avg(tas) AS tas FROM cube GROUP BY y, x) c ON c.y = a.y AND c.x = a.x")
def _(s, d):
    c = month_cube(s, d).select("tas")
    return tidy(combine.diff(c, rd.reduce(c, "mean", "t")))


for _op in ("ave", "max", "std"):
    query(f"ensemble_{_op}", f"SELECT t, y, x, {r(_agg(_op, 'tas'))} AS tas FROM (SELECT t, y, x, tas FROM cube UNION ALL SELECT * FROM other) GROUP BY t, y, x", CUBE, OTHER)(lambda s, d, o=_op: tidy(rd.reduce(combine.ensemble([month_cube(s, d).select("tas"), other_cube(s, d)]), o, "e")))


@query("merge_vars", f"SELECT coalesce(a.t, b.t) AS t, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, {r('a.pr')} AS pr, {r('b.tas')} AS price FROM cube a FULL JOIN other b ON b.t = a.t AND b.y = a.y AND b.x = a.x", CUBE, OTHER)
def _(s, d):
    return tidy(combine.merge([month_cube(s, d).select("pr"), other_cube(s, d).rename({"tas": "price"})]))


@query("union_rows", f"SELECT t, y, x, {r('tas')} AS tas, {r('pr')} AS pr FROM cube WHERE year(t) = 1993 UNION ALL SELECT t, y, x, {r('tas')}, NULL FROM cube WHERE year(t) = 1994")
def _(s, d):
    c = month_cube(s, d).select("tas", "pr")
    early, late = (c.with_df(c.df.where(F.year("t") == n)) for n in (1993, 1994))
    return tidy(combine.union_rows([early, late.select("tas")]))


@query("best_of", f"SELECT t, y, x, {r('tas')} AS tas FROM other", OTHER)
def _(s, d):
    a, b = replace(month_cube(s, d).select("tas"), attrs={"loss": "0.5"}), replace(other_cube(s, d), attrs={"loss": "0.2"})
    return tidy(combine.best_of([a, b], "min:loss"))


# --- grids --------------------------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{float(v)!r}::double" for v in row) + ")" for row in rows)


def _bilinear() -> str:
    """The cube at the coarse grid's rows and columns, all of which are on the cube's."""
    return f"SELECT a.t, a.y, a.x, {r('a.tas - b.tas')} AS tas FROM cube a JOIN coarse b ON b.t = a.t AND b.y = a.y AND b.x = a.x"


@query("align_diff", _bilinear(), CUBE, COARSE)
def _(s, d):
    return tidy(combine.diff(*regrid.align([month_cube(s, d).select("tas"), other_cube(s, d, 3)])))


@query(
    "align_highest",
    f"""SELECT t, y, x, CASE WHEN abs(sum(wy * wx) - 1) < 1e-9 THEN {r("sum(tas * wy * wx)")} END AS tas FROM (
  SELECT c.t, ty.v AS y, tx.v AS x, c.tas, greatest(0, 1 - abs(c.y - ty.v) / 60) AS wy, greatest(0, 1 - abs(c.x - tx.v) / 120) AS wx
  FROM coarse c CROSS JOIN (SELECT unnest([-60, -30, 0, 30, 60])::double AS v) ty CROSS JOIN (SELECT unnest([0, 60, 120, 180, 240])::double AS v) tx)
WHERE wy > 0 AND wx > 0 GROUP BY t, y, x""",
    CUBE,
    COARSE,
)
def _(s, d):
    return tidy(regrid.align([other_cube(s, d, 3), month_cube(s, d).select("tas")], "highest")[0])


def _conservative(lats: list[tuple], lons: list[tuple]) -> str:
    return f"""SELECT t, yo AS y, xo AS x, {r("sum(tas * w) / sum(w)")} AS tas FROM (
  SELECT t, yo, xo, tas, (sin(radians(least(y + 15, y1))) - sin(radians(greatest(y - 15, y0)))) * (least(x + 30, x1) - greatest(x - 30, x0)) AS w
  FROM cube JOIN (VALUES {_values(lats)}) a(yo, y0, y1) ON y + 15 > y0 AND y - 15 < y1 JOIN (VALUES {_values(lons)}) b(xo, x0, x1) ON x + 30 > x0 AND x - 30 < x1)
GROUP BY t, yo, xo"""


query("regrid_uniform", _conservative([(-52.5, -75, -30), (-7.5, -30, 15), (37.5, 15, 60)], [(15, -30, 60), (105, 60, 150), (195, 150, 240), (285, 240, 330)]))(lambda s, d: tidy(regrid.regrid(month_cube(s, d).select("tas"), "uniform~45x90")))


def _gaussian() -> str:
    lats = [v for v in regrid.gaussian_latitudes(8) if -75 <= v <= 75]
    b = regrid.edges(np.array(lats), -90.0, 90.0)
    lons = [(-30 + 22.5 * k + 11.25, -30 + 22.5 * k, -30 + 22.5 * (k + 1)) for k in range(16)]
    return _conservative(list(zip(lats, b[:-1], b[1:], strict=True)), lons)


query("regrid_gaussian", _gaussian())(lambda s, d: tidy(regrid.regrid(month_cube(s, d).select("tas"), "gaussian~8")))


# --- indices and modes --------------------------------------------------------------------------

_CLIM = """b AS (SELECT g.t, g.y, g.x, (tasmin + tasmax) / 2 AS ave, (tasmax - tasmin) * 2 AS rng, tasmin AS lo, tasmax AS hi, pr AS wet, row_number() OVER (PARTITION BY g.y, g.x ORDER BY g.t) AS i
  FROM (SELECT * FROM (SELECT DISTINCT t FROM cube) CROSS JOIN (SELECT DISTINCT y, x FROM cube)) g LEFT JOIN cube c ON c.t = g.t AND c.y = g.y AND c.x = g.x),
q AS (SELECT *, CASE WHEN count(wet) OVER w = 3 THEN avg(wet) OVER w END AS qw, CASE WHEN count(ave) OVER w = 3 THEN avg(ave) OVER w END AS qa FROM b WINDOW w AS (PARTITION BY y, x ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
p AS (SELECT *, first_value(i) OVER (PARTITION BY y, x ORDER BY qw DESC NULLS LAST, i) AS iw, first_value(i) OVER (PARTITION BY y, x ORDER BY qw NULLS LAST, i) AS id,
  first_value(i) OVER (PARTITION BY y, x ORDER BY qa DESC NULLS LAST, i) AS ih, first_value(i) OVER (PARTITION BY y, x ORDER BY qa NULLS LAST, i) AS ic FROM q)"""
_near = lambda k: f"FILTER (abs(i - {k}) < 2)"
_BIO = {
    "bio1": "avg(ave)",
    "bio2": "avg(rng)",
    "bio3": "avg(rng) * 100 / (max(hi) - min(lo))",
    "bio4": "stddev_pop(ave)",
    "bio5": "max(hi)",
    "bio6": "min(lo)",
    "bio7": "max(hi) - min(lo)",
    "bio8": f"avg(ave) {_near('iw')}",
    "bio9": f"avg(ave) {_near('id')}",
    "bio10": f"avg(ave) {_near('ih')}",
    "bio11": f"avg(ave) {_near('ic')}",
    "bio12": "sum(wet)",
    "bio13": "max(wet)",
    "bio14": "min(wet)",
    "bio15": "stddev_pop(wet) * 100 / (sum(wet) / 12 + 1)",
    "bio16": f"sum(wet) {_near('iw')}",
    "bio17": f"sum(wet) {_near('id')}",
    "bio18": f"sum(wet) {_near('ih')}",
    "bio19": f"sum(wet) {_near('ic')}",
}


@query("worldclim", f"SELECT y, x, {', '.join(f'{r(e)} AS {n}' for n, e in _BIO.items())} FROM p GROUP BY y, x", CUBE, _CLIM)
def _(s, d):
    return rounded(bioclim.world_clim(month_cube(s, d), "tasmin", "tasmax", "pr"), ["y", "x"])


_COMPLETE = "complete AS (SELECT y, x FROM cube GROUP BY y, x HAVING count(*) = (SELECT count(DISTINCT t) FROM cube))"


@query("eof_reconstruction", "SELECT t, y, x, floor(tas * 100 + 0.5001::double) / 100 AS tas FROM cube JOIN complete USING (y, x)", CUBE, _COMPLETE)
def _(s, d):
    """Maps times components, summed over all modes, and the means: the cells as they were."""
    c = month_cube(s, d).select("tas")
    found = eof(c, 64)
    parts = found.maps.select("y", "x", "m", F.col("value").alias("a")).join(found.pcs.select("t", "m", F.col("value").alias("b")), "m")
    sums = parts.groupBy("t", "y", "x").agg(F.sum(F.col("a") * F.col("b")).alias("part"))
    out = sums.join(rd.reduce(c, "mean", "t").df, ["y", "x"])
    return out.select("t", "y", "x", (F.floor((F.col("part") + F.col("tas")) * 100 + 0.5001).cast("double") / 100).alias("tas"))


@query("eof_total_variance", f"SELECT {r('sum(v)')} AS variance FROM (SELECT var_pop(tas / 1000) AS v FROM cube JOIN complete USING (y, x) GROUP BY y, x)", CUBE, _COMPLETE)
def _(s, d):
    pcs = eof(thousands(month_cube(s, d).select("tas")), 64).pcs
    return rounded(pcs.groupBy("m").agg(F.avg(F.col("value") * F.col("value")).alias("v")).agg(F.sum("v").alias("variance")), [])


@query("eof_orthonormal", "SELECT a::int AS a, b::int AS b, (a = b)::int::double AS product FROM range(4) p(a), range(4) q(b) WHERE a <= b AND EXISTS (FROM complete)", CUBE, _COMPLETE)
def _(s, d):
    maps = eof(month_cube(s, d).select("tas"), 4).maps
    a, b = (maps.select("y", "x", F.col("m").alias(n), F.col("value").alias(f"v{n}")) for n in "ab")
    out = a.join(b, ["y", "x"]).where("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("product"))
    return rounded(out, ["a", "b"])


@query("worldclim_monthly_extremes", f"SELECT make_date(2000, m::int, 1) AS t, y, x, {r('max(hi)')} AS tmax, {r('min(lo)')} AS tmin, {r('avg(wet)')} AS moist FROM (SELECT t::date AS day, any_value(month(t)) AS m, y, x, max(v) AS hi, min(v) AS lo, avg(v) AS wet FROM ev GROUP BY t::date, y, x) GROUP BY m, y, x", EVENTS)
def _(s, d):
    return tidy(bioclim.monthly_extremes(event_cube(s, d), "v", "v"))


@query("worldclim_kelvin", f"SELECT y, x, {r('avg(v - 273.15::double)')} AS v FROM ev GROUP BY y, x", EVENTS)
def _(s, d):
    return tidy(rd.reduce(bioclim.celsius(event_cube(s, d), "v", "Kelvin"), "mean", "t"))


@query("eof_variance", None)
def _(s, d):
    found = eof(month_cube(s, d).select("tas"), 8)
    return s.createDataFrame(list(enumerate(found.fractions)), "m int, fraction double")


@query("eof_maps", None)
def _(s, d):
    return eof(month_cube(s, d).select("tas", "pr"), 4).maps


@query("eof_pcs", None)
def _(s, d):
    return eof(month_cube(s, d).select("tas"), 4).pcs


# --- requests, text, streams --------------------------------------------------------------------


@query("workflow_seasonal_cycle", f"SELECT y AS lat, x AS lon, month(t) AS mode, {r('avg(tas)')} AS v FROM cube WHERE y BETWEEN -30 AND 60 GROUP BY ALL")
def _(s, d):
    engine = Engine(s, cubes={"model": month_cube(s, d)})
    request = {
        "domain": [{"name": "d0", "lat": {"start": -30, "end": 60, "system": "values"}}],
        "variable": [{"uri": "view:model", "name": "tas:v0", "domain": "d0"}],
        "operation": [{"name": "cube.ave", "axes": "t", "input": "v0", "groupby": "t.month"}],
    }
    (df,) = engine.frames(request).values()
    return rounded(df.withColumnRenamed("ave[v0]", "v"), ["lat", "lon"])


@query("workflow_branch", f"SELECT {r('var_pop(v)')} AS var, {r('stddev_pop(v)')} AS std FROM (SELECT max(tas) AS v FROM cube GROUP BY t)")
def _(s, d):
    engine = Engine(s, cubes={"model": month_cube(s, d)})
    request = {
        "variable": [{"uri": "view:model", "name": "tas:v0"}],
        "operation": [
            {"name": "cube.max", "axes": "xy", "input": "v0:top"},
            {"name": "cube.var", "axes": "t", "input": "top:a"},
            {"name": "cube.std", "axes": "t", "input": "top:b"},
        ],
    }
    found = engine.frames(request)
    return rounded(found["a"].toDF("var").crossJoin(F.broadcast(found["b"].toDF("std"))), [])  # one row each


@query("workflow_ensemble_anomaly", f"SELECT t AS time, y AS lat, x AS lon, {r('m - avg(m) OVER (PARTITION BY y, x)')} AS v FROM (SELECT t, y, x, avg(tas) AS m FROM (SELECT t, y, x, tas FROM cube UNION ALL SELECT * FROM other) GROUP BY t, y, x)", CUBE, OTHER)
def _(s, d):
    engine = Engine(s, cubes={"a": month_cube(s, d), "b": other_cube(s, d)})
    request = {
        "variable": [{"uri": "view:a", "name": "tas:v0"}, {"uri": "view:b", "name": "tas:v1"}],
        "operation": [{"name": "cube.ave", "axes": "e", "input": "v0,v1:m"}, {"name": "cube.anomaly", "axes": "t", "input": "m:out"}],
    }
    df = engine.frames(request)["out"]
    return rounded(df.withColumnRenamed("anomaly[ave[v0]]", "v"), ["time", "lat", "lon"])


def _request(s: SparkSession, d: str, engine: Engine, variable: dict, *operations: dict, domain: dict | None = None) -> Cube:
    """The one cube that a request gives."""
    ((cube,),) = engine.run({"domain": [domain] if domain else [], "variable": [variable], "operation": list(operations)}).values()
    return cube


_V0 = {"uri": "view:model", "name": "tas:v0"}


@query("workflow_subset_noop", f"SELECT t, y, {r('tas')} AS tas FROM cube WHERE y BETWEEN 0 AND 60 AND x = 60")
def _(s, d):
    box = {"name": "box", "lat": _v(0, 60), "lon": 70}
    c = _request(s, d, Engine(s, cubes={"model": month_cube(s, d)}), _V0, {"name": "cube.subset", "input": "v0:part", "domain": "box"}, {"name": "cube.noop", "input": "part"}, domain=box)
    return tidy(c, tas="noop[subset[v0]]")


@query("workflow_groupby_anomaly", f"SELECT t, y, x, {r('tas - avg(tas) OVER (PARTITION BY y, x, year(t))')} AS tas FROM cube")
def _(s, d):
    return tidy(_request(s, d, Engine(s, cubes={"model": month_cube(s, d)}), _V0, {"name": "cube.anomaly", "axes": "t", "input": "v0", "groupby": "t.year"}), tas="anomaly[v0]")


@query("workflow_resample_lowpass", f"SELECT t, y, x, {r('avg(tas) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS tas FROM (SELECT make_date(year(t)::int, 12, 31) AS t, y, x, avg(tas) AS tas FROM cube GROUP BY ALL)")
def _(s, d):
    return tidy(_request(s, d, Engine(s, cubes={"model": month_cube(s, d)}), _V0, {"name": "cube.lowpass", "axes": "t", "input": "v0", "resample": "year", "wsize": 3}), tas="lowpass[v0]")


@query("workflow_smooth_dense", f"SELECT t, {r('0.13::double * coalesce(lag(tas, 2) OVER w, 0) + 0.23::double * coalesce(lag(tas, 1) OVER w, 0) + 0.28::double * tas + 0.23::double * coalesce(lead(tas, 1) OVER w, 0) + 0.13::double * coalesce(lead(tas, 2) OVER w, 0)')} AS tas FROM (SELECT t, avg(tas) AS tas FROM cube GROUP BY t) WINDOW w AS (ORDER BY t)")
def _(s, d):
    c = _request(s, d, Engine(s, cubes={"model": month_cube(s, d)}), _V0, {"name": "cube.mean", "axes": "xy", "input": "v0:m"}, {"name": "cube.smooth", "input": "m", "dense": True})
    return tidy(c, tas="smooth[mean[v0]]")


@query("ensemble_two_grids", f"SELECT t, y, x, {r('avg(tas)')} AS tas FROM (SELECT t, y, x, tas FROM cube WHERE y IN (-60, 0, 60) AND x IN (0, 120, 240) UNION ALL SELECT * FROM coarse) GROUP BY t, y, x", CUBE, COARSE)
def _(s, d):
    engine = Engine(s, cubes={"a": month_cube(s, d), "b": other_cube(s, d, 3)})
    ((c,),) = engine.run({"variable": [{"uri": "view:a", "name": "tas:v0"}, {"uri": "view:b", "name": "tas:v1"}], "operation": [{"name": "cube.ave", "axes": "e", "input": "v0,v1"}]}).values()
    return tidy(c, tas="ave[v0]")


@query("workflow_sibling_domains", f"SELECT a.t, a.y, a.x, {r('b.tas - a.tas')} AS tas {_both} WHERE a.y BETWEEN 0 AND 30", CUBE, OTHER)
def _(s, d):
    engine = Engine(s, cubes={"a": month_cube(s, d), "b": other_cube(s, d)})
    ((c,),) = engine.run({"domain": [{"name": "d", "lat": _v(0, 30)}], "variable": [{"uri": "view:a", "name": "tas:v0", "domain": "d"}, {"uri": "view:b", "name": "tas:v1"}], "operation": [{"name": "cube.diff", "input": "v1,v0"}]}).values()
    return tidy(c, tas="diff[v1]")


@query("workflow_best_result", f"SELECT t, y, x, {r('tas')} AS tas FROM other", OTHER)
def _(s, d):
    engine = Engine(s, cubes={"a": replace(month_cube(s, d), attrs={"loss": "0.5"}), "b": replace(other_cube(s, d), attrs={"loss": "0.2"})})
    ((c,),) = engine.run({"variable": [{"uri": "view:a", "name": "tas:v0"}, {"uri": "view:b", "name": "tas:v1"}], "operation": [{"name": "cube.noop", "input": "v0,v1", "merge": "min:loss"}]}).values()
    return tidy(c, tas="noop[v1]")


@query("workflow_kept_input", f"SELECT t, {r('max(tas)')} AS tas FROM cube WHERE year(t) = 1996 GROUP BY t")
def _(s, d):
    engine = Engine(s, cubes={"model": month_cube(s, d)})
    year = {"name": "d", "time": _v("1996-01-01", "1996-12-31")}
    _request(s, d, engine, _V0 | {"domain": "d", "cache": "opt"}, {"name": "cube.noop", "input": "v0"}, domain=year)
    engine.cubes.clear()  # the second request has only what the first one kept
    return tidy(_request(s, d, engine, _V0 | {"domain": "d", "cache": "req"}, {"name": "cube.max", "axes": "xy", "input": "v0"}, domain=year), tas="max[v0]")


@query("cache_as_view", f"SELECT y, x, {r('min(tas)')} AS tas FROM cube GROUP BY y, x")
def _(s, d):
    engine = Engine(s, cubes={"model": month_cube(s, d)})
    _request(s, d, engine, _V0, {"name": "cube.cache", "input": "v0", "result": "kept_cube"})
    c = _request(s, d, Engine(s), {"uri": "view:kept_cube", "name": "v0"}, {"name": "cube.min", "axes": "t", "input": "v0"})
    return tidy(c, tas="min[v0]")


_step = "SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {0} AS v FROM cube{1})) WHERE i % {2} = 0"
_region("subset_step", f"y IN ({_step.format('y', '', 2)}) AND t IN ({_step.format('t', chr(32) + 'WHERE year(t) = 1996', 5)})", lat={"start": -60, "end": 60, "system": "values", "step": 2}, time={"start": "1996-01-01", "end": "1996-12-31", "system": "values", "step": 5})
_region("subset_named_axis", "y BETWEEN 0 AND 30", names={"breite": "lat"}, breite=_v(0, 30))


@query("variables_by_pattern", f"SELECT x, y, t, {r('tasmin')} AS tasmin, {r('tasmax')} AS tasmax FROM cube")
def _(s, d):
    return tidy(month_cube(s, d).matching("^tasm").transpose("x", "y", "t"))


@query("archive_season", f"SELECT y, x, {_season.format('t')} AS season, {r('avg(tas)')} AS tas FROM cube GROUP BY ALL")
def _(s, d):
    engine = Engine(s, archive=Archive(work_folder(s, "archive")), cubes={"model": month_cube(s, d)})
    return tidy(_request(s, d, engine, _V0, {"name": "cube.ave", "axes": "t", "input": "v0", "groupby": "t.season", "result": "r", "archive": True}), tas="ave[v0]")


@query("archive_range", f"SELECT t, {r('max(tas)')} AS tas FROM cube WHERE t BETWEEN date '1996-05-01' AND date '1997-04-30' GROUP BY t")
def _(s, d):
    archive = Archive(work_folder(s, "archive"))
    archive.save(month_cube(s, d).select("tas"), "model")
    time = {"name": "d", "time": _v("1996-05-01", "1997-04-30")}
    return tidy(_request(s, d, Engine(s, archive=archive), {"uri": "archive:model", "name": "tas:v0", "domain": "d"}, {"name": "cube.max", "axes": "xy", "input": "v0"}, domain=time), tas="max[v0]")


@query("collection_range", f"SELECT t, {r('avg(pr)')} AS pr FROM cube WHERE t BETWEEN date '1996-05-01' AND date '1997-04-30' GROUP BY t")
def _(s, d):
    catalogue = _catalogue(s, d)
    time = {"name": "d", "time": _v("1996-05-01", "1997-04-30")}
    return tidy(_request(s, d, Engine(s, catalogue=catalogue), {"uri": "collection:years", "name": "pr:v0", "domain": "d"}, {"name": "cube.mean", "axes": "xy", "input": "v0"}, domain=time), pr="mean[v0]")


def _catalogue(s: SparkSession, d: str) -> Catalogue:
    """A collection of a file a year, written to the shared folder."""
    folder = work_folder(s, "catalogue")
    Archive(folder, "files", "years").save(month_cube(s, d).select("tas", "pr"), "model")
    records = ["A;time;t;83", "A;lat;y;5", "A;lon;x;6", "V;tas;K;t y x", "V;pr;mm;t y x"]
    for year in range(1995, 2002):
        minutes = (date(year, 1, 1) - date(1970, 1, 1)).days * 1440
        records.append(f"F;{minutes};1000;{folder}/files/years/model/_year={year}")
    s.createDataFrame([(x,) for x in records], "value string").coalesce(1).write.text(f"{folder}/model.ag1")
    catalogue = Catalogue(folder)
    catalogue.write(s, "years", {"tas": "model", "pr": "model"}, {"title": "months"})
    return catalogue


@query("collection_listing", "SELECT * FROM (VALUES ('tas', 'model', 7, 7000::bigint, 'time:83 lat:5 lon:6', 'K t y x'), ('pr', 'model', 7, 7000::bigint, 'time:83 lat:5 lon:6', 'mm t y x')) v(variable, aggregation, n_files, n_bytes, axes, shape)", "")
def _(s, d):
    return _catalogue(s, d).listing(s, "years")


#: Operations as they are offered: name, what must be given, what may be.
_OFFERED = """
ave||axes,groupby,resample
anomaly||axes,groupby,resample
cache|result|
decycle||groupby,norm
detrend||wsize,dense
diff||
eof||modes,center
filter|sel.*|
lowpass||wsize,dense
max||axes,groupby,resample
mean||axes,groupby,resample
med||axes,groupby,resample
min||axes,groupby,resample
noop||
norm||axes,groupby,resample
regrid|gridder|
smooth||dense
std||axes,groupby,resample
subset||
sum||axes,groupby,resample
telemap|lat,lon|
timeAgg||period,op
timeResample||freq,op,fill
var||axes,groupby,resample
worldClim||minTemp,maxTemp,temp,moist,hscale,tscale,wrap,units,version"""


@query("capabilities", "SELECT 'operation' AS kind, * FROM (VALUES " + ", ".join("('" + "', '".join(x.split("|")) + "')" for x in _OFFERED.split()) + ") v(name, required, optional)", "")
def _(s, d):
    return Engine(s).capabilities().drop("title")


@query("rainfall_text", f"SELECT make_date(year(t)::int, month(t)::int, 15) AS t, 'month' AS series, {r('round(sum(pr), 1)')} AS value FROM (SELECT t, round(pr, 1) AS pr FROM cube WHERE y = 0 AND x = 0) GROUP BY ALL UNION ALL SELECT make_date(y, 6, 15), 'ANN', {r('count(*)::double')} FROM (SELECT year(t)::int AS y FROM cube WHERE y = 0 AND x = 0) GROUP BY y")
def _(s, d):
    c = month_cube(s, d)
    rows = c.df.where("y = 0 and x = 0").groupBy(F.year("t").alias("year"))
    months = [F.lpad(F.coalesce(F.max(F.when(F.month("t") == m, F.format_string("%.1f", F.round("pr", 1)))), F.lit("")), 7, " ") for m in range(1, 13)]
    lines = rows.agg(F.concat(F.lit(""), *months, F.lpad(F.count(F.lit(1)).cast("string"), 7, " ")).alias("rest"))
    text = lines.select(F.concat(F.col("year").cast("string"), "rest").alias("value"))
    return rounded(parse_rainfall(text).where("value is not null"), [])


@query("stream_event_totals", "SELECT date_trunc('day', ts)::timestamp AS day, event_type, count(*) AS n, floor(sum(value::decimal(18,2))::double * 100 + 0.5::double) / 100::double AS total FROM events GROUP BY ALL", "")
def _(s, d):
    return stream_totals(s, d)
