"""The operations a request can name, what they need, and how to add one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from gridlark.cube import Cube
from gridlark.operators import anomaly as an
from gridlark.operators import bioclim, combine, regrid, resample, rolling, select, telemap
from gridlark.operators import reduce as rd
from gridlark.operators.eof import eof
from gridlark.plans.request import flag

#: A kernel takes the cubes of a connector, the axes, group keys and parameters.
Run = Callable[[list[Cube], list[str], dict, dict[str, Any]], list[Cube]]


@dataclass(frozen=True)
class Kernel:
    name: str
    title: str
    run: Run
    required: tuple[str, ...] = ()  # patterns, one of which each must find a parameter
    optional: tuple[str, ...] = ()
    grouped: bool = False  # whether it works within groups of time steps
    together: bool = False  # whether it takes its inputs together, which are brought to one grid then


#: Parameters that say something about a result and change nothing.
DESCRIPTIVE = ("axes", "product", "description", "title")

KERNELS: dict[str, Kernel] = {}


def register(name: str, title: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = (), grouped: bool = False, together: bool = False) -> Callable[[Run], Run]:
    """Add an operation: a function of cubes that returns cubes, made of DataFrame operations."""

    def add(run: Run) -> Run:
        KERNELS[name.lower()] = Kernel(name, title, run, required, optional, grouped, together)
        return run

    return add


def kernel(name: str) -> Kernel:
    """By ``module.op`` or ``module:op``, in any case."""
    op = re.split(r"[.:]", name)[-1].lower()
    if op not in KERNELS:
        raise KeyError(f"no such operation: {name}")
    return KERNELS[op]


def describe(name: str | None = None) -> list[dict[str, Any]]:
    """What operations there are, in order of their names."""
    return [{"name": k.name, "title": k.title, "required": list(k.required), "optional": list(k.optional)} for key, k in sorted(KERNELS.items()) if name is None or key == re.split(r"[.:]", name)[-1].lower()]


def each(f: Callable[[Cube, list[str], dict, dict[str, Any]], Cube]) -> Run:
    return lambda cubes, axes, keys, p: [f(c, axes, keys, p) for c in cubes]


TITLES = {"ave": "mean weighted by latitude", "mean": "mean", "max": "maximum", "min": "minimum", "sum": "sum", "med": "median", "std": "standard deviation", "var": "variance"}
for _op in rd.OPS:
    register(_op, TITLES[_op], optional=("axes", "groupby", "resample"), grouped=True)(each(lambda c, axes, keys, p, op=_op: rd.reduce(c, op, axes, keys)))

register("anomaly", "departure from the weighted mean", optional=("axes", "groupby", "resample"), grouped=True)(each(lambda c, axes, keys, p: an.anomaly(c, axes, groups=keys)))
register("norm", "departure divided by the spread", optional=("axes", "groupby", "resample"), grouped=True)(each(lambda c, axes, keys, p: an.norm(c, axes, groups=keys)))


def _filter(c: Cube, axes: list[str], keys: dict, p: dict[str, Any]) -> Cube:
    if axes not in ([], ["t"]):
        raise ValueError("months are filtered on t")
    return select.filter_months(c, next(v for k, v in p.items() if k.startswith("sel")))


register("filter", "time steps of some months", required=("sel.*",))(each(_filter))
register("decycle", "departure from the seasonal cycle", optional=("groupby", "norm"))(each(lambda c, axes, keys, p: an.decycle(c, p.get("groupby") or "t.month", flag(p.get("norm")))))
register("timeAgg", "groups by a part of the calendar", optional=("period", "op"))(each(lambda c, axes, keys, p: resample.time_agg(c, p.get("period", "month"), p.get("op", "mean"))))
register("timeResample", "bins of time", optional=("freq", "op", "fill"))(each(lambda c, axes, keys, p: resample.time_resample(c, p.get("freq", "month"), p.get("op", "mean"), flag(p.get("fill")))))


def _size(p: dict[str, Any]) -> int | None:
    return int(p["wsize"]) if p.get("wsize") is not None else None


register("lowpass", "centred moving average", optional=("wsize", "dense"))(each(lambda c, axes, keys, p: rolling.lowpass(c, _size(p), axes[0] if axes else None, flag(p.get("dense")))))
register("detrend", "departure from the centred moving average", optional=("wsize", "dense"))(each(lambda c, axes, keys, p: rolling.detrend(c, _size(p), axes[0] if axes else None, flag(p.get("dense")))))
register("smooth", "five-point weighted average", optional=("dense",))(each(lambda c, axes, keys, p: rolling.smooth(c, axis=axes[0] if axes else "t", dense=flag(p.get("dense")))))
register("telemap", "correlation with a point", required=("lat", "lon"))(each(lambda c, axes, keys, p: telemap.telemap(c, float(p["lat"]), float(p["lon"]))))
register("regrid", "averages on another grid", required=("gridder",))(each(lambda c, axes, keys, p: regrid.regrid(c, p["gridder"])))
register("subset", "the cells inside a domain")(each(lambda c, axes, keys, p: c))
register("noop", "an intermediate result")(each(lambda c, axes, keys, p: c))


@register("diff", "first input minus second", together=True)
def _diff(cubes: list[Cube], axes: list[str], keys: dict, p: dict[str, Any]) -> list[Cube]:
    if len(cubes) != 2:
        raise ValueError("diff takes two inputs")
    return [combine.diff(*cubes)]


@register("cache", "keep the inputs as a view named by the result", required=("result",))
def _cache(cubes: list[Cube], axes: list[str], keys: dict, p: dict[str, Any]) -> list[Cube]:
    kept = [c.persist() for c in cubes]
    for k, c in enumerate(kept):
        c.df.createOrReplaceTempView(str(p["result"]).replace("-", "_") + (f"_{k}" if k else ""))
    return kept


@register("worldClim", "19 bioclimatic indices", optional=("minTemp", "maxTemp", "temp", "moist", "hscale", "tscale", "wrap", "units", "version"), together=True)
def _world_clim(cubes: list[Cube], axes: list[str], keys: dict, p: dict[str, Any]) -> list[Cube]:
    c = combine.merge(cubes) if len(cubes) > 1 else cubes[0]
    scales = {"hscale": float(p.get("hscale", 1)), "tscale": float(p.get("tscale", 1))}
    if "temp" in p:
        c = bioclim.monthly_extremes(bioclim.celsius(c, p["temp"], p.get("units")), p["temp"], p["moist"])
        df = bioclim.world_clim(c, "tmin", "tmax", "moist", wrap=True, **scales)
    else:
        df = bioclim.world_clim(c, p.get("minTemp", "tasmin"), p.get("maxTemp", "tasmax"), p.get("moist", "pr"), wrap=flag(p.get("wrap")), **scales)
    return [c.with_df(df, dims=c.others(["t"]), variables=bioclim.INDICES)]


@register("eof", "modes of variability", optional=("modes", "center"), together=True)
def _eof(cubes: list[Cube], axes: list[str], keys: dict, p: dict[str, Any]) -> list[Cube]:
    """A cube of maps for each mode and variable, one of the components, with ``pves`` in percent."""
    c = combine.merge(cubes) if len(cubes) > 1 else cubes[0]
    found = eof(c, int(p.get("modes", 16)), flag(p.get("center"), True))
    pves = str([round(100 * f, 1) for f in found.fractions])
    keep, out = c.others(["t"]), []
    for k in range(len(found.fractions)):
        for v in c.variables:
            name = f"eof--{k}-{v}"
            part = found.maps.where((found.maps["m"] == k) & (found.maps["variable"] == v))
            out.append(Cube(part.select(*keep, part["value"].alias(name)), tuple(keep), (name,), {"pves": pves}))
    out.append(Cube(found.pcs.withColumnRenamed("value", "pcs"), ("t", "m"), ("pcs",), {"pves": pves}))
    return out
