"""Grouping by parts of the calendar, and down-sampling to bins of time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.functions.calendar import bin_label, bins_between, component
from gridlark.operators.reduce import aggregate


def _ops(op: str | Iterable[str]) -> list[str]:
    return [o.strip() for o in (op.split(",") if isinstance(op, str) else op)]


def time_agg(cube: Cube, period: str = "month", op: str | Iterable[str] = "mean") -> Cube:
    """Pool all years by a part of the calendar: one row a cell and month, season, hour, ..

    Several operations are made in one pass; results are called ``op[v]``.
    """
    name, key = component(period)
    keep = cube.others(["t"])
    made = {f"{o}[{v}]": aggregate(o, cube.value(v)) for o in _ops(op) for v in cube.variables}
    return cube.with_df(cube.df.groupBy(*keep, key.alias(name)).agg(*[c.alias(n) for n, c in made.items()]), dims=[*keep, name], variables=made)


def time_resample(cube: Cube, freq: str = "month", op: str | Iterable[str] = "mean", fill: bool = False) -> Cube:
    """Down-sample time to bins of a frequency; ``t`` becomes the label of the bin.

    ``fill`` adds the bins without data, between the first and the last of all, as missing.
    """
    keep = cube.others(["t"])
    made = {f"{o}[{v}]": aggregate(o, cube.value(v)) for o in _ops(op) for v in cube.variables}
    out = cube.df.groupBy(*keep, bin_label(F.col("t"), freq).alias("t")).agg(*[c.alias(n) for n, c in made.items()])
    if fill:
        bins = out.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(F.explode(bins_between(F.col("lo"), F.col("hi"), freq)).alias("t"))
        cells = cube.df.select(*keep).distinct()
        grid = cells.crossJoin(F.broadcast(bins)) if keep else bins  # every cell has every bin: that is the result's size
        out = grid.join(out, [*keep, "t"], "left")
    return cube.with_df(out.select("t", *keep, *[F.col(f"`{n}`") for n in made]), dims=["t", *keep], variables=made)


def grouping(groupby: str | None = None, resample: str | None = None) -> dict:
    """Group keys for any reduction over ``t``: by calendar part, or by bin (``resample: "t.season"``)."""
    if groupby:
        name, key = component(groupby)
        return {name: key}
    if resample:
        return {"t_bin": bin_label(F.col("t"), resample)}
    return {}
