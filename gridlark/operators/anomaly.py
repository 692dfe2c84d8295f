"""Departures from means: anomalies, normalisation and removal of the seasonal cycle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.functions.calendar import component
from gridlark.operators.reduce import aggregate


def _against_groups(cube: Cube, keys: dict[str, Column], aggregates: dict[str, Column], made: dict[str, Column]) -> Cube:
    """Join each row with aggregates of its group.

    An aggregation and a join instead of a window: partial sums shrink the
    shuffle, and a small table of groups is broadcast by size at run time
    instead of sorting the cube.
    """
    keyed = cube.df.withColumns({f"_k_{n}": c for n, c in keys.items()})
    names = [f"_k_{n}" for n in keys]
    means = keyed.groupBy(*names).agg(*[c.alias(n) for n, c in aggregates.items()])
    both = keyed.join(means, names) if names else keyed.crossJoin(F.broadcast(means))  # one row
    return cube.with_df(both.select(*cube.dims, *[c.alias(v) for v, c in made.items()]))


def _groups(cube: Cube, over: list[str], groups: dict[str, Column] | None) -> dict[str, Column]:
    """The kept dimensions, and groups of time steps, which need ``t`` among the axes."""
    if groups and "t" not in over:
        raise ValueError("groups of time need t among the axes")
    return {k: F.col(k) for k in cube.others(over)} | {f"group_{k}": c for k, c in (groups or {}).items()}


def anomaly(cube: Cube, axes: str | Iterable[str], joint: bool = False, groups: dict[str, Column] | None = None) -> Cube:
    """``v - ave(v, axes)``; with ``t`` and other axes, first over those, then over ``t``, within groups of time if given."""
    over = cube.checked(axes)
    if "t" in over and len(over) > 1 and not joint:
        return anomaly(anomaly(cube, [a for a in over if a != "t"], True), ["t"], True, groups)
    keys = _groups(cube, over, groups)
    means = {f"_a_{v}": aggregate("ave", cube.value(v), "y" in over) for v in cube.variables}
    return _against_groups(cube, keys, means, {v: cube.value(v) - F.col(f"`_a_{v}`") for v in cube.variables})


def norm(cube: Cube, axes: str | Iterable[str], joint: bool = False, groups: dict[str, Column] | None = None) -> Cube:
    """``(v - ave) / std(v - ave)`` over the axes; null where the spread is 0.

    The spread is not weighted. It is that of the values, which a constant does not change.
    """
    over = cube.checked(axes)
    if "t" in over and len(over) > 1 and not joint:
        return norm(norm(cube, [a for a in over if a != "t"], True), ["t"], True, groups)
    keys = _groups(cube, over, groups)
    stats = {f"_a_{v}": aggregate("ave", cube.value(v), "y" in over) for v in cube.variables}
    stats |= {f"_s_{v}": F.stddev_pop(cube.value(v)) for v in cube.variables}
    made = {v: F.when(F.col(f"`_s_{v}`") != 0, (cube.value(v) - F.col(f"`_a_{v}`")) / F.col(f"`_s_{v}`")) for v in cube.variables}
    return _against_groups(cube, keys, stats, made)


def decycle(cube: Cube, groupby: str = "t.month", normalise: bool = False) -> Cube:
    """Subtract each cell's mean of its calendar group, and divide by its spread if asked for."""
    name, key = component(groupby)
    keys = {k: F.col(k) for k in cube.others(["t"])} | {f"cycle_{name}": key}
    stats = {f"_a_{v}": F.avg(cube.value(v)) for v in cube.variables} | {f"_s_{v}": F.stddev_pop(cube.value(v)) for v in cube.variables}
    made = {}
    for v in cube.variables:
        centred = cube.value(v) - F.col(f"`_a_{v}`")
        made[v] = F.when(F.col(f"`_s_{v}`") != 0, centred / F.col(f"`_s_{v}`")) if normalise else centred
    return _against_groups(cube, keys, stats, made)
