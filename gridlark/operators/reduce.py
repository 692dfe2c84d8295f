"""Reductions over axes: weighted and plain means, extremes, sums, medians and spreads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.cube import Cube, latitude_weight

OPS = ("ave", "mean", "max", "min", "sum", "med", "std", "var")


def aggregate(op: str, v: Column, weighted: bool = False, mask: bool = True, accuracy: int | None = None) -> Column:
    """The aggregate of one variable; nulls are skipped, and a sum of nulls is 0."""
    if op == "ave" and weighted:
        w = latitude_weight()
        return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w) if mask else w)
    if op in ("ave", "mean"):
        return F.avg(v)
    if op == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    if op == "med":
        return F.median(v) if accuracy is None else F.percentile_approx(v, 0.5, accuracy)
    if op in ("max", "min", "std", "var"):
        return {"max": F.max, "min": F.min, "std": F.stddev_pop, "var": F.var_pop}[op](v)
    raise ValueError(f"no such reduction: {op!r}")


def reduce(cube: Cube, op: str, axes: str | Iterable[str], keys: dict[str, Column] | None = None, joint: bool = False, mask: bool = True, accuracy: int | None = None) -> Cube:
    """Reduce a cube over axes, within groups of ``keys`` if there are any.

    With ``t`` and other axes the others are reduced first, then ``t`` (a mean
    of means, a spread of spreads); ``joint`` reduces them together. ``ave``
    over ``y`` weighs by the cosine of latitude, with weights only of cells
    that have a value, unless ``mask`` is off. Spreads are those of a
    population. ``accuracy`` replaces the exact median, whose state grows with
    the distinct values of a group, by a sketch of fixed size.

    All variables and groups go through one partial and one final aggregation
    per stage, so the shuffle carries a row per group and task.
    """
    over = cube.checked(axes)
    keys = keys or {}
    if "t" in over and len(over) > 1 and not joint:
        space = [a for a in over if a != "t"]
        return reduce(reduce(cube, op, space, None, True, mask, accuracy), op, ["t"], keys, True, mask, accuracy)
    keep = cube.others(over)
    group = [F.col(k) for k in keep] + [expression.alias(name) for name, expression in keys.items()]
    values = [aggregate(op, cube.value(v), "y" in over, mask, accuracy).alias(v) for v in cube.variables]
    return cube.with_df(cube.df.groupBy(*group).agg(*values), dims=[*keep, *keys])


def reduce_many(cube: Cube, ops: Iterable[str], axes: str | Iterable[str], keys: dict[str, Column] | None = None) -> Cube:
    """Several reductions in one pass; results are called ``op[v]``."""
    over, keys = cube.checked(axes), keys or {}
    keep = cube.others(over)
    group = [F.col(k) for k in keep] + [expression.alias(name) for name, expression in keys.items()]
    made = {f"{op}[{v}]": aggregate(op, cube.value(v), "y" in over) for op in ops for v in cube.variables}
    return cube.with_df(cube.df.groupBy(*group).agg(*[c.alias(n) for n, c in made.items()]), dims=[*keep, *keys], variables=made)


def arg_extreme(cube: Cube, variable: str, axis: str, largest: bool = True) -> Cube:
    """The coordinate on ``axis`` of the extreme value, the first one of equals."""
    keep = cube.others([axis])
    v = cube.value(variable)
    extreme = cube.df.groupBy(*keep).agg((F.max(v) if largest else F.min(v)).alias("_v"))
    at = cube.df.select(*cube.dims, v.alias("_v")).join(extreme, [*keep, "_v"]).groupBy(*keep).agg(F.min(axis).alias(axis))
    return cube.with_df(at, dims=keep, variables=[axis])
