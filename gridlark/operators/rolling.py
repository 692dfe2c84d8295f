"""Centred windows along an axis: low-pass filter, detrending and smoothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlark.cube import Cube

#: Weights of the five-point smoother.
KERNEL = [0.13, 0.23, 0.28, 0.23, 0.13]


def densify(cube: Cube, axis: str = "t") -> Cube:
    """Give every cell a row at every coordinate of the axis, as windows count rows.

    The rows added are missing values; the table of coordinates is as small as
    the axis. A pass that counts cells, coordinates and rows comes first: a
    complete cube stays as it is, without distinct scans and a join.
    """
    keep = cube.others([axis])
    cell = F.struct(*keep) if keep else F.lit(1)
    cells, steps, rows = cube.df.agg(F.count_distinct(cell), F.count_distinct(axis), F.count(axis)).first()
    if cells * steps == rows:
        return cube
    coordinates = cube.df.select(axis).distinct()
    grid = cube.df.select(*keep).distinct().crossJoin(coordinates) if keep else coordinates
    return cube.with_df(grid.join(cube.df, [*keep, axis], "left").select(*cube.dims, *[cube.value(v) for v in cube.variables]))


def _frame(cube: Cube, axis: str, wsize: int):
    return Window.partitionBy(*cube.others([axis])).orderBy(axis).rowsBetween(-(wsize // 2), wsize - 1 - wsize // 2)


def _window(cube: Cube, axis: str | None, wsize: int | None) -> tuple[str, int]:
    axis = axis or cube.dims[0]
    cube.checked([axis])
    if wsize is None:
        wsize = max(1, cube.axis_length(axis) // 8)
    if wsize < 1:
        raise ValueError(f"not a window: {wsize}")
    return axis, wsize


def lowpass(cube: Cube, wsize: int | None = None, axis: str | None = "t", dense: bool = False) -> Cube:
    """Centred moving average over ``wsize`` rows (an eighth of the axis if not given).

    An even window has one row more before its centre; missing values are
    skipped, and the ends use what rows there are. The window moves along the
    series of a cell, so one exchange by cell serves all variables. ``dense``
    tells that no rows are absent.
    """
    axis, wsize = _window(cube, axis, wsize)
    full = cube if dense else densify(cube, axis)
    w = _frame(full, axis, wsize)
    return full.with_df(full.df.select(*full.dims, *[F.avg(full.value(v)).over(w).alias(v) for v in full.variables]))


def detrend(cube: Cube, wsize: int | None = None, axis: str | None = "t", dense: bool = False) -> Cube:
    """What the low-pass filter takes away: ``v`` minus its centred moving average."""
    axis, wsize = _window(cube, axis, wsize)
    full = cube if dense else densify(cube, axis)
    w = _frame(full, axis, wsize)
    return full.with_df(full.df.select(*full.dims, *[(full.value(v) - F.avg(full.value(v)).over(w)).alias(v) for v in full.variables]))


def smooth(cube: Cube, kernel: list[float] | None = None, axis: str = "t", dense: bool = False) -> Cube:
    """Weighted sum over neighbouring rows; beyond the ends, and where values are missing, they count as 0."""
    kernel = KERNEL if kernel is None else kernel
    full, half = cube if dense else densify(cube, axis), len(kernel) // 2
    w = Window.partitionBy(*full.others([axis])).orderBy(axis)

    def at(v: str, k: int):
        c = full.value(v)
        moved = F.lag(c, half - k).over(w) if k <= half else F.lead(c, k - half).over(w)
        return F.coalesce(moved, F.lit(0.0)) * kernel[k]

    return full.with_df(full.df.select(*full.dims, *[sum((at(v, k) for k in range(1, len(kernel))), at(v, 0)).alias(v) for v in full.variables]))
