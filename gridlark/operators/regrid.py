"""Other grids: conservative averages on uniform and Gaussian grids, bilinear alignment."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.cube import Cube

#: Grids whose coordinates differ by less are the same.
SAME = 1.0


def horizontal(cube: Cube) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes, ascending, in one job: as many as the grid has rows and columns."""
    found = cube.coordinates("y", "x")
    return np.array(found["y"], float), np.array(found["x"], float)


def edges(centres: np.ndarray, lowest: float | None = None, highest: float | None = None) -> np.ndarray:
    """Cell bounds half way between centres, half a step beyond the ends."""
    if len(centres) == 1:
        out = np.array([centres[0] - 0.5, centres[0] + 0.5])
    else:
        half = np.diff(centres) / 2
        out = np.concatenate([[centres[0] - half[0]], centres[:-1] + half, [centres[-1] + half[-1]]])
    return np.clip(out, lowest, highest) if lowest is not None else out


def parse_axis(spec: str, bounds: np.ndarray) -> np.ndarray:
    """Target centres: a step from the first bound on, or ``start:n:step``."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)"
    if m := re.fullmatch(rf"({number}):(\d+):({number})", spec):
        return float(m[1]) + float(m[3]) * np.arange(int(m[2]))
    if not re.fullmatch(number, spec) or float(spec) <= 0:
        raise ValueError(f"not an axis: {spec!r}")
    step = float(spec)
    return bounds[0] + step / 2 + step * np.arange(max(1, int((bounds[-1] - bounds[0]) // step)))


def gaussian_latitudes(n: int) -> np.ndarray:
    """Latitudes of a Gaussian grid: arc sines of the roots of the Legendre polynomial."""
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0]))


def target_grid(own: tuple[np.ndarray, np.ndarray], gridder: str) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of ``uniform~<dy>x<dx>`` or ``gaussian~<nlat>``, within a grid's extent."""
    kind, _, spec = gridder.partition("~")
    y, x = edges(own[0], -90.0, 90.0), edges(own[1])
    if kind == "uniform" and spec.count("x") == 1:
        dy, dx = spec.split("x")
        return parse_axis(dy, y), parse_axis(dx, x)
    if kind == "gaussian" and spec.isdecimal() and int(spec) > 0:
        lats = gaussian_latitudes(int(spec))
        inside = lats[(lats >= y[0]) & (lats <= y[-1])]
        return inside, parse_axis(repr(360 / (2 * int(spec))), x)
    raise ValueError(f"no such grid: {gridder!r}")


def _overlaps(cube: Cube, axis: str, source: np.ndarray, target: np.ndarray) -> DataFrame:
    """Source and target coordinates with the size of their overlap: sine of latitude, or degrees of longitude."""
    lowest, highest = (-90.0, 90.0) if axis == "y" else (None, None)
    s, t = edges(source, lowest, highest), edges(target, lowest, highest)
    measure = (lambda v: np.sin(np.radians(v))) if axis == "y" else (lambda v: v)
    rows = []
    for i, c in enumerate(source):
        first = max(0, int(np.searchsorted(t, s[i], side="right")) - 1)
        for k in range(first, len(target)):
            lo, hi = max(s[i], t[k]), min(s[i + 1], t[k + 1])
            if lo >= hi:
                if t[k] >= s[i + 1]:
                    break
                continue
            rows.append((float(c), float(target[k]), float(measure(hi) - measure(lo))))
    return cube.df.sparkSession.createDataFrame(rows, f"{axis} double, _o{axis} double, _w{axis} double")


def _apply(cube: Cube, wy: DataFrame, wx: DataFrame, complete: bool) -> Cube:
    keep = cube.others(["y", "x"])
    # tables of axis size; cells are combined by one aggregation with partial sums
    spread = cube.df.withColumns({"y": F.col("y").cast("double"), "x": F.col("x").cast("double")}).join(F.broadcast(wy), "y").join(F.broadcast(wx), "x")
    w = F.col("_wy") * F.col("_wx")
    made = []
    for v in cube.variables:
        c = cube.value(v)
        mean = F.sum(c * w) / F.sum(F.when(c.isNotNull(), w))
        made.append((F.when(F.sum(F.when(c.isNotNull(), w)) > 1 - 1e-9, mean) if complete else mean).alias(v))
    out = spread.groupBy(*keep, F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(*made)
    return cube.with_df(out.select(*cube.dims, *[cube.value(v) for v in cube.variables]))


def regrid(cube: Cube, gridder: str) -> Cube:
    """Averages over the cells of another grid, weighted by the area of overlap; missing cells have no weight."""
    own = horizontal(cube)
    y, x = target_grid(own, gridder)
    out = _apply(cube, _overlaps(cube, "y", own[0], y), _overlaps(cube, "x", own[1], x), False)
    return replace(out, attrs=out.attrs | {"grid": f"{gridder} of {out.attrs['grid']}"} if "grid" in out.attrs else out.attrs)


def _neighbours(cube: Cube, axis: str, source: np.ndarray, target: np.ndarray) -> DataFrame:
    rows = []
    for c in target:
        k = int(np.searchsorted(source, c))
        if k < len(source) and source[k] == c:
            rows.append((float(c), float(c), 1.0))
        elif 0 < k < len(source):
            part = float((c - source[k - 1]) / (source[k] - source[k - 1]))
            rows += [(float(source[k - 1]), float(c), 1 - part), (float(source[k]), float(c), part)]
    return cube.df.sparkSession.createDataFrame(rows, f"{axis} double, _o{axis} double, _w{axis} double")


def interpolate(cube: Cube, y: np.ndarray, x: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None) -> Cube:
    """Bilinear values at other coordinates; missing beyond the grid and beside missing cells."""
    own = own or horizontal(cube)
    out = _apply(cube, _neighbours(cube, "y", own[0], y), _neighbours(cube, "x", own[1], x), True)
    return replace(out, attrs={k: v for k, v in out.attrs.items() if k != "grid"})


def align(cubes: list[Cube], to: str = "lowest") -> list[Cube]:
    """Bring cubes to the grid of the coarsest (``lowest``) or finest (``highest``) of them; equal grids stay."""
    if to not in ("lowest", "highest"):
        raise ValueError(f"align to lowest or highest, not {to!r}")
    own = [horizontal(c) for c in cubes]  # one job a cube
    sizes = [len(y) * len(x) for y, x in own]
    goal = sizes.index((min if to == "lowest" else max)(sizes))
    out = []
    for c, grid in zip(cubes, own, strict=True):
        same = all(len(a) == len(b) and (len(a) == 0 or np.abs(a - b).max() < SAME) for a, b in zip(grid, own[goal], strict=True))
        out.append(c if same else interpolate(c, *own[goal], grid))
    return out
