"""Teleconnections: correlation over time of each cell with one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.operators.select import select_point


def telemap(cube: Cube, lat: float, lon: float) -> Cube:
    """Pearson correlation over ``t`` of each cell's series with that of the cell nearest to a point."""
    if lat is None or lon is None:
        raise ValueError("telemap needs lat and lon")
    centre = select_point(cube, lon, lat)
    renamed = centre.df.select(*[d for d in centre.dims], *[centre.value(v).alias(f"_c{i}") for i, v in enumerate(cube.variables)])
    both = cube.df.join(renamed, list(centre.dims))  # one series: small enough to be broadcast by size
    keep = cube.others(["t"])
    made = [F.corr(cube.value(v), F.col(f"_c{i}")) for i, v in enumerate(cube.variables)]
    # no spread gives NaN: that is missing
    values = [F.when(~F.isnan(c), c).alias(v) for c, v in zip(made, cube.variables, strict=True)]
    return cube.with_df(both.groupBy(*keep).agg(*values), dims=keep)
