"""Regions: bounds on axes, domains of several bounds, and the cells they select."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.cube import Cube, axis_of
from gridlark.functions.calendar import months_of, shift


@dataclass(frozen=True)
class Bounds:
    """A closed range on an axis, by value or by position; start = end is a point."""

    axis: str
    start: Any
    end: Any
    system: str = "values"
    step: int | None = None

    @staticmethod
    def parse(axis: str, spec: Any, names: dict[str, str] | None = None) -> Bounds:
        """From a number or time (a point) or a dict with start, end, system (or crs) and step.

        ``names`` tells dimensions for axes whose names say none.
        """
        dim = axis_of((names or {}).get(axis, axis))
        if dim is None:
            raise ValueError(f"no such axis: {axis!r}")
        if not isinstance(spec, dict):
            return Bounds(dim, spec, spec)
        system = spec.get("system", spec.get("crs"))
        if system is None:
            raise ValueError(f"bounds of {axis!r} need a system")
        low = str(system).lower()
        kind = "indices" if low.startswith("ind") else "values" if low.startswith(("val", "time")) else None
        if kind is None:
            raise ValueError(f"no such system: {system!r}")
        start = spec.get("start", spec.get("end"))
        step = spec.get("step")
        if step is not None and (int(step) != float(step) or int(step) < 1):
            raise ValueError(f"bounds of {axis!r} have a step of {step!r}: it counts coordinates")
        return Bounds(dim, start, spec.get("end", start), kind, None if step is None else int(step))

    @property
    def is_point(self) -> bool:
        return self.start == self.end

    def __and__(self, other: Bounds) -> Bounds:
        """The range both allow."""
        if (self.axis, self.system) != (other.axis, other.system):
            raise ValueError(f"bounds of {self.axis} by {self.system} and of {other.axis} by {other.system} do not intersect")
        return replace(self, start=max(self.start, other.start), end=min(self.end, other.end))

    def literal(self, value: Any) -> Column:
        return F.to_timestamp_ntz(F.lit(str(value))) if self.axis == "t" else F.lit(float(value))


@dataclass(frozen=True)
class Domain:
    """A named set of bounds, at most one an axis."""

    name: str
    bounds: tuple[Bounds, ...] = ()

    @staticmethod
    def parse(spec: dict[str, Any], names: dict[str, str] | None = None) -> Domain:
        """From a dictionary of bounds by axis; ``names`` of the spec itself, or given, rename unknown axes."""
        names = {**(names or {}), **spec.get("names", {})}
        rest = {k: v for k, v in spec.items() if k not in ("name", "names")}
        return Domain(str(spec.get("name", "d")), tuple(Bounds.parse(k, v, names) for k, v in rest.items()))

    def __and__(self, other: Domain) -> Domain:
        mine = {b.axis: b for b in self.bounds}
        for b in other.bounds:
            mine[b.axis] = mine[b.axis] & b if b.axis in mine else b
        return Domain(f"{self.name}-{other.name}", tuple(mine.values()))


def _comparable(cube: Cube, axis: str) -> Column:
    return F.col(axis).cast("timestamp_ntz") if axis == "t" else F.col(axis)


def _within(cube: Cube, b: Bounds) -> Column:
    """A range by value; longitudes are taken modulo 360."""
    c = _comparable(cube, b.axis)
    if b.axis == "x" and not b.is_point:
        width = float(b.end) - float(b.start)
        if width >= 360:
            return F.lit(True)
        plain = c.between(b.literal(b.start), b.literal(b.end))
        # a range wholly or partly beyond the data's own turn of the globe
        return plain | c.between(float(b.start) - 360, float(b.end) - 360) | c.between(float(b.start) + 360, float(b.end) + 360)
    return c.between(b.literal(b.start), b.literal(b.end))


def _nearest(cube: Cube, b: Bounds) -> DataFrame:
    """One row: the coordinate nearest to a point, the smaller one of equals."""
    c = _comparable(cube, b.axis)
    want = b.literal(b.start)
    away = F.abs(F.unix_micros(c.cast("timestamp")) - F.unix_micros(want.cast("timestamp"))) if b.axis == "t" else F.abs(c - want)
    return cube.df.agg(F.min_by(b.axis, F.struct(away.alias("away"), F.col(b.axis).alias("c"))).alias(b.axis))


def _positions(cube: Cube, b: Bounds) -> DataFrame:
    """The coordinates at positions start to end of the axis; the table has one row a coordinate."""
    order = Window.orderBy(b.axis)
    numbered = cube.df.select(b.axis).distinct().withColumn("_i", F.row_number().over(order) - 1)
    return numbered.where(F.col("_i").between(int(b.start), int(b.end)) & ((F.col("_i") - int(b.start)) % (b.step or 1) == 0)).select(b.axis)


def _stepped(cube: Cube, b: Bounds) -> DataFrame:
    """Every step-th coordinate of what a cube has on an axis: a row a coordinate."""
    numbered = cube.df.select(b.axis).distinct().withColumn("_i", F.row_number().over(Window.orderBy(b.axis)) - 1)
    return numbered.where(F.col("_i") % b.step == 0).select(b.axis)


def subset(cube: Cube, domain: Domain) -> Cube:
    """The cells of a cube inside a domain.

    Ranges by value are filters that reach the scan, of which a ``step`` keeps every so-manieth coordinate; a point takes the nearest
    coordinate and drops the axis; positions and points are joins with a table
    of a few coordinates, small as an axis is. Bounds on axes that the cube
    lacks are ignored. A domain that was applied before is not applied again.
    """
    if domain.name in cube.domains:
        return cube
    df, dims = cube.df, list(cube.dims)
    here = [b for b in domain.bounds if b.axis in dims]
    for b in here:
        if b.system == "values" and not b.is_point:
            df = df.where(_within(cube, b))
    ranged = cube.with_df(df)
    for b in here:
        if b.system == "indices":
            # positions count on the whole axis, not on what other bounds leave
            df = df.join(F.broadcast(_positions(cube, b)), b.axis, "left_semi")  # as many rows as positions asked for
        elif b.is_point:
            df = df.join(F.broadcast(_nearest(cube, b)), b.axis, "left_semi")  # one row
            dims.remove(b.axis)
        elif b.step and b.step > 1:
            df = df.join(_stepped(ranged, b), b.axis, "left_semi")
    out = ranged.with_df(df.select(*dims, *[cube.value(v) for v in cube.variables]), dims=dims)
    return replace(out, domains=cube.domains | {domain.name})


def select_point(cube: Cube, lon: float, lat: float) -> Cube:
    """The series of the cell nearest in both axes."""
    return subset(cube, Domain(f"point-{lon}-{lat}", (Bounds("x", lon, lon), Bounds("y", lat, lat))))


def filter_months(cube: Cube, selector: str | int) -> Cube:
    """The time steps in the selected months of any year."""
    return cube.with_df(cube.df.where(F.month("t").isin(months_of(selector))))


def lagged(cube: Cube, offset: str, domain: Domain | None = None) -> Cube:
    """Values from ``offset`` later, under the times asked for (a lag of two series)."""
    kind = dict(cube.df.dtypes)["t"]
    moved = cube.with_df(cube.df.withColumn("t", shift(F.col("t"), offset, -1, kind)))
    return subset(moved, domain) if domain else moved


def check_time(cube: Cube, domain: Domain) -> None:
    """An error if a time range lies outside the data."""
    for b in domain.bounds:
        if b.axis == "t" and b.system == "values" and not b.is_point and not cube.df.where(_within(cube, b)).limit(1).count():
            raise ValueError(f"no data between {b.start} and {b.end}")
