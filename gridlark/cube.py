"""The data model: a cube is a DataFrame of coordinate columns and value columns.

``t`` time, ``z`` level, ``y`` latitude, ``x`` longitude, ``e`` ensemble
member; the dimensions together are the key of a row. Missing values are
null, and an absent row is the same as a row of nulls.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("t", "z", "y", "x", "e", "m", "d")
#: Names on output.
STANDARD = {"t": "time", "z": "lev", "y": "lat", "x": "lon", "e": "ens", "m": "mode"}
#: How coordinate names begin; the dimensions' own letters stand for themselves only.
PREFIXES = {"lon": "x", "lat": "y", "lev": "z", "plev": "z", "time": "t", "ens": "e"}
#: Dimensions that arrays without named axes have, by their number.
BY_RANK = {1: ("t",), 2: ("y", "x"), 3: ("t", "y", "x"), 4: ("t", "z", "y", "x")}

DEGREE = 3.1415926536 / 180


def axis_of(name: str) -> str | None:
    """The dimension a coordinate's name stands for."""
    low = name.lower()
    if low in DIMS:
        return low
    return next((PREFIXES[p] for p in sorted(PREFIXES, key=len, reverse=True) if low.startswith(p)), None)


def parse_axes(axes: str | Iterable[str]) -> list[str]:
    """``"txy"`` or a list of dimensions, each once, in the order given."""
    out = list(dict.fromkeys(str(a).strip().lower() for a in (axes if not isinstance(axes, str) else re.sub(r"[\s,]", "", axes))))
    if bad := [a for a in out if a not in DIMS]:
        raise ValueError(f"no such axes: {bad}")
    return out


@dataclass(frozen=True)
class Cube:
    """A DataFrame with its dimensions, variables, attributes and the domains applied so far."""

    df: DataFrame
    dims: tuple[str, ...]
    variables: tuple[str, ...]
    attrs: dict[str, str] = field(default_factory=dict)
    domains: frozenset[str] = frozenset()

    @staticmethod
    def of(df: DataFrame, dims: Iterable[str] | None = None, variables: Iterable[str] | None = None, attrs: dict[str, str] | None = None) -> Cube:
        """Normalise names to ``t,z,y,x,e``, drop other columns, read NaN as missing."""
        wanted = list(dims) if dims is not None else [c for c in df.columns if axis_of(c)]
        values = list(variables) if variables is not None else [c for c in df.columns if c not in wanted]
        named = {c: axis_of(c) or c for c in wanted}
        kinds = dict(df.dtypes)
        columns = [F.col(f"`{c}`").alias(n) for c, n in named.items()]
        columns += [(F.when(~F.isnan(f"`{v}`"), F.col(f"`{v}`")) if kinds[v] in ("double", "float") else F.col(f"`{v}`")).cast("double").alias(v) for v in values]
        return Cube(df.select(*columns), tuple(named.values()), tuple(values), dict(attrs or {}))

    def with_df(self, df: DataFrame, dims: Iterable[str] | None = None, variables: Iterable[str] | None = None) -> Cube:
        return replace(self, df=df, dims=tuple(self.dims if dims is None else dims), variables=tuple(self.variables if variables is None else variables))

    def value(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def select(self, *names: str) -> Cube:
        """Variables by name."""
        if missing := [n for n in names if n not in self.variables]:
            raise KeyError(f"no such variables: {missing}")
        return self.with_df(self.df.select(*self.dims, *[self.value(n) for n in names]), variables=names)

    def matching(self, pattern: str) -> Cube:
        """Variables whose names a regular expression finds."""
        return self.select(*[v for v in self.variables if re.search(pattern, v)])

    def rename(self, names: dict[str, str]) -> Cube:
        new = [names.get(v, v) for v in self.variables]
        return self.with_df(self.df.select(*self.dims, *[self.value(v).alias(n) for v, n in zip(self.variables, new, strict=True)]), variables=new)

    def named(self, op: str) -> Cube:
        """Results of an operation on ``v`` are called ``op[v]``."""
        return self.rename({v: f"{op}[{v}]" for v in self.variables})

    def transpose(self, *dims: str) -> Cube:
        if sorted(dims) != sorted(self.dims):
            raise ValueError(f"not the dimensions {self.dims}: {dims}")
        return self.with_df(self.df.select(*dims, *[self.value(v) for v in self.variables]), dims=dims)

    def standard(self) -> DataFrame:
        """With coordinates called lon, lat, lev, time, ens and mode."""
        return self.df.select(*[F.col(d).alias(STANDARD.get(d, d)) for d in self.dims], *[self.value(v) for v in self.variables])

    def axis_length(self, dim: str) -> int:
        return self.df.select(dim).distinct().count()

    def shape(self, *dims: str) -> dict[str, int]:
        """The number of coordinates on each axis (or those asked for), in one pass."""
        wanted = [d for d in self.dims if not dims or d in dims]
        row = self.df.agg(F.count(F.lit(1)), *[F.count_distinct(d).alias(d) for d in wanted]).first()
        return {d: row[d] for d in wanted}

    def coordinates(self, *dims: str) -> dict[str, list]:
        """The coordinates of axes, ascending, in one pass; each is as long as the axis."""
        row = self.df.agg(*[F.sort_array(F.collect_set(d)).alias(d) for d in dims]).first()
        return {d: list(row[d]) for d in dims}

    def size(self) -> int:
        return self.df.count()

    def persist(self) -> Cube:
        return self.with_df(self.df.persist())

    def others(self, axes: Iterable[str]) -> list[str]:
        gone = set(axes)
        return [d for d in self.dims if d not in gone]

    def checked(self, axes: str | Iterable[str]) -> list[str]:
        out = parse_axes(axes)
        if not out:
            raise ValueError("axes are required")
        if missing := [a for a in out if a not in self.dims]:
            raise ValueError(f"the cube has no axes {missing}")
        return out


def latitude_weight() -> Column:
    return F.cos(F.col("y") * F.lit(DEGREE))
