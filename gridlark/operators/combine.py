"""Several cubes: arithmetic on matching cells, ensembles, merges, and the best of several results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.cube import Cube

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b),
}


def _matched(a: Cube, b: Cube, how: str = "inner"):
    """Join on the dimensions both have; the side that lacks some is joined to each of the others' cells.

    Cubes that share no dimension do not match, unless the second has none at all: it is one row.
    """
    shared = [d for d in a.dims if d in b.dims]
    if not shared and b.dims:
        raise ValueError(f"the cubes share no dimensions: {a.dims} and {b.dims}")
    left = a.df.select(*a.dims, *[a.value(v).alias(f"_a{i}") for i, v in enumerate(a.variables)])
    right = b.df.select(*b.dims, *[b.value(v).alias(f"_b{i}") for i, v in enumerate(b.variables)])
    joined = left.join(right, shared, how) if shared else left.crossJoin(F.broadcast(right))  # a scalar
    return joined, [*a.dims, *[d for d in b.dims if d not in a.dims]]


def arithmetic(op: str, a: Cube, b: Cube | float, by_name: bool = False) -> Cube:
    """``a op b`` where both have a cell; variables in order, or by name.

    By name, ``+`` takes over what only ``b`` has (on the cells they share);
    the others leave it out. A division by 0 is missing.
    """
    f = OPERATORS[op]
    if not isinstance(b, Cube):
        return a.with_df(a.df.select(*a.dims, *[f(a.value(v), F.lit(float(b))).alias(v) for v in a.variables]))
    joined, dims = _matched(a, b)
    if not by_name:
        if len(b.variables) not in (1, len(a.variables)):
            raise ValueError("the cubes have different numbers of variables")
        right = [0] * len(a.variables) if len(b.variables) == 1 else range(len(b.variables))
        made = {v: f(F.col(f"_a{i}"), F.col(f"_b{j}")) for (i, v), j in zip(enumerate(a.variables), right, strict=True)}
    else:
        made = {v: f(F.col(f"_a{i}"), F.col(f"_b{b.variables.index(v)}")) if v in b.variables else F.col(f"_a{i}") for i, v in enumerate(a.variables)}
        if op == "+":
            made |= {v: F.col(f"_b{j}") for j, v in enumerate(b.variables) if v not in a.variables}
    return a.with_df(joined.select(*dims, *[c.alias(v) for v, c in made.items()]), dims=dims, variables=made)


def diff(a: Cube, b: Cube) -> Cube:
    """The first minus the second where both have a cell."""
    return arithmetic("-", a, b)


def ensemble(cubes: list[Cube]) -> Cube:
    """Put cubes side by side along a new dimension ``e``, numbered from 0; variables as in the first, by position."""
    first = cubes[0]
    if any(len(c.variables) != len(first.variables) or set(c.dims) != set(first.dims) for c in cubes):
        raise ValueError("members of an ensemble need the same dimensions and numbers of variables")
    named = [c.rename(dict(zip(c.variables, first.variables, strict=True))) for c in cubes]
    rows = [c.df.select(F.lit(k).alias("e"), *first.dims, *[c.value(v) for v in first.variables]) for k, c in enumerate(named)]
    return first.with_df(fold(lambda p, q: p.unionByName(q), rows), dims=["e", *first.dims])


def merge(cubes: list[Cube]) -> Cube:
    """One cube of all variables; cells that only some have are missing in the others."""
    names = [v for c in cubes for v in c.variables]
    if len(set(names)) != len(names):
        raise ValueError(f"variables in several cubes: {sorted({n for n in names if names.count(n) > 1})}")
    if any(set(c.dims) != set(cubes[0].dims) for c in cubes):
        raise ValueError("cubes to be merged need the same dimensions")
    dims = list(cubes[0].dims)
    df = fold(lambda p, q: p.join(q, dims, "full"), [c.df for c in cubes])
    return cubes[0].with_df(df.select(*dims, *[F.col(f"`{n}`") for n in names]), variables=names)


def union_rows(cubes: list[Cube]) -> Cube:
    """Files or periods of one dataset, one after another; variables missing in some are missing values."""
    df = fold(lambda p, q: p.unionByName(q, allowMissingColumns=True), [c.df for c in cubes])
    names = list(dict.fromkeys(v for c in cubes for v in c.variables))
    return cubes[0].with_df(df.select(*cubes[0].dims, *[F.col(f"`{n}`") for n in names]), variables=names)


def best_of(cubes: list[Cube], rule: str) -> Cube:
    """The cube whose attribute is smallest or largest, by a rule such as ``min:loss``; the first of equals."""
    kind, _, name = rule.partition(":")
    if kind not in ("min", "max") or not name:
        raise ValueError(f"not a rule: {rule!r}")
    return (min if kind == "min" else max)(cubes, key=lambda c: float(c.attrs[name]))


def largest(cubes: list[Cube], lowest: bool = False) -> Cube:
    """The cube with the finest (or coarsest) horizontal grid."""
    sizes = [fold(lambda p, q: p * q, c.shape("x", "y").values(), 1) for c in cubes]
    return cubes[sizes.index((min if lowest else max)(sizes))]
