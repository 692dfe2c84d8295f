"""Run a request: read its variables and chain the functions its operations name; Spark's lineage is the graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridlark.cube import Cube
from gridlark.functions.calendar import bytes_of
from gridlark.operators import combine, resample
from gridlark.operators.regrid import align
from gridlark.operators.select import check_time, lagged, subset
from gridlark.plans.registry import DESCRIPTIVE, Kernel, describe, kernel
from gridlark.plans.request import Operation, Request, Variable
from gridlark.sources.readers import Address, Archive, Catalogue, Policy, read_files


@dataclass
class Kept:
    """Cubes that stay in Spark's storage, up to a size; the oldest go first."""

    limit: str = "500M"
    cubes: dict[str, tuple[Cube, int]] = field(default_factory=dict)

    def get(self, key: str) -> Cube | None:
        return self.cubes[key][0] if key in self.cubes else None

    def put(self, key: str, cube: Cube) -> Cube:
        """Persist a cube; its size is that of its cells at 8 bytes a value."""
        self.drop(key)
        kept = cube.persist()
        self.cubes[key] = (kept, 8 * kept.size() * (len(kept.dims) + len(kept.variables)))
        while sum(n for _, n in self.cubes.values()) > bytes_of(self.limit) and len(self.cubes) > 1:
            self.drop(next(iter(self.cubes)))
        return kept

    def drop(self, key: str | None = None) -> None:
        """Release a cube, or all."""
        for k in [key] if key is not None else list(self.cubes):
            if k in self.cubes:
                self.cubes.pop(k)[0].df.unpersist()


@dataclass
class Engine:
    """Where sources are found, and what may be opened."""

    spark: SparkSession
    catalogue: Catalogue | None = None
    archive: Archive | None = None
    policy: Policy = field(default_factory=Policy)
    cubes: dict[str, Cube] = field(default_factory=dict)  # named cubes, for ``view:<name>``
    kept: Kept = field(default_factory=Kept)  # inputs with ``cache``, and what several operations use

    def open(self, v: Variable, request: Request) -> dict[str, Cube]:
        """Each variable by id: renamed, shifted by its offset, cut to its domain.

        A time range without data is an error. ``cache`` of a variable: ``opt``
        takes what an earlier request kept under these ids, or keeps it;
        ``req`` needs it to be kept; ``ig``, or nothing, reads anew.
        """
        ids = [own for _, own in v.names]
        if v.cache in ("opt", "req"):
            found = {own: self.kept.get(f"input:{own}") for own in ids}
            if all(found.values()):
                return found
            if v.cache == "req":
                raise KeyError(f"not kept: {[own for own in ids if not found[own]]}")
        parts = self._read(v, request)
        domain = request.domains.get(v.domain) if v.domain else None
        grid = "|".join([v.uri, v.domain or ""])
        out = {}
        for name, own in v.names:
            cube = next(p for p in parts if name in p.variables).select(name).rename({name: own})
            cube = replace(cube, attrs=cube.attrs | {"grid": grid})
            if v.offset:
                cube = lagged(cube, v.offset, domain)
            elif domain:
                check_time(cube, domain)
                cube = subset(cube, domain)
            out[own] = self.kept.put(f"input:{own}", cube) if v.cache == "opt" else cube
        return out

    def _read(self, v: Variable, request: Request) -> list[Cube]:
        """The cubes of a source that hold the variables."""
        address = Address.parse(v.uri, self.policy)
        names = [n for n, _ in v.names]
        times = self._times(v, request)
        if address.kind == "view":
            whole = self.cubes[address.path] if address.path in self.cubes else Cube.of(self.spark.table(address.path))
            return [whole.select(*names)]
        if address.kind == "file":
            return [Cube.of(read_files(self.spark, address.path)).select(*names)]
        if address.kind == "archive" and self.archive is not None:
            return [self.archive.open(self.spark, address.path, names, tuple(t and t.year for t in times))]
        if address.kind == "collection" and self.catalogue is not None:
            where = self.catalogue.collection(self.spark, address.path)
            opened = self.catalogue.open(self.spark, address.path, names, *[t and t.replace(tzinfo=timezone.utc).timestamp() / 60 for t in times])
            return [Cube.of(df).select(*[n for n in names if where[n] == a]) for a, df in opened.items()]
        raise ValueError(f"the engine has nothing that reads sources of kind {address.kind}")

    @staticmethod
    def _times(v: Variable, request: Request) -> tuple[datetime | None, datetime | None]:
        """The time range a variable is cut to, to prune files by; open if it is shifted or a point."""
        bounds = [b for b in request.domains[v.domain].bounds if b.axis == "t"] if v.domain and not v.offset else []
        if not bounds or bounds[0].system != "values" or bounds[0].is_point:
            return None, None
        return tuple(datetime.fromisoformat(str(x)) for x in (bounds[0].start, bounds[0].end))

    def run(self, spec: str | dict[str, Any] | Request) -> dict[str, list[Cube]]:
        """The results that no other operation uses, by id; several cubes if an operation gives several.

        Only plans are built here, but for grids that are compared, what is
        archived and what is kept. A result that several operations use is kept in Spark's storage
        until ``kept.drop()``.
        """
        request = spec if isinstance(spec, Request) else Request.parse(spec)
        made: dict[str, list[Cube]] = {}
        for v in request.variables:
            made |= {own: [c] for own, c in self.open(v, request).items()}
        uses = [i for o in request.operations for c in o.connectors for i in c.inputs]
        by_output = {c.output: o for o in request.operations for c in o.connectors}
        under_way: set[str] = set()

        def of(i: str) -> list[Cube]:
            if i not in made:
                o = by_output[i]
                if i in under_way:
                    raise ValueError(f"{o.name} waits for its own result")
                under_way.add(i)
                for c in o.connectors:
                    for x in c.inputs:
                        of(x)
                for output, cubes in self.apply(o, made, request).items():
                    made[output] = [self.kept.put(f"branch:{output}:{k}", c) for k, c in enumerate(cubes)] if uses.count(output) > 1 else cubes
            return made[i]

        return {i: of(i) for i in by_output if i not in uses}

    def apply(self, o: Operation, made: dict[str, list[Cube]], request: Request) -> dict[str, list[Cube]]:
        """The results of an operation, by id, from those of its inputs.

        Inputs taken together are cut to each other's domains and brought to
        one grid. What the operation does not know is an error.
        """
        k = kernel(o.name)
        params = self._params(o, k)
        keys = resample.grouping(o.groupby, o.resample) if k.grouped else {}
        out = {}
        for connector in o.connectors:
            cubes = [c for i in connector.inputs for c in made[i]]
            axes = list(o.axes)
            members = "e" in axes and not any("e" in c.dims for c in cubes)
            if (k.together or members) and len(cubes) > 1:
                for name in sorted(set().union(*[c.domains for c in cubes]) & set(request.domains)):
                    cubes = [subset(c, request.domains[name]) for c in cubes]
            if o.domain:
                cubes = [subset(c, request.domains[o.domain]) for c in cubes]
            grids = {c.attrs.get("grid") for c in cubes}
            if len(cubes) > 1 and (o.align or k.together or members) and (len(grids) > 1 or None in grids) and all({"x", "y"} <= set(c.dims) for c in cubes):
                cubes = align(cubes, o.align or "lowest")
            if members:
                cubes = [combine.ensemble(cubes)]
            if o.resample and not k.grouped:
                cubes = [resample.time_resample(c, o.resample, "mean").rename({f"mean[{v}]": v for v in c.variables}) for c in cubes]
            found = k.run(cubes, axes, keys, params)
            if o.op not in ("eof", "worldclim"):
                found = [c.named(o.op) if c.variables and not c.variables[0].startswith(f"{o.op}[") else c for c in found]
            found = [combine.best_of(found, o.merge)] if o.merge else found
            found = [replace(c, attrs=c.attrs | {"rid": f"{o.name}[{connector.output}]"}) for c in found]
            out[connector.output] = self._archived(o, connector.output, found) if o.archive else found
        return out

    @staticmethod
    def _params(o: Operation, k: Kernel) -> dict[str, Any]:
        """The parameters of an operation, checked."""
        params = dict(o.params) | ({"result": o.result} if o.result else {})
        if "groupby" in k.optional and not k.grouped and o.groupby:
            params["groupby"] = o.groupby
        elif o.groupby and not k.grouped:
            raise ValueError(f"{o.name} does not work within groups")
        for pattern in k.required:
            if not any(re.fullmatch(pattern, p) for p in params):
                raise ValueError(f"{o.name} needs {pattern}")
        for p in params:
            if p not in (*k.optional, *DESCRIPTIVE, "result") and not any(re.fullmatch(x, p) for x in k.required):
                raise ValueError(f"{o.name} has no parameter {p}")
        return params

    def _archived(self, o: Operation, output: str, cubes: list[Cube]) -> list[Cube]:
        """Save results under the result's id (``-1``, ``-2`` after it for further cubes) and go on with what was saved."""
        if self.archive is None:
            raise ValueError("the engine has no archive")
        names = [(o.result or output) + (f"-{n}" if n else "") for n in range(len(cubes))]
        for name, c in zip(names, cubes, strict=True):
            self.archive.save(c, name)
        return [self.archive.open(self.spark, name) for name in names]

    def frames(self, spec: str | dict[str, Any] | Request) -> dict[str, DataFrame]:
        """Results with standard names of coordinates; those that share dimensions are merged."""
        out = {}
        for own, cubes in self.run(spec).items():
            groups: dict[frozenset, list[Cube]] = {}
            for c in cubes:
                groups.setdefault(frozenset(c.dims), []).append(c)
            for n, same in enumerate(groups.values()):
                names = [v for c in same for v in c.variables]
                if len(set(names)) < len(names):  # inputs with equal names: told apart by number
                    same = [c.rename({v: f"{v}-{k}" for v in c.variables}) for k, c in enumerate(same)]
                out[own if not n else f"{own}-{n}"] = combine.merge(same).standard()
        return out

    def capabilities(self, collections: list[str] | None = None) -> DataFrame:
        """Operations with their parameters, and the variables of collections with their axes."""
        rows = [("operation", d["name"], d["title"], ",".join(d["required"]), ",".join(d["optional"])) for d in describe()]
        out = self.spark.createDataFrame(rows, "kind string, name string, title string, required string, optional string")
        for name in collections or []:
            found = self.catalogue.listing(self.spark, name).selectExpr("'variable' AS kind", f"concat('{name}/', variable) AS name", "aggregation AS title", "axes AS required", "shape AS optional")
            out = out.unionByName(found)
        return out

    def metrics(self) -> DataFrame:
        """What the cluster has and does now."""
        sc = self.spark.sparkContext
        status = sc.statusTracker()
        rows = [("default_parallelism", float(sc.defaultParallelism)), ("executors", float(sc._jsc.sc().getExecutorMemoryStatus().size())), ("active_jobs", float(len(status.getActiveJobsIds()))), ("active_stages", float(len(status.getActiveStageIds())))]
        return self.spark.createDataFrame(rows, "name string, value double")


def by_operation(cubes: dict[str, list[Cube]], op: str) -> dict[str, list[Cube]]:
    """Of results by id, those that an operation made."""
    return {i: found for i, c in cubes.items() if (found := [x for x in c if x.attrs.get("rid", "").split("[")[0].split(".")[-1].lower() == op.lower()])}
