"""Requests: domains, variables and operations, as dictionaries or as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from gridlark.cube import parse_axes
from gridlark.operators.select import Domain
from gridlark.sources.readers import parse_variables

#: Options that every operation has, besides its inputs, axes and own parameters.
OPTIONS = ("domain", "groupby", "resample", "align", "result", "merge")
#: How an input may use what the engine keeps: if it is there, only if it is there, or not at all.
CACHES = (None, "opt", "req", "ig")


def flag(value: Any, default: bool = False) -> bool:
    """A boolean parameter; ``"false"`` is false."""
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "t", "yes", "y")


@dataclass(frozen=True)
class Variable:
    """A source and the variables read from it, by id."""

    uri: str
    names: tuple[tuple[str, str], ...]
    domain: str | None = None
    offset: str | None = None
    cache: str | None = None

    @staticmethod
    def parse(spec: dict[str, Any]) -> Variable:
        uri = spec.get("uri") or next((f"{k}:{spec[k]}" for k in ("collection", "file", "archive", "view", "dap") if k in spec), None)
        names = spec.get("name", spec.get("input"))
        if not uri or not names:
            raise ValueError(f"a variable needs uri and name: {spec}")
        if spec.get("cache") not in CACHES:
            raise ValueError(f"cache is one of opt, req and ig: {spec}")
        return Variable(uri, tuple(parse_variables(names)), spec.get("domain"), spec.get("offset"), spec.get("cache"))


@dataclass(frozen=True)
class Connector:
    """Inputs that go through an operation together, and the id of what comes out."""

    inputs: tuple[str, ...]
    output: str


def parse_connectors(text: str | list[str], default: str) -> list[Connector]:
    """``v0:a;v1,v2:b`` as connectors; an ``:out`` closes one, ``,`` and ``;`` part the inputs of one."""
    text = ",".join(text) if isinstance(text, list) else text
    out, waiting = [], []
    for entry in filter(None, (e.strip() for e in re.split(r"[,;]", text))):
        name, mark, result = entry.replace("|", ":").partition(":")
        waiting.append(name.strip())
        if mark:
            out.append(Connector(tuple(waiting), result.strip()))
            waiting = []
    if waiting:
        out.append(Connector(tuple(waiting), default))
    return out


@dataclass(frozen=True)
class Operation:
    name: str  # module.op
    connectors: tuple[Connector, ...]
    axes: tuple[str, ...] = ()
    domain: str | None = None
    groupby: str | None = None
    resample: str | None = None
    align: str | None = None
    result: str | None = None
    merge: str | None = None  # of several results the best, such as ``min:loss``
    archive: bool = False  # whether results are saved
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def op(self) -> str:
        return re.split(r"[.:]", self.name)[-1].lower()

    @staticmethod
    def parse(spec: dict[str, Any], number: int = 0) -> Operation:
        rest = dict(spec)
        name = str(rest.pop("name"))
        default = rest.get("result") or f"{re.split('[.:]', name)[-1]}-{number}"
        connectors = tuple(parse_connectors(rest.pop("input", rest.pop("inputs", "")), default))
        axes = rest.pop("axes", rest.pop("axis", ""))
        known = {k: rest.pop(k, None) for k in OPTIONS} | {"archive": flag(rest.pop("archive", None))}
        axes = ["e" if a == "ens" else a for a in (axes if isinstance(axes, list) else [axes.replace("ens", "e")])]
        return Operation(name, connectors, tuple(parse_axes("".join(axes))), params=rest, **known)

    def serialise(self) -> str:
        """One line of JSON that ``Operation.parse`` reads again."""
        inputs = ";".join(",".join(c.inputs) + f":{c.output}" for c in self.connectors)
        known = {k: v for k in (*OPTIONS, "archive") if (v := getattr(self, k))}
        return json.dumps({"name": self.name, "input": inputs, "axes": "".join(self.axes), **known, **self.params}, sort_keys=True)


@dataclass(frozen=True)
class Request:
    domains: dict[str, Domain]
    variables: tuple[Variable, ...]
    operations: tuple[Operation, ...]

    @staticmethod
    def parse(spec: str | dict[str, Any]) -> Request:
        """From a dictionary or its JSON; ``input`` stands for ``variable`` as well. Ids must be unique and known."""
        raw = json.loads(spec) if isinstance(spec, str) else spec
        get = lambda *names: next((raw[n] for n in names if n in raw), [])
        domains = {d.name: d for d in map(Domain.parse, get("domain", "domains"))}
        variables = tuple(map(Variable.parse, get("variable", "variables", "input")))
        operations = tuple(Operation.parse(o, k) for k, o in enumerate(get("operation", "operations")))
        ids = [own for v in variables for _, own in v.names] + [c.output for o in operations for c in o.connectors]
        if twice := sorted({i for i in ids if ids.count(i) > 1}):
            raise ValueError(f"ids that occur twice: {twice}")
        used = {i for o in operations for c in o.connectors for i in c.inputs}
        if missing := sorted(used - set(ids)):
            raise ValueError(f"no such inputs: {missing}")
        named = {n for x in (*variables, *operations) if (n := x.domain)}
        if missing := sorted(named - set(domains)):
            raise ValueError(f"no such domains: {missing}")
        return Request(domains, variables, operations)
