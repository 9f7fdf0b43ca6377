"""Plan steps and their canonical JSON."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from decimal import Decimal

from tabflow.errors import invalid
from tabflow.functions import expr as E

#: The operators of a plan.
OPS = {
    "identity", "compute", "filter", "select", "drop", "rename", "sort", "cast", "datasource", "data_step",
    "transpose", "sql_select", "format", "aggregate", "summary", "save", "assert", "let_scalar", "const",
}
#: Operators whose parameters are plain JSON and expressions, so that a plan of them can be read back.
KERNEL = {"identity", "compute", "filter", "select", "drop", "rename", "sort", "cast", "datasource", "aggregate", "save", "assert", "let_scalar", "const"}


@dataclass
class OpStep:
    op: str
    inputs: list[str]
    outputs: list[str]
    params: dict = field(default_factory=dict)
    line: int | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise invalid("UNSUPPORTED_OP", f"no operator {self.op!r}", self.line)


@dataclass
class Plan:
    steps: list[OpStep]
    sources: dict[str, dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def check(self, tables: set[str]) -> None:
        """Every input exists, every table has one producer."""
        known = set(tables)
        made: set[str] = set()
        for s in self.steps:
            for i in s.inputs:
                if i not in known:
                    raise invalid("E_UNKNOWN_TABLE", f"no table {i!r}", s.line)
            for o in s.outputs:
                if o in made:
                    raise invalid("E_OUTPUT_COLLISION", f"two steps make {o!r}", s.line)
                made.add(o)
                known.add(o)

    def invariants(self, strict: bool = False) -> list[str]:
        """Warnings about a plan that is to run by itself; what breaks it is refused.

        Something must be saved, nothing twice to one place, and each saved table must come
        from a datasource.  Tables that nothing uses and steps that no save needs are
        warnings, with ``strict`` refused too.
        """
        maker = {o: s for s in self.steps for o in s.outputs}
        saves = [s for s in self.steps if s.op == "save"]
        if not saves:
            raise invalid("E_PLAN_NO_SAVE", "a plan saves one table at least")
        places = [(s.inputs[0], s.params.get("path")) for s in saves]
        if len(set(places)) < len(places):
            raise invalid("E_PLAN_SAVED_TWICE", "a table is saved twice to one place")

        def upstream(steps: list[OpStep]) -> list[OpStep]:
            todo, seen = list(steps), []
            while todo:
                s = todo.pop()
                if not any(s is x for x in seen):
                    seen.append(s)
                    todo += [maker[i] for i in s.inputs if i in maker]
            return seen

        for s in saves:
            if not any(x.op == "datasource" for x in upstream([s])):
                raise invalid("E_PLAN_UNTRACED", f"{s.inputs[0]!r} is saved but comes from no datasource", s.line)
        used = {i for s in self.steps for i in s.inputs}
        warnings = [f"table {o!r} is neither used nor saved" for o in maker if o not in used]
        needed = upstream([s for s in self.steps if s.op in ("save", "assert")])
        plain_ops = ("const", "let_scalar", "format")
        warnings += [f"step {s.op} of {', '.join(s.outputs)!r} adds to no save" for s in self.steps if s.op not in plain_ops and not any(s is x for x in needed)]
        if strict and warnings:
            raise invalid("E_PLAN_STRICT", "; ".join(warnings))
        return warnings

    def needed(self, wanted: set[str]) -> list[OpStep]:
        """The steps that the wanted tables, saves and assertions depend on."""
        need, keep = set(wanted), []
        for s in reversed(self.steps):
            if s.op in ("save", "assert", "format", "const", "let_scalar") or need & set(s.outputs):
                keep.append(s)
                need |= set(s.inputs)
        return keep[::-1]

    def order(self) -> list[OpStep]:
        """Steps after their inputs, otherwise by their outputs' names (a canonical topological order)."""
        left = list(self.steps)
        made = {o for s in self.steps for o in s.outputs}
        done: set[str] = set()
        out = []
        while left:
            ready = sorted((s for s in left if all(i in done or i not in made for i in s.inputs)), key=lambda s: (s.outputs, s.op, json.dumps(plain(s.params), sort_keys=True)))
            if not ready:
                raise invalid("E_PLAN_CYCLE", "steps depend on each other in a circle")
            out.append(ready[0])
            left.remove(ready[0])
            done |= set(ready[0].outputs)
        return out


def plain(x: object) -> object:
    """Any parameter as JSON."""
    if isinstance(x, E.Lit | E.Ref | E.Binary | E.Logic | E.Call):
        return E.to_json(x)
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {"kind": type(x).__name__.lower()} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x) if f.name != "line"}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, Decimal):
        return {"type": "decimal", "value": format(x, "f")}
    return x


def canonical(x: object) -> str:
    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(x: object) -> str:
    return hashlib.sha256(canonical(x).encode()).hexdigest()


def transform_id(s: OpStep) -> str:
    return digest({"op": s.op, "params": s.params})


def transform_class_id(s: OpStep) -> str:
    """The same for steps that differ in literals only."""

    def blank(x: object) -> object:
        if isinstance(x, dict):
            if x.get("type") in ("literal", "decimal"):
                return {"type": "literal"}
            return {k: blank(v) for k, v in x.items()}
        return [blank(v) for v in x] if isinstance(x, list) else x

    return digest({"op": s.op, "params": blank(plain(s.params))})


def step_id(s: OpStep) -> str:
    return digest({"transform_id": transform_id(s), "inputs": s.inputs, "outputs": s.outputs})


def to_json(plan: Plan) -> dict:
    steps = [{"id": step_id(s), "transform_id": transform_id(s), "class_id": transform_class_id(s), "op": s.op, "inputs": s.inputs, "outputs": s.outputs, "params": plain(s.params)} for s in plan.order()]
    return {"version": 1, "sources": plain(plan.sources), "steps": steps}


def _read(x: object) -> object:
    if isinstance(x, dict):
        if "type" in x and x["type"] in ("literal", "decimal", "column", "binary", "logic", "call"):
            return E.from_json(x)
        return {k: _read(v) for k, v in x.items()}
    return [_read(v) for v in x] if isinstance(x, list) else x


def from_json(d: dict) -> Plan:
    """A plan of kernel steps; identities are checked."""
    if d.get("version") != 1:
        raise invalid("E_PLAN_VERSION", "unknown plan version")
    steps = []
    for s in d["steps"]:
        if s["op"] not in KERNEL:
            raise invalid("E_PLAN_OP", f"{s['op']} can't be read from a plan")
        step = OpStep(s["op"], list(s["inputs"]), list(s["outputs"]), _read(s["params"]))
        if "id" in s and s["id"] != step_id(step):
            raise invalid("E_PLAN_ID", f"step {s['id'][:12]} isn't what its id says")
        steps.append(step)
    return Plan(steps, {k: dict(v) for k, v in d.get("sources", {}).items()})
