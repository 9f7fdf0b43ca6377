"""Column lineage, table effects and the step graph of a plan."""

from __future__ import annotations

from collections.abc import Mapping

from tabflow.errors import invalid
from tabflow.functions import expr as E
from tabflow.operators import datastep as D
from tabflow.plans.ir import OpStep, Plan, digest, step_id, transform_id


def step_graph(plan: Plan) -> dict:
    """Steps and tables as the two kinds of nodes of a graph; every table has one producer."""
    nodes, edges, maker = [], [], {}
    for s in plan.steps:
        sid = f"s:{step_id(s)[:16]}"
        nodes.append({"id": sid, "kind": "step", "op": s.op, "transform": transform_id(s)[:16]})
        for i in s.inputs:
            edges.append({"from": f"t:{i}", "to": sid})
        for o in s.outputs:
            if o in maker:
                raise invalid("E_OUTPUT_COLLISION", f"two steps make {o!r}")
            maker[o] = sid
            edges.append({"from": sid, "to": f"t:{o}"})
    tables = sorted({e["from"] for e in edges if e["from"].startswith("t:")} | {e["to"] for e in edges if e["to"].startswith("t:")})
    nodes += [{"id": t, "kind": "table", "producer": maker.get(t[2:])} for t in tables]
    return {"nodes": sorted(nodes, key=lambda n: n["id"]), "edges": sorted(edges, key=lambda e: (e["from"], e["to"]))}


def column_lineage(plan: Plan, schemas: Mapping[str, list[str]]) -> dict:
    """Nodes ``table.column`` with their origin, and flow, rename and derivation edges.  ``schemas``: columns of all tables."""
    nodes: dict[str, str] = {}
    edges: set[tuple[str, str, str]] = set()
    made = {o for s in plan.steps for o in s.outputs}

    def columns(table: str) -> list[str]:
        return schemas.get(table, [])

    for t in schemas:
        if t not in made or t.startswith("__datasource__"):
            nodes |= {f"{t}.{c}": "source" for c in columns(t)}

    def flow(src: str, dst: str, kind: str) -> None:
        edges.add((src, dst, kind))
        nodes[dst] = "derived" if kind == "derivation" or nodes.get(dst) == "derived" else "pass_through"

    for s in plan.steps:
        for out in s.outputs:
            sources = _sources(s, columns)
            for c in columns(out):
                found = sources(c)
                if not found:
                    nodes.setdefault(f"{out}.{c}", "source" if s.op == "datasource" else "derived")
                for table, column, kind in found:
                    if column in columns(table):
                        flow(f"{table}.{column}", f"{out}.{c}", kind)
    return {"nodes": [{"id": n, "origin": o} for n, o in sorted(nodes.items())], "edges": [{"from": a, "to": b, "kind": k} for a, b, k in sorted(edges)]}


def _sources(s: OpStep, columns):
    """For a step, the columns that each output column comes from, as (table, column, kind)."""
    first = s.inputs[0] if s.inputs else ""
    if s.op == "rename":
        back = {b: a for a, b in s.params["pairs"]}
        return lambda c: [(first, back[c], "rename")] if c in back else [(first, c, "flow")]
    if s.op == "compute":
        sets: dict[str, list[str]] = {}
        for n, e in s.params["items"]:
            refs = [r for x in E.references(e) for r in sets.get(x, [x])]
            sets[n] = list(dict.fromkeys(refs))
        return lambda c: [(first, r, "derivation") for r in sets[c]] if c in sets else [(first, c, "flow")]
    if s.op == "cast":
        cast = {c["col"] for c in s.params["casts"]}
        return lambda c: [(first, c, "derivation" if c in cast else "flow")]
    if s.op in ("aggregate", "summary"):
        stats = {f"{v}_{x}": v for v in s.params["vars"] for x in s.params["stats"]}
        return lambda c: [(first, stats[c], "derivation")] if c in stats else [(first, c, "flow")]
    if s.op == "transpose":
        return lambda c: [(first, c, "flow")] if c in s.params["by"] else [(first, s.params["var"], "derivation"), (first, s.params["id"], "derivation")]
    if s.op == "sql_select":
        q = s.params["query"]
        alias = {x.alias.lower(): x.table for x in q.sources}

        def found(c: str) -> list[tuple[str, str, str]]:
            item = next((i for i in q.items if i.name() == c), None)
            if item is None or item.column is None:
                return []
            a, _, name = item.column.rpartition(".")
            kind = "derivation" if item.func else "rename" if name != c else "flow"
            tables = [alias[a.lower()]] if a else [x.table for x in q.sources]
            return [(t, n, kind) for t in tables for n in columns(t) if n.lower() == name.lower()]

        return found
    if s.op == "data_step":
        written: dict[str, set[str]] = {}
        step = s.params["step"]
        for t in D.statements(step.body):
            if isinstance(t, D.Assign):
                refs = {r for x in E.references(t.value) for r in written.get(x, {x})}
                written.setdefault(t.name, set()).update(refs)
        back = {b: a for spec in s.params["tables"] for a, b in spec.rename}
        return lambda c: [(i, r, "derivation") for i in s.inputs for r in sorted(written[c])] if c in written else [(i, back.get(c, c), "rename" if c in back else "flow") for i in s.inputs]
    return lambda c: [(i, c, "flow") for i in s.inputs]


def table_effects(plan: Plan) -> list[dict]:
    """What filters and sorts do to tables, by hashes of their predicates and keys."""
    out = []
    for s in plan.steps:
        if s.op == "filter":
            out.append({"table": s.outputs[0], "effect": "filter", "from": s.inputs[0], "hash": digest(s.params["predicate"]), "columns": E.references(s.params["predicate"])})
        elif s.op == "sort":
            out.append({"table": s.outputs[0], "effect": "sort", "from": s.inputs[0], "hash": digest(s.params["by"]), "columns": list(s.params["by"]), "nodupkey": bool(s.params.get("nodupkey"))})
    return out
