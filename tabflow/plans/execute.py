"""Lazy translation of plan steps to relations; the driver runs no rows but at sinks, guards and transposes."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.errors import Refusal, invalid, runtime
from tabflow.functions import expr as E
from tabflow.functions.types import shown, type_name
from tabflow.operators import aggregate, datastep, merge, order, project, sql, transpose
from tabflow.plans.ir import OpStep, Plan
from tabflow.relation import Relation
from tabflow.sources import csv as csv_io
from tabflow.sources import xpt


@dataclass
class Context:
    """What steps share: value formats, locks of datasources, and what has been recorded."""

    spark: SparkSession
    strict: bool = False
    base: str = ""
    locks: Mapping[str, list[tuple[str, str]]] = field(default_factory=dict)
    formats: dict[str, dict] = field(default_factory=dict)
    asserts: list[dict] = field(default_factory=list)
    saves: list[dict] = field(default_factory=list)
    constants: dict[str, object] = field(default_factory=dict)
    tables: dict[str, Relation] = field(default_factory=dict)


def read_source(ctx: Context, spec: Mapping) -> Relation:
    columns = spec.get("columns") or ctx.locks.get(spec["name"])
    if spec["kind"] == "inline_csv":
        rel = csv_io.relation(ctx.spark, csv_io.inline(ctx.spark, spec["text"]))
    else:
        path = spec["path"]
        if "://" not in path and not os.path.isabs(path) and ctx.base:
            path = f"{ctx.base.rstrip('/')}/{path}"
        if spec["kind"] == "parquet":
            rel = Relation.of(ctx.spark.read.parquet(path))
            return project.select(rel, [n for n, _ in columns]) if columns else rel
        if spec["kind"] == "xpt":
            return xpt.read(ctx.spark, path)
        rel = csv_io.relation(ctx.spark, csv_io.read_text(ctx.spark, path))
    if not columns:
        return csv_io.inferred(rel)
    columns = [tuple(c) for c in columns]
    if spec.get("columns"):
        rel, _ = csv_io.typed(rel, columns)
        untyped = [n for n, k in columns if not k]
        if untyped:
            kinds = csv_io.infer(project.select(rel, untyped))
            rel = csv_io.retyped(rel, kinds)
        return rel
    return locked(rel, columns)


def locked(rel: Relation, columns: list[tuple[str, str]]) -> Relation:
    """A lock's columns must be there and coerce; further columns pass as text."""
    missing = [n for n, _ in columns if n not in rel.columns]
    if missing:
        raise runtime("E_SCHEMA_MISSING_COL", f"no column {missing[0]!r}, which the lock names")
    extra = [c for c in rel.columns if c not in {n for n, _ in columns}]
    kinds = dict(columns)
    out, _ = csv_io.typed(rel, [(c, kinds.get(c)) for c in rel.columns])
    return out if not extra else out.with_columns(out.df, rel.columns)


def _compute(ctx: Context, s: OpStep, rel: Relation) -> Relation:
    return project.assign(rel, s.params["items"], s.params.get("mode", "any"), ctx.formats, ctx.strict, s.line)


def _cast(ctx: Context, s: OpStep, rel: Relation) -> Relation:
    for c in s.params["casts"]:
        rel = project.cast(rel, c["col"], c["to"], c.get("on_error", "fail"), c.get("trim", False), s.line)
    return rel


def _data_step(ctx: Context, s: OpStep, *rels: Relation) -> list[Relation]:
    inputs = []
    for spec, rel in zip(s.params["tables"], rels, strict=True):
        inputs.append(project.options(rel, spec.keep, spec.drop, spec.rename, spec.where, ctx.formats, s.line))
    step = s.params["step"]
    if s.params["mode"] == "merge":
        rel = merge.merge(inputs, step.by, [t.flag for t in s.params["tables"]], s.line)
    else:
        rel = inputs[0]
        if step.by and not order.sorted_by(rel, step.by):
            if len(rel.order) and any(c in rel.columns for c in rel.order):
                raise runtime("ORDER_REQUIRED", f"the input isn't sorted by {', '.join(step.by)}", s.line)
            check_sorted(rel, step.by, s.line)
            rel = rel.with_columns(rel.df, rel.columns, order=tuple(dict.fromkeys((*[rel.resolve(b) for b in step.by], *rel.order))))
    made = datastep.execute(rel, step, ctx.formats)
    return [made[o] for o in s.outputs]


def check_sorted(rel: Relation, by: list[str], line: int | None) -> None:
    """A pass over a table of unknown order: by groups must come in ascending order of their keys.

    Neighbours are compared within ranges of the source's own order, so no task sees all rows:
    the order of file and place is compared by the least and greatest key of each file part.
    """
    from pyspark.sql import Window

    keys = F.struct(*[rel.col(rel.resolve(b)) for b in by])
    lead, last = rel.order[:-1], rel.order[-1]
    # numbers of rows in one file, or drawn by partition: stretches of them
    part = [F.col(f"`{o}`") for o in lead] or [F.shiftright(F.col(f"`{last}`"), 33), F.shiftright(F.col(f"`{last}`"), 20)]
    window = Window.partitionBy(*part).orderBy(F.col(f"`{last}`"))
    pairs = rel.df.select(*[p.alias(f"p{i}") for i, p in enumerate(part)], keys.alias("k"), F.lag(keys).over(window).alias("b"))
    if not pairs.where("b > k").isEmpty():
        raise runtime("ORDER_REQUIRED", f"the input isn't sorted by {', '.join(by)}", line)
    names = [f"p{i}" for i in range(len(part))]
    spans = pairs.groupBy(*names).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    between = spans.select("lo", F.lag("hi").over(Window.orderBy(*names)).alias("before"))  # a row for each file part
    if not between.where("before > lo").isEmpty():
        raise runtime("ORDER_REQUIRED", f"the input isn't sorted by {', '.join(by)}", line)


def _sql(ctx: Context, s: OpStep, *rels: Relation) -> Relation:
    return sql.run(s.params["query"], dict(zip(s.inputs, rels, strict=True)), ctx.formats, s.line)


def _summary(ctx: Context, s: OpStep, rel: Relation) -> Relation:
    return aggregate.aggregate(rel, s.params["class"], s.params["vars"], s.params["stats"], line=s.line)


HANDLERS: dict[str, Callable] = {
    "identity": lambda ctx, s, rel: rel,
    "compute": _compute,
    "filter": lambda ctx, s, rel: project.filter_rows(rel, s.params["predicate"], ctx.formats, ctx.strict, s.line),
    "select": lambda ctx, s, rel: project.select(rel, s.params["cols"], s.line),
    "drop": lambda ctx, s, rel: project.drop(rel, s.params["cols"], s.line),
    "rename": lambda ctx, s, rel: project.rename(rel, [tuple(p) for p in s.params["pairs"]], s.line),
    "sort": lambda ctx, s, rel: order.sort(rel, s.params["by"], s.params.get("nodupkey", False), s.line),
    "cast": _cast,
    "datasource": lambda ctx, s: read_source(ctx, s.params),
    "data_step": _data_step,
    "transpose": lambda ctx, s, rel: transpose.transpose(rel, s.params["by"], s.params["id"], s.params["var"], line=s.line),
    "sql_select": _sql,
    "aggregate": _summary,
    "summary": _summary,
}


def execute(plan: Plan, ctx: Context, tables: Mapping[str, Relation], wanted: set[str] | None = None) -> dict[str, Relation]:
    """Relations of all tables of the plan, or of the wanted ones with what they need."""
    known = {n: r for n, r in tables.items()}
    lower = {n.lower(): n for n in known}
    steps = plan.steps if wanted is None else plan.needed(wanted)
    for s in steps:
        if s.op in ("const", "let_scalar"):
            ctx.constants |= s.params.get("bindings", {}) or {s.params.get("name"): s.params.get("expr")}
            continue
        if s.op == "format":
            ctx.formats[s.params["name"]] = {"map": s.params["map"], "other": s.params["other"]}
            continue
        if s.op in ("save", "assert"):
            (ctx.saves if s.op == "save" else ctx.asserts).append({"inputs": s.inputs, **s.params, "line": s.line})
            continue
        inputs = []
        for i in s.inputs:
            name = i if i in known else lower.get(i.lower())
            if name is None:
                raise invalid("E_UNKNOWN_TABLE", f"no table {i!r}", s.line)
            inputs.append(known[name])
        try:
            made = HANDLERS[s.op](ctx, s, *inputs)
        except Refusal as e:
            if e.line is None:
                e.line = s.line
            raise
        for o, rel in zip(s.outputs, made if isinstance(made, list) else [made], strict=True):
            known[o] = rel
            lower[o.lower()] = o
    ctx.tables = known
    return known


def evaluate_asserts(ctx: Context) -> list[dict]:
    """Assertions are recorded, not raised; row counts are one aggregate each."""
    out = []
    for a in ctx.asserts:
        counts = {t: ctx.tables[t].df.count() for t in a["inputs"]}

        def fill(e: E.Expr, counts: dict[str, int] = counts) -> E.Expr:
            if isinstance(e, E.Call) and e.name == "row_count":
                return E.Lit(counts[e.args[0].name.lower()])
            if isinstance(e, E.Binary):
                return E.Binary(e.op, fill(e.left), fill(e.right))
            if isinstance(e, E.Logic):
                return E.Logic(e.op, tuple(fill(x) for x in e.args))
            return E.Call(e.name, tuple(fill(x) for x in e.args)) if isinstance(e, E.Call) else e

        try:
            ok = bool(datastep.evaluate(fill(a["predicate"]), lambda name: ctx.constants.get(name), ctx.formats))
        except Exception as e:
            out.append({"predicate": E.to_text(a["predicate"]), "ok": False, "error": str(e), "counts": counts})
            continue
        out.append({"predicate": E.to_text(a["predicate"]), "ok": ok, "counts": counts})
    return out


def schema(rel: Relation) -> dict[str, str]:
    return {c: shown(type_name(rel.df.schema[c].dataType)) for c in rel.columns}


def refuse_streaming(df: DataFrame) -> None:
    if df.isStreaming:
        raise invalid("STREAM_ORDER", "a stream has no row order: use tabflow.streaming for row-wise steps")
