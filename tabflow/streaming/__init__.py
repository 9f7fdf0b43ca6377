"""Row-wise steps over streams.

The language is a batch language whose tables have an order, which a stream hasn't.  Steps
that look at one row at a time mean the same over a stream; all others are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabflow.errors import invalid
from tabflow.operators import project
from tabflow.plans.ir import Plan
from tabflow.relation import Relation

ROW_WISE = {"identity", "compute", "filter", "select", "drop", "rename", "cast", "format", "const", "let_scalar"}


def apply(plan: Plan, stream: DataFrame, source: str, output: str, strict: bool = False) -> DataFrame:
    """The plan's table ``output`` over a stream bound as ``source``."""
    from tabflow.plans.execute import HANDLERS, Context

    ctx = Context(stream.sparkSession, strict)
    known = {source: Relation(stream, tuple(stream.columns))}
    for s in plan.needed({output}):
        if s.op not in ROW_WISE:
            raise invalid("STREAM_ORDER", f"{s.op} needs the order or the whole of a table, which a stream hasn't", s.line)
        if s.op == "format":
            ctx.formats[s.params["name"]] = {"map": s.params["map"], "other": s.params["other"]}
        elif s.op not in ("const", "let_scalar"):
            known[s.outputs[0]] = HANDLERS[s.op](ctx, s, known[s.inputs[0]])
    return project.select(known[output], known[output].columns).df
