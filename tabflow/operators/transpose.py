"""Long to wide."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import functions as F

from tabflow.errors import runtime
from tabflow.relation import Relation


def column_name(value: object) -> str:
    """An id as a column name: runs of other characters become ``_``; a leading digit gets ``COL_``."""
    name = re.sub(r"[^A-Za-z0-9_]+", "_", str(value)).strip("_")
    return "COL" if not name else f"COL_{name}" if name[0].isdigit() else name


def transpose(rel: Relation, by: Iterable[str], id_col: str, var: str, max_ids: int = 10_000, line: int | None = None) -> Relation:
    """One row per group; a column per id, in order of first appearance; of an id's several values in a group the last stays.

    The ids are a first, small job: their number is bounded by ``max_ids`` and by what a schema can hold.
    """
    keys = [rel.resolve(k, line) for k in by]
    ident, value = rel.resolve(id_col, line), rel.resolve(var, line)
    at = F.struct(*[F.col(f"`{o}`") for o in rel.order])
    firsts = rel.df.groupBy(rel.col(ident).cast("string").alias("v")).agg(F.min(at).alias("at")).orderBy("at").limit(max_ids + 1).collect()
    names = [r["v"] for r in firsts]
    if len(names) > max_ids:
        raise runtime("TRANSPOSE_TOO_MANY_IDS", f"more than {max_ids} ids", line)
    if any(n is None or not n.strip() for n in names):
        raise runtime("TRANSPOSE_MISSING_ID", f"{ident} is missing in a row", line)
    made = [column_name(n) for n in names]
    if len(set(made)) < len(made):
        raise runtime("TRANSPOSE_ID_COLLISION", "two ids give one column name", line)
    last = F.max_by(rel.col(value), at)
    if names:
        df = rel.df.groupBy(*[rel.col(k) for k in keys]).pivot(ident, names).agg(last)
        df = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{n}`").alias(m) for n, m in zip(names, made, strict=True)])
    else:
        df = rel.df.select(*[rel.col(k) for k in keys]).limit(0)
    return Relation(df, (*keys, *made), tuple(keys), frozenset([frozenset(keys)]))
