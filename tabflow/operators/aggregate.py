"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.errors import invalid
from tabflow.functions.types import NUMERIC
from tabflow.relation import Relation

#: The statistics of aggregate and summary.
STATS = ("mean", "sum", "min", "max", "count", "n")


def statistic(rel: Relation, stat: str, name: str, line: int | None = None) -> Column:
    """``count`` and ``n`` count rows, missing values included; the others skip missing values."""
    if stat not in STATS:
        raise invalid("E_BAD_STAT", f"no statistic {stat!r}", line)
    value = rel.typed(name, line)
    if stat in ("count", "n"):
        return F.count(F.lit(1))
    if stat in ("mean", "sum") and value.type not in NUMERIC | {"null"}:
        raise invalid("E_TYPE", f"{stat} of a column that is {value.type}", line)
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[stat](value.col)


def grouped(rel: Relation, keys: Sequence[str], aggregates: Sequence[tuple[str, Column]]) -> Relation:
    """Groups in key order; without keys one row, and none for an empty table.  Partial aggregation is Spark's."""
    if keys:
        df = rel.df.groupBy(*[rel.col(k) for k in keys]).agg(*[a.alias(n) for n, a in aggregates])
    else:
        df = rel.df.agg(*[a.alias(n) for n, a in aggregates], F.count(F.lit(1)).alias("__tf_rows")).where("__tf_rows > 0").drop("__tf_rows")
    return Relation(df, (*keys, *[n for n, _ in aggregates]), tuple(keys), frozenset([frozenset(keys)]))


def aggregate(rel: Relation, by: Iterable[str], variables: Iterable[str], stats: Iterable[str] = ("mean",), names: Sequence[str] | None = None, line: int | None = None) -> Relation:
    """Columns ``<variable>_<stat>``, variable by variable."""
    keys = [rel.resolve(k, line) for k in by]
    wanted = [(rel.resolve(v, line), s) for v in variables for s in stats]
    made = [(names[i] if names else f"{v}_{s}", statistic(rel, s, v, line)) for i, (v, s) in enumerate(wanted)]
    if len({n for n, _ in made} | set(keys)) < len(made) + len(keys):
        raise invalid("E_DUPLICATE_COLUMN", "two results of one name", line)
    return grouped(rel, keys, made)
