"""The bounded SELECT: inner and left joins on any condition, where, group by, and aggregates of one column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.errors import invalid, runtime
from tabflow.functions.columns import Compiler, Typed, predicate, truthy, typed
from tabflow.functions.expr import COMPARE, Binary, Expr, Logic, references
from tabflow.functions.types import NUMERIC
from tabflow.operators.aggregate import grouped
from tabflow.relation import Relation, hidden_name


@dataclass
class Item:
    """A column, or an aggregate (``count`` of ``*`` has no column)."""

    column: str | None
    func: str | None = None
    alias: str | None = None

    def name(self) -> str:
        if self.alias:
            return self.alias
        plain = (self.column or "").rpartition(".")[2]
        return plain if self.func is None else f"{self.func}_{plain}" if self.column else "count"


@dataclass
class Source:
    table: str
    alias: str
    kind: str = "from"  # from, inner, left
    on: Expr | None = None


@dataclass
class Query:
    items: list[Item]
    sources: list[Source]
    where: Expr | None = None
    group_by: list[str] = field(default_factory=list)


def run(query: Query, tables: Mapping[str, Relation], formats: Mapping | None = None, line: int | None = None) -> Relation:
    """Names resolve without regard to case; equality matches missing with missing, and is still an equi-join to the planner."""
    scope: list[tuple[str, str, Typed]] = []  # alias, column, value

    def resolve(name: str) -> Typed:
        alias, _, column = name.lower().rpartition(".")
        found = [v for a, c, v in scope if c.lower() == column and (not alias or a == alias)]
        if len(found) > 1:
            raise runtime("SQL_AMBIGUOUS_COLUMN", f"{name!r} is in several tables", line)
        if not found:
            raise runtime("SQL_COLUMN_UNDEFINED", f"no column {name!r}", line)
        return found[0]

    compiler = Compiler(resolve, formats, line=line)
    df, order = None, []
    for s in query.sources:
        rel = tables[s.table]
        if s.alias.lower() in {a for a, _, _ in scope}:
            raise invalid("SQL_DUPLICATE_ALIAS", f"two tables named {s.alias!r}", line)
        new = {c: hidden_name("q") for c in dict.fromkeys((*rel.columns, *rel.order))}
        right = rel.df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()])
        for c in rel.columns:
            scope.append((s.alias.lower(), c, typed(F.col(new[c]), rel.df.schema[c].dataType)))
        order += [new[o] for o in rel.order]
        if df is None:
            df = right
        else:
            on = join_condition(compiler, s.on)
            aliases = {c.lower(): a for a, c, _ in scope} | {f"{a}.{c.lower()}": a for a, c, _ in scope}
            compared = inequality(s.on, compiler, aliases, s.alias.lower()) if s.kind == "inner" else None
            binned = in_bins(df, right, *compared, on, [o for o in order if o in df.columns]) if compared else None
            df = binned if binned is not None else df.join(right, on, "inner" if s.kind == "inner" else "left")
    if query.where is not None:
        df = df.where(predicate(compiler, query.where))
    plain = [i for i in query.items if i.func is None]
    if query.group_by or any(i.func for i in query.items):
        listed = {g.lower() for g in query.group_by}
        chosen = {(i.column or "").lower() for i in plain}
        if listed != chosen:
            raise invalid("SQL_GROUP_BY_MISMATCH", "selected columns and group by must be the same", line)
        base = df.select("*", *[resolve(i.column).col.alias(i.name()) for i in plain])
        rel = Relation(base, tuple(i.name() for i in plain), tuple(order))
        aggs = []
        for i in query.items:
            if i.func:
                value = resolve(i.column).col if i.column else F.lit(1)
                made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[i.func](value)
                aggs.append((i.name(), made))
        by = {g.lower(): i.name() for g in query.group_by for i in plain if i.column.lower() == g.lower()}
        out = grouped(rel, [by[g.lower()] for g in query.group_by], aggs)
        return Relation(out.df, tuple(i.name() for i in query.items), out.order, out.unique)
    names = [i.name() for i in query.items]
    if len({n.lower() for n in names}) < len(names):
        raise invalid("E_DUPLICATE_COLUMN", "two results of one name", line)
    df = df.select(*[resolve(i.column).col.alias(i.name()) for i in query.items], *[F.col(o) for o in order])
    return Relation(df, tuple(names), tuple(order))


#: Joins on inequalities of more pairs than this are dealt out by bins of the right value, and by salts of the left row.
PAIRS, BINS, SALTS = 100_000_000, 64, 8


def inequality(e: Expr, compiler: Compiler, aliases: Mapping[str, str], alias: str) -> tuple[Column, Column, bool] | None:
    """Left value, right value and whether the left is the larger, of an inequality of numbers; None without one or with an equality."""
    parts, found = [e], None
    while parts:
        x = parts.pop()
        if isinstance(x, Logic) and x.op == "and":
            parts += x.args
        elif isinstance(x, Binary) and x.op in COMPARE:
            left, right = ({aliases[r.lower()] == alias for r in references(y)} for y in (x.left, x.right))
            if {True, False} not in (left, right) and left | right == {True, False}:
                if x.op == "==":
                    return None
                a, b = compiler(x.left), compiler(x.right)
                if x.op != "!=" and a.type in NUMERIC and b.type in NUMERIC:
                    larger = x.op in (">", ">=")
                    found = (b.col, a.col, not larger) if left == {True} else (a.col, b.col, larger)
    return found


def in_bins(left: DataFrame, right: DataFrame, a: Column, b: Column, larger: bool, on: Column, names: list[str]) -> DataFrame | None:
    """The inner join as an equi-join, by shuffles: a row of the left goes to all bins of right values that may satisfy it.

    A missing value is in a bin below all others, not-a-number in the last; ``names`` tell rows of the left apart.  None for few pairs.
    """
    n, cuts = right.agg(F.count(F.lit(1)), F.percentile_approx(b.cast("double"), [i / BINS for i in range(1, BINS)], 1000)).first()
    if n * left.count() <= PAIRS:
        return None
    ends = F.array(*[F.lit(c) for c in sorted({c for c in cuts or [] if c == c})]).cast("array<double>")
    bin_of = lambda v: F.when(v.isNull(), -1).otherwise(F.size(F.filter(ends, lambda c: c < v.cast("double"))))
    at, to, salt, salts = (hidden_name(t) for t in "btsu")
    bins = F.sequence(F.lit(-1), bin_of(a)) if larger else F.sequence(bin_of(a), F.lit(BINS))
    dealt = left.withColumn(salt, F.pmod(F.hash(*names), F.lit(SALTS))).withColumn(at, F.explode(bins))
    copies = right.withColumn(to, bin_of(b)).withColumn(salts, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism)
    dealt, copies = dealt.repartition(parts, at, salt), copies.repartition(parts, to, salts)
    return dealt.hint("merge").join(copies, (F.col(at) == F.col(to)) & (F.col(salt) == F.col(salts)) & on, "inner").drop(at, salt, to, salts)


def join_condition(compiler: Compiler, e: Expr):
    """Conjuncts one by one, so that null-safe equalities become join keys."""
    if isinstance(e, Logic) and e.op == "and":
        out = join_condition(compiler, e.args[0])
        for a in e.args[1:]:
            out = out & join_condition(compiler, a)
        return out
    if isinstance(e, Binary) and e.op in COMPARE:
        return compiler(e).col
    return truthy(compiler(e))
