"""Match-merge: N tables aligned by key and by position within the key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.errors import invalid
from tabflow.relation import Relation, hidden_name

MANY = "MERGE_MANY_MANY: more than one table has several rows for a key"


def merge(tables: Sequence[Relation], by: Sequence[str], flags: Sequence[str | None], line: int | None = None) -> Relation:
    """Full outer by key, missing keys matching; ``flags`` name presence columns.

    Of a key only one table may have several rows (else the run fails where the rows are
    read); the others repeat their only one.  Of columns with one name the last table that
    has the key gives the value.  All tables meet in one union, which is shuffled once by
    the key: the rows of the table with several (else of the first that has the key) stay,
    and windows over the key bring the others' rows to them.
    """
    if not by:
        raise invalid("DATASTEP_MISSING_BY", "merge needs by", line)
    names = [tables[0].resolve(k, line) for k in by]
    keys = [f"__tf_k{i}" for i in range(len(by))]
    sides, owns = [], []
    for n, t in enumerate(tables):
        own = [t.resolve(k, line) for k in by]
        owns.append(own)
        value = F.struct(*[t.col(c).alias(f"c{i}") for i, c in enumerate(t.columns)])
        place = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(t.order)])
        sides.append(t.df.select(*[t.col(c).alias(k) for c, k in zip(own, keys, strict=True)], F.lit(n).alias("__tf_t"), value.alias(f"__tf_v{n}"), place.alias(f"__tf_o{n}")))
    known = [frozenset(o) in t.unique for o, t in zip(owns, tables, strict=True)]
    at = hidden_name("i")
    if len(tables) > 1 and sum(known) >= len(tables) - 1:
        rows, counts, mine = joined(sides, keys, known, at)
    else:
        rows, counts, mine = grouped(sides, keys, at)
    values: dict[str, Column] = {k: F.col(c) for k, c in zip(names, keys, strict=True)}
    columns: list[str] = []
    for n, t in enumerate(tables):
        for i, c in enumerate(t.columns):
            if c in owns[n]:
                name = names[owns[n].index(c)]
            elif c in values:
                name = c
                values[c] = F.when(counts[n] > 0, mine[n][f"c{i}"]).otherwise(values[c])
            else:
                name = c
                values[c] = mine[n][f"c{i}"]
            if name not in columns:
                columns.append(name)
    for n, flag in enumerate(flags):
        if flag:
            values[flag] = counts[n] > 0
            columns.append(flag)
    columns = list(dict.fromkeys(columns))
    unique = frozenset([frozenset(names)]) if all(frozenset(o) in t.unique for o, t in zip(owns, tables, strict=True)) else frozenset()
    return Relation(rows.select(*[values[c].alias(c) for c in columns], F.col(at)), tuple(columns), (*names, at), unique)


def joined(sides: list[DataFrame], keys: list[str], known: list[bool], at: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """Outer joins of tables of which one at most may repeat a key.

    Conditions on presence flags turn them into inner or left joins, whose small sides the
    planner broadcasts and whose hot keys it splits.
    """
    many = known.index(False) if False in known else 0
    order = [many, *[n for n in range(len(sides)) if n != many]]
    rows = None
    for n in order:
        own = sides[n].select(*[F.col(k).alias(f"{k}_{n}") for k in keys], F.lit(1).alias(f"__tf_p{n}"), f"__tf_v{n}", *([f"__tf_o{n}"] if n == many else []))
        if rows is None:
            rows = own.select(*[F.col(f"{k}_{n}").alias(k) for k in keys], *[c for c in own.columns if not c.startswith("__tf_k")])
            continue
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_{n}")) for k in keys])
        both = rows.join(own, on, "full_outer")
        # a missing key matches, so what tells that a side is there is its mark
        here = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rows.columns if c.startswith("__tf_p")])
        kept = [c for c in both.columns if not c.startswith("__tf_k")]
        rows = both.select(*[F.when(here, F.col(k)).otherwise(F.col(f"{k}_{n}")).alias(k) for k in keys], *kept)
    rows = rows.withColumn(at, F.col(f"__tf_o{many}")).drop(f"__tf_o{many}")
    marks = [F.coalesce(F.col(f"__tf_p{n}"), F.lit(0)) for n in range(len(sides))]
    return rows, marks, [F.col(f"__tf_v{n}") for n in range(len(sides))]


def grouped(sides: list[DataFrame], keys: list[str], at: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """All tables in one union, shuffled and sorted once by the key and the tables' orders: the rows of the table with
    several (else of the first that has the key) stay, and windows over the key bring the others' row to them.  Group
    flags of the result take the same sort."""
    n_tables = len(sides)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    rows = rows.withColumn(at, F.struct(*[f"__tf_o{n}" for n in range(n_tables)])).drop(*[f"__tf_o{n}" for n in range(n_tables)])
    rows = rows.repartition(*keys).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*keys, at)])
    group = Window.partitionBy(*keys)
    rows = rows.select("*", *[F.count_if(F.col("__tf_t") == n).over(group).alias(f"__tf_n{n}") for n in range(n_tables)], *[F.first(f"__tf_v{n}", ignorenulls=True).over(group).alias(f"__tf_w{n}") for n in range(n_tables)])
    counts = [F.col(f"__tf_n{n}") for n in range(n_tables)]
    several = reduce(lambda a, b: a + b, [(c > 1).cast("int") for c in counts])
    lead = F.coalesce(*[F.when(c > 1, n) for n, c in enumerate(counts)], *[F.when(c > 0, n) for n, c in enumerate(counts)])
    if n_tables > 1:
        lead = F.when(several > 1, F.raise_error(F.lit(MANY)).cast("int")).otherwise(lead)
    rows = rows.where(F.col("__tf_t") == lead)
    return rows, counts, [F.when(F.col("__tf_t") == n, F.col(f"__tf_v{n}")).otherwise(F.col(f"__tf_w{n}")) for n in range(n_tables)]
