"""Sort as a fact, and first-wins de-duplication by key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabflow.errors import invalid
from tabflow.relation import Relation, hidden_name


def sort(rel: Relation, by: Iterable[str], nodupkey: bool = False, line: int | None = None) -> Relation:
    """Stable, ascending, missing values first.  Only the order's description changes; ``nodupkey`` keeps the first row of each key."""
    keys = [rel.resolve(b, line) for b in by]
    if not keys:
        raise invalid("E_SORT_KEYS", "a sort needs keys", line)
    df = rel.df
    order = tuple(dict.fromkeys((*keys, *rel.order)))
    unique = rel.unique
    if nodupkey:
        rank = hidden_name("n")
        window = Window.partitionBy(*[rel.col(k) for k in keys]).orderBy(*rel.order_columns(keys))
        df = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)
        unique = unique | {frozenset(keys)}
    return rel.with_columns(df, rel.columns, order=order, unique=unique)


def sorted_by(rel: Relation, keys: Iterable[str]) -> bool:
    """Whether the order is known to begin with these columns."""
    keys = [rel.resolve(k) for k in keys]
    return list(rel.order[: len(keys)]) == keys
