"""A table with its order kept as a list of sort columns; nothing is sorted until a sink needs it."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.errors import invalid
from tabflow.functions.columns import Typed, typed

_numbers = itertools.count()


def hidden_name(tag: str = "h") -> str:
    return f"__tf_{tag}{next(_numbers)}"


def file_place(df: DataFrame) -> Column | None:
    """What orders a table's files, their path; None if there is only one."""
    return None if len(df.inputFiles()) == 1 else F.col("_metadata.file_path")


@dataclass(frozen=True)
class Relation:
    """``df`` has the visible columns and hidden ones; ``order`` names columns, ascending with nulls first.

    ``unique``: column sets known to identify rows.  ``pending``: checks that a sink must
    run, as (code, message, DataFrame of offending rows).
    """

    df: DataFrame
    columns: tuple[str, ...]
    order: tuple[str, ...] = ()
    unique: frozenset[frozenset[str]] = field(default_factory=frozenset)

    @staticmethod
    def of(df: DataFrame, order: Iterable[str] = ()) -> Relation:
        """A relation over a DataFrame.  Without an order, rows of parquet files have that of file and place in the file."""
        columns = tuple(df.columns)
        order = tuple(order)
        if not order:
            try:
                row = hidden_name("r")
                places = {row: F.col("_metadata.row_index")}
                if (file := file_place(df)) is not None:
                    places = {hidden_name("f"): file} | places
                df = df.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(n) for n, c in places.items()])
                order = tuple(places)
            except AnalysisException:  # not a file scan: number the rows as they come
                at = hidden_name("m")
                df = df.withColumn(at, F.monotonically_increasing_id())
                order = (at,)
        return Relation(df, columns, order)

    def resolve(self, name: str, line: int | None = None) -> str:
        """The column of this name, exactly or else without regard to case."""
        if name in self.columns:
            return name
        near = [c for c in self.columns if c.lower() == name.lower()]
        if len(near) == 1:
            return near[0]
        raise invalid("E_UNKNOWN_COLUMN", f"no column {name!r} among {', '.join(self.columns)}", line)

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def typed(self, name: str, line: int | None = None) -> Typed:
        found = self.resolve(name, line)
        return typed(self.col(found), self.df.schema[found].dataType)

    def env(self, line: int | None = None) -> Callable[[str], Typed]:
        return lambda name: self.typed(name, line)

    def visible(self) -> DataFrame:
        return self.df.select(*[self.col(c) for c in self.columns])

    def ordered(self) -> DataFrame:
        """The visible columns, rows physically in order."""
        return self.df.orderBy(*self.order_columns()).select(*[self.col(c) for c in self.columns]) if self.order else self.visible()

    def order_columns(self, within: Iterable[str] = ()) -> list[Column]:
        """The order's columns; within groups of equal ``within``, those that still tell rows apart."""
        fixed = set(within)
        return [F.col(f"`{c}`").asc_nulls_first() for c in self.order if c not in fixed] or [F.col(f"`{c}`").asc_nulls_first() for c in self.order]

    def protected(self, names: Iterable[str]) -> Relation:
        """The same relation, in which ``names`` may change: order columns among them are copied first."""
        touched = {n for n in names if n in self.order}
        if not touched:
            return self
        df, order = self.df, list(self.order)
        for n in touched:
            copy = hidden_name("o")
            df = df.withColumn(copy, F.col(f"`{n}`"))
            order = [copy if o == n else o for o in order]
        return replace(self, df=df, order=tuple(order))

    def hidden(self) -> list[str]:
        """Hidden columns that the order still needs."""
        return [c for c in dict.fromkeys(self.order) if c not in self.columns]

    def with_columns(self, df: DataFrame, columns: Iterable[str], **changes) -> Relation:
        return replace(self, df=df, columns=tuple(columns), **changes)
