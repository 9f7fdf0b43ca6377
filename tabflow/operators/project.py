"""Projection, filters and column operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.errors import invalid
from tabflow.functions.columns import NUMBER, WHOLE, Compiler, predicate
from tabflow.functions.expr import Expr
from tabflow.functions.types import WIDE
from tabflow.relation import Relation


def select(rel: Relation, names: Iterable[str], line: int | None = None) -> Relation:
    found = [rel.resolve(n, line) for n in names]
    if len(set(found)) < len(found):
        raise invalid("E_DUPLICATE_COLUMN", "a column is selected twice", line)
    rel = rel.protected(set(rel.columns) - set(found))
    keep = frozenset(u for u in rel.unique if u <= set(found))
    return rel.with_columns(rel.df.select(*[rel.col(c) for c in found], *[F.col(h) for h in rel.hidden() if h not in found]), found, unique=keep)


def drop(rel: Relation, names: Iterable[str], line: int | None = None) -> Relation:
    gone = {rel.resolve(n, line) for n in names}
    return select(rel, [c for c in rel.columns if c not in gone], line)


def rename(rel: Relation, pairs: Iterable[tuple[str, str]], line: int | None = None) -> Relation:
    """All at once, so names can be swapped; positions stay."""
    new = {rel.resolve(a, line): b for a, b in pairs}
    names = [new.get(c, c) for c in rel.columns]
    if len(set(names)) < len(names):
        raise invalid("E_DUPLICATE_COLUMN", "a rename makes two columns of one name", line)
    rel = rel.protected([*new, *new.values()])
    df = rel.df.select(*[rel.col(c).alias(n) for c, n in zip(rel.columns, names, strict=True)], *[F.col(h) for h in rel.hidden()])
    unique = frozenset(frozenset(new.get(c, c) for c in u) for u in rel.unique)
    return rel.with_columns(df, names, unique=unique)


def assign(rel: Relation, items: Iterable[tuple[str, Expr]], mode: str = "any", formats: Mapping | None = None, strict: bool = False, line: int | None = None) -> Relation:
    """Assign in turn; later expressions see earlier values.  ``mode``: derive (new columns only), update (existing only) or any."""
    for name, e in items:
        exists = name in rel.columns
        if mode == "derive" and exists:
            raise invalid("E_STRICT_MUTATION", f"derive doesn't overwrite {name!r}; use update!", line)
        if mode == "update" and not exists:
            raise invalid("E_INVALID_UPDATE", f"update! needs an existing column, not {name!r}", line)
        value = Compiler(rel.env(line), formats, strict, line)(e)
        rel = rel.protected([name])
        col = value.col.cast("string") if value.type == "null" else value.col
        rel = rel.with_columns(rel.df.withColumn(name, col), rel.columns if exists else (*rel.columns, name), unique=frozenset(u for u in rel.unique if name not in u))
    return rel


def filter_rows(rel: Relation, e: Expr, formats: Mapping | None = None, strict: bool = False, line: int | None = None) -> Relation:
    compiler = Compiler(rel.env(line), formats, strict, line)
    if strict and compiler(e).type not in ("bool", "null"):
        raise invalid("E_TYPE", "a filter needs bool", line)
    return rel.with_columns(rel.df.where(predicate(compiler, e)), rel.columns)


#: The texts that are booleans.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
#: What a cast goes to.
TARGETS = ("str", "string", "int", "decimal", "bool", "date", "datetime")
_DATE, _DATETIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def parsed(text: Column, target: str) -> Column:
    """Text as the target's type, null if it isn't one.  Dates and times come back as ISO text."""
    if target in ("str", "string"):
        return text
    if target == "int":
        return F.when(text.rlike(WHOLE), text.try_cast("long"))
    if target == "decimal":
        return F.when(text.rlike(NUMBER), text.try_cast(WIDE))
    if target == "bool":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if target == "date":
        return F.when(text.rlike(_DATE), F.date_format(text.try_cast("date"), "yyyy-MM-dd"))
    return F.when(text.rlike(_DATETIME), F.date_format(text.try_cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"))


def cast(rel: Relation, name: str, target: str, on_error: str = "fail", trim: bool = False, line: int | None = None) -> Relation:
    """Cast by way of text.  ``on_error``: ``null``, or ``fail`` when a value isn't of the target (checked where the rows are read)."""
    if target not in TARGETS:
        raise invalid("E_CAST_TARGET", f"no cast to {target!r}", line)
    found = rel.resolve(name, line)
    source = rel.col(found)
    kind = rel.typed(found).type
    rel = rel.protected([found])
    text = F.date_format(source, "yyyy-MM-dd'T'HH:mm:ss") if rel.df.schema[found].dataType.typeName() in ("timestamp", "timestamp_ntz") else source.cast("string")
    if kind == "float" and target in ("int", "decimal"):  # no exponents, and 5.0 isn't a whole number's text
        text = source.cast(WIDE).cast("string")
    text = F.trim(text) if trim else text
    value = parsed(text, target)
    if on_error != "null":
        message = F.concat(F.lit(f"CAST_FAILED: {found} to {target}: "), F.coalesce(text, F.lit("")))
        value = F.when(source.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)
    return rel.with_columns(rel.df.withColumn(found, value), rel.columns, unique=frozenset(u for u in rel.unique if found not in u))


def cast_failures(rel: Relation, name: str, target: str, trim: bool = False) -> Column:
    """An aggregate: how many values of a column the cast would null."""
    source = rel.col(rel.resolve(name))
    text = F.trim(source.cast("string")) if trim else source.cast("string")
    return F.count_if(source.isNotNull() & parsed(text, target).isNull())


def options(rel: Relation, keep: Iterable[str] = (), dropped: Iterable[str] = (), renames: Iterable[tuple[str, str]] = (), where: Expr | None = None, formats: Mapping | None = None, line: int | None = None) -> Relation:
    """Dataset options in their order: where, then keep or drop, then rename (so where sees the old names)."""
    if where is not None:
        rel = filter_rows(rel, where, formats, line=line)
    if keep:
        rel = select(rel, keep, line)
    if dropped:
        rel = drop(rel, dropped, line)
    renames = list(renames)
    return rename(rel, renames, line) if renames else rel
