"""Expressions as Spark columns, with missing values that compare smallest and two-valued logic."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.errors import invalid, runtime
from tabflow.functions.expr import COMPARE, Binary, Call, Expr, Lit, Logic, Ref
from tabflow.functions.types import NUMERIC, WIDE, spark_type, type_name, unify

#: What a number looks like in text: strict, unlike a cast.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
WHOLE = r"^[+-]?\d+$"


@dataclass(frozen=True)
class Typed:
    """A column and its type.  ``literal`` is set if it is a constant."""

    col: Column
    type: str
    literal: Expr | None = None
    exact: T.DecimalType | None = None

    def cast(self, to: str) -> Typed:
        if to == self.type:
            return self
        return Typed(self.col.cast(spark_type(to)), to, self.literal)


def typed(col: Column, kind: T.DataType) -> Typed:
    name = type_name(kind)
    return Typed(col, name, exact=kind if isinstance(kind, T.DecimalType) else None)


def literal(value: object) -> Typed:
    e = Lit(value)
    if value is None:
        return Typed(F.lit(None), "null", e)
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool", e)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), "int", e)
    if isinstance(value, Decimal):
        return Typed(F.lit(value), "decimal", e)
    return Typed(F.lit(str(value)), "string", e)


def truthy(x: Typed) -> Column:
    """Two-valued truth: null is false, numbers are true unless 0, strings unless empty."""
    if x.type == "null":
        return F.lit(False)
    if x.type == "bool":
        return F.coalesce(x.col, F.lit(False))
    if x.type in NUMERIC:
        return F.coalesce(x.col != 0, F.lit(False))
    if x.type == "string":
        return F.coalesce(x.col != "", F.lit(False))
    return x.col.isNotNull()


class Compiler:
    """Compiles expressions over named columns.  ``strict`` refuses what the typed language refuses."""

    def __init__(self, env: Callable[[str], Typed], formats: Mapping[str, dict] | None = None, strict: bool = False, line: int | None = None):
        self.env, self.formats, self.strict, self.line = env, formats or {}, strict, line

    def __call__(self, e: Expr) -> Typed:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Ref):
            return self.env(e.name)
        if isinstance(e, Binary):
            a, b = self(e.left), self(e.right)
            return self.compare(e.op, a, b) if e.op in COMPARE else self.arithmetic(e.op, a, b)
        if isinstance(e, Logic):
            args = [self(a) for a in e.args]
            if self.strict and any(a.type not in ("bool", "null") for a in args):
                raise invalid("E_TYPE", f"{e.op} needs bool operands", self.line)
            flags = [truthy(a) for a in args]
            if e.op == "not":
                return Typed(~flags[0], "bool")
            out = flags[0]
            for f in flags[1:]:
                out = out & f if e.op == "and" else out | f
            return Typed(out, "bool")
        return self.call(e)

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if "null" in (a.type, b.type):
            if self.strict:
                raise invalid("E_TYPE", f"null operand of {op}", self.line)
            other = b.type if a.type == "null" else a.type
            return Typed(F.lit(None).cast(spark_type(other if other in NUMERIC else "float")), other if other in NUMERIC else "float")
        if op == "+" and a.type == b.type == "string" and not self.strict:
            return Typed(F.concat(a.col, b.col), "string")
        if a.type == "bool" and not self.strict:
            a = Typed(a.col.cast("long"), "int")
        if b.type == "bool" and not self.strict:
            b = Typed(b.col.cast("long"), "int")
        if a.type not in NUMERIC or b.type not in NUMERIC:
            raise invalid("E_TYPE", f"{op} needs numbers, not {a.type} and {b.type}", self.line)
        kinds = {a.type, b.type}
        if kinds == {"int"}:
            if op == "/":
                return Typed(a.col.cast("double") / b.col.cast("double"), "float")
            return Typed(_apply(op, a.col.cast("long"), b.col.cast("long")), "int")
        if "float" in kinds:
            if self.strict and kinds == {"decimal", "float"} and a.literal is None and b.literal is None:
                raise runtime("DECIMAL_NO_FLOAT", "a decimal doesn't mix with a float", self.line)
            return Typed(_apply(op, a.col.cast("double"), b.col.cast("double")), "float")
        left, right = _narrow(a, op), _narrow(b, op)
        return Typed(_apply(op, left, right), "decimal")

    def compare(self, op: str, a: Typed, b: Typed) -> Typed:
        a, b = self.comparable(op, a, b)
        if op == "==":
            return Typed(a.col.eqNullSafe(b.col), "bool")
        if op == "!=":
            return Typed(~a.col.eqNullSafe(b.col), "bool")
        if op in (">", ">="):
            return self.compare({">": "<", ">=": "<="}[op], b, a)
        x, y = a.col, b.col
        plain = x < y if op == "<" else x <= y
        a_set, b_set = _never_null(a), _never_null(b)
        if a_set and b_set:
            return Typed(plain, "bool")
        if b_set:
            return Typed(F.when(x.isNull(), True).otherwise(plain), "bool")
        if a_set:
            return Typed(F.when(y.isNull(), False).otherwise(plain), "bool")
        below = F.when(x.isNull(), y.isNotNull() if op == "<" else F.lit(True))
        return Typed(below.when(y.isNull(), False).otherwise(plain), "bool")

    def comparable(self, op: str, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        if "null" in (a.type, b.type):
            if self.strict and op not in ("==", "!="):
                raise invalid("E_TYPE", f"null doesn't compare by {op}", self.line)
            other = b.type if a.type == "null" else a.type
            if other == "null":
                return Typed(a.col.cast("string"), "string", a.literal), Typed(b.col.cast("string"), "string", b.literal)
            return a, b
        if a.type == b.type or {a.type, b.type} <= NUMERIC:
            if a.type != b.type and "float" in (a.type, b.type):
                return Typed(a.col.cast("double"), "float", a.literal), Typed(b.col.cast("double"), "float", b.literal)
            return a, b
        raise invalid("E_TYPE", f"{a.type} and {b.type} don't compare", self.line)

    def call(self, e: Call) -> Typed:
        if e.name == "coalesce":
            args = [self(a) for a in e.args]
            kind = self._common(args)
            return Typed(F.coalesce(*[a.cast(kind).col for a in args]), kind)
        if e.name == "if":
            test, yes, no = (self(a) for a in e.args)
            if self.strict and test.type != "bool":
                raise invalid("E_TYPE", "the condition of if needs bool", self.line)
            kind = self._common([yes, no])
            return Typed(F.when(truthy(test), yes.cast(kind).col).otherwise(no.cast(kind).col), kind)
        if e.name == "put":
            return self.put(self(e.args[0]), self._name(e.args[1]))
        if e.name == "input":
            return self.number(self(e.args[0]), self._name(e.args[1]))
        raise invalid("E_UNSUPPORTED_FUNCTION", f"{e.name} isn't for rows", self.line)

    def _common(self, args: list[Typed]) -> str:
        kind = "null"
        for a in args:
            kind = unify(kind, a.type, self.line)
        return "string" if kind == "null" else kind

    def _name(self, e: Expr) -> str:
        if not (isinstance(e, Lit) and isinstance(e.value, str)):
            raise invalid("E_BAD_EXPR", "a format must be named", self.line)
        return e.value

    def put(self, x: Typed, name: str) -> Typed:
        """The format's text for the value; its ``other`` for missing and unlisted values."""
        found = self.formats.get(name) or self.formats.get(name.removeprefix("$")) or self.formats.get("$" + name)
        if found is None:
            raise runtime("FORMAT_UNDEFINED", f"no format {name!r}", self.line)
        other = F.lit(found["other"]) if found.get("other") is not None else F.lit(None).cast("string")
        if not found["map"] or x.type == "null":
            return Typed(other.cast("string"), "string")
        pairs = [F.lit(v) for kv in found["map"].items() for v in kv]
        key = x.col.cast("string")
        if x.type == "decimal":  # as text without trailing zeros
            key = F.when(F.contains(key, F.lit(".")), F.rtrim(F.rtrim(key, F.lit("0")), F.lit("."))).otherwise(key)
        return Typed(F.when(key.isNull(), other).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), key), other)), "string")

    def number(self, x: Typed, informat: str) -> Typed:
        """Text to a number; missing if it isn't one.  Numbers pass."""
        if informat.lower().lstrip("$") != "best":
            raise runtime("INFORMAT_UNSUPPORTED", f"informat {informat!r}", self.line)
        if x.type in NUMERIC:
            return x
        text = F.trim(x.col.cast("string"))
        return Typed(F.when(text.rlike(NUMBER), text.try_cast(WIDE)), "decimal")


def _never_null(x: Typed) -> bool:
    return isinstance(x.literal, Lit) and x.literal.value is not None


def _apply(op: str, a: Column, b: Column) -> Column:
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b


def _narrow(x: Typed, op: str) -> Column:
    """A decimal operand no wider than products and quotients can carry exactly."""
    if x.type == "int":
        return x.col.cast(T.DecimalType(18, 0))
    if op in "*/" and x.literal is None and (x.exact is None or x.exact.precision > 18):
        return x.col.cast(T.DecimalType(18, 6))
    return x.col


def predicate(compiler: Compiler, e: Expr) -> Column:
    """A filter's condition.  Conjuncts that compare a column with a constant keep the form that parquet scans take."""
    if isinstance(e, Logic) and e.op == "and":
        out = predicate(compiler, e.args[0])
        for a in e.args[1:]:
            out = out & predicate(compiler, a)
        return out
    if isinstance(e, Binary) and e.op in COMPARE:
        a, b = compiler.comparable(e.op, compiler(e.left), compiler(e.right))
        op = e.op
        if _never_null(a) and not _never_null(b):
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if _never_null(b) and not _never_null(a):
            if op == "==":
                return a.col == b.col
            if op in (">", ">="):
                return a.col > b.col if op == ">" else a.col >= b.col
            if op in ("<", "<="):
                return a.col.isNull() | (a.col < b.col if op == "<" else a.col <= b.col)
    return truthy(compiler(e))
