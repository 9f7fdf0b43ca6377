"""The type lattice and its Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from tabflow.errors import invalid

#: The type names of the language.
NAMES = {"null": "null", "bool": "bool", "int": "int", "decimal": "decimal", "string": "string", "str": "string"}
NUMERIC = {"int", "decimal", "float"}
WIDE = T.DecimalType(38, 18)


def spark_type(name: str) -> T.DataType:
    return {"null": T.NullType(), "bool": T.BooleanType(), "int": T.LongType(), "decimal": WIDE, "float": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType()}[name]


def type_name(t: T.DataType) -> str:
    """``float`` is what the static language has no name for; it counts as decimal in schemas shown to users."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.FloatType | T.DoubleType):
        return "float"
    if isinstance(t, T.StringType):
        return "string"
    return "unknown"


def shown(name: str) -> str:
    return "decimal" if name == "float" else name


def unify(a: str, b: str, line: int | None = None) -> str:
    """The type of a value that is one or the other."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} <= NUMERIC:
        return "float" if "float" in (a, b) else "decimal"
    raise invalid("E_TYPE", f"{shown(a)} and {shown(b)} don't unify", line)
