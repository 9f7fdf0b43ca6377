"""CSV: readers with typed coercion or inference, and an ordered writer."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.errors import invalid, runtime
from tabflow.functions.columns import NUMBER, WHOLE
from tabflow.functions.types import WIDE
from tabflow.operators.project import parsed
from tabflow.relation import Relation, hidden_name
from tabflow.sources import files

#: Rows of evidence for a column that doesn't coerce.
SAMPLES = 10


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty cells are null.  Quoted line breaks make a file one split, so rows keep their order."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)


def inline(spark: SparkSession, text: str) -> DataFrame:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        raise invalid("E_EMPTY_INLINE", "inline data needs a header")
    header = [h.strip() for h in rows[0]]
    bad = next((r for r in rows[1:] if len(r) != len(header)), None)
    if bad is not None:
        raise invalid("E_INLINE_ROW", f"a row has {len(bad)} cells, the header {len(header)}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    return spark.createDataFrame([tuple(c if c != "" else None for c in r) for r in rows[1:]], schema)


def relation(spark: SparkSession, df: DataFrame) -> Relation:
    at = hidden_name("m")
    return Relation(df.withColumn(at, F.monotonically_increasing_id()), tuple(df.columns), (at,))


def coerced(value: Column, kind: str) -> Column:
    text = F.trim(value)
    if kind == "null":
        return F.lit(None).cast("string")
    return parsed(text, kind) if kind != "string" else value


def typed(rel: Relation, columns: Sequence[tuple[str, str | None]], check: bool = True) -> tuple[Relation, dict]:
    """Pinned columns: the header must be exactly theirs, and every cell of its type.

    One aggregate over the file counts failures by column; a second, small job shows the
    first rows of each.
    """
    names = [n for n, _ in columns]
    if list(rel.columns) != names:
        raise runtime("DATASOURCE_SCHEMA_MISMATCH", f"the header is {', '.join(rel.columns)}, pinned are {', '.join(names)}")
    kinds = {n: k for n, k in columns if k}
    bad = {n: rel.col(n).isNotNull() & (F.lit(True) if k == "null" else coerced(rel.col(n), k).isNull()) for n, k in kinds.items()}
    evidence: dict = {}
    if check and bad:
        counts = rel.df.agg(*[F.count_if(b).alias(f"c{i}") for i, b in enumerate(bad.values())]).first()
        for i, (n, b) in enumerate(bad.items()):
            if counts[i]:
                rows = rel.df.where(b).orderBy(*rel.order_columns()).select(F.col(rel.order[0]).alias("at"), rel.col(n).alias("v")).limit(SAMPLES).collect()
                evidence[n] = {"expected": kinds[n], "reason": f"invalid_{kinds[n]}", "failures": counts[i], "rows": [r["at"] + 1 for r in rows], "values": sorted({r["v"] for r in rows})}
    if evidence:
        error = runtime("E_CSV_COERCE", "; ".join(f"{n}: {e['failures']} cells aren't {e['expected']}, as {e['values'][:3]}" for n, e in evidence.items()))
        error.evidence = evidence
        raise error
    df = rel.df.select(*[(coerced(rel.col(n), kinds[n]) if n in kinds else rel.col(n)).alias(n) for n in names], *[F.col(o) for o in rel.hidden()])
    return rel.with_columns(df, names), evidence


def infer(rel: Relation, limit: int | None = None) -> dict[str, str]:
    """One type a column that holds for all its cells: bool, int, decimal or string, by one aggregate.

    Leading zeros make text; columns without values are text.
    """
    df = rel.df if limit is None else rel.df.limit(limit)
    zeros = r"^[+-]?0\d"
    aggs = []
    for i, n in enumerate(rel.columns):
        t = F.trim(rel.col(n))
        aggs += [
            F.count(t).alias(f"n{i}"),
            F.bool_and(F.lower(t).isin("true", "false")).alias(f"b{i}"),
            F.bool_and(F.when(t.isNotNull(), t.rlike(WHOLE) & ~t.rlike(zeros) & t.try_cast("long").isNotNull())).alias(f"i{i}"),
            F.bool_and(F.when(t.isNotNull(), t.rlike(NUMBER) & ~t.rlike(zeros))).alias(f"d{i}"),
        ]
    if not aggs:
        return {}
    r = df.agg(*aggs).first()
    return {n: "string" if not r[f"n{i}"] else "bool" if r[f"b{i}"] else "int" if r[f"i{i}"] else "decimal" if r[f"d{i}"] else "string" for i, n in enumerate(rel.columns)}


def retyped(rel: Relation, kinds: Mapping[str, str]) -> Relation:
    """Text columns that infer as numbers as numbers; others stay text."""
    casts = {"int": "long", "decimal": WIDE}
    cols = [(F.trim(rel.col(n)).cast(casts[kinds[n]]) if kinds.get(n) in casts else rel.col(n)).alias(n) for n in rel.columns]
    return rel.with_columns(rel.df.select(*cols, *[F.col(o) for o in rel.hidden()]), rel.columns)


def inferred(rel: Relation, limit: int | None = None) -> Relation:
    return retyped(rel, infer(rel, limit))


def cell(value: object) -> str:
    """A value as text: no exponents, no trailing zeros of decimals, ISO dates, empty for missing."""
    if value is None:
        return ""
    if isinstance(value, Decimal):
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def write(rel: Relation, path: str) -> dict:
    """One file in the relation's order.  Rows stream through the driver a partition at a time."""
    rows = 0
    with io.TextIOWrapper(files.create(path), encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(rel.columns)
        for r in rel.ordered().toLocalIterator(prefetchPartitions=True):
            out.writerow([cell(v) for v in r])
            rows += 1
    return {"path": path, "rows": rows, "columns": list(rel.columns)}


def write_large(rel: Relation, path: str) -> None:
    """A folder of part files, range-partitioned in order, written by the executors."""
    rel.ordered().write.option("header", True).option("emptyValue", "").mode("errorifexists").csv(path)
