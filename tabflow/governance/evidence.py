"""Column profiles and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.types import shown, type_name
from tabflow.relation import Relation

#: Distinct values are counted up to this, and so many frequent values are shown.
UNIQUE_CAP, TOP = 2048, 5
#: Lots of values that are ranked by themselves first.
LOTS = 64


def profile(rel: Relation) -> DataFrame:
    """A row per column: null and non-null counts, distinct values (exact, shown as ``>=2049`` beyond the cap),
    the value if there is only one, and the most frequent values (by count, then as text).

    The table is unpivoted once and counted by (column, value), so one shuffle of distinct
    values serves all columns; a value that all rows share is pre-aggregated before it moves.
    """
    df = rel.visible()
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(rel.columns)]))
    counted = df.select(cells.alias("c")).groupBy("c.i", "c.v").agg(F.count(F.lit(1)).alias("n"))
    facts = counted.groupBy("i").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count("v").alias("distinct"),
    )
    # the best of each of LOTS lots of values, then the best of these: no task ranks a whole column
    order = [F.col("n").desc(), F.col("v")]
    lot = F.pmod(F.xxhash64("v"), F.lit(LOTS))
    some = counted.where("v is not null").withColumn("r", F.row_number().over(Window.partitionBy("i", lot).orderBy(*order))).where(F.col("r") <= TOP)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("r") <= TOP)
    facts = facts.join(best.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("r", "v", "n"))).alias("top")), "i", "left")
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c, shown(type_name(rel.df.schema[c].dataType))) for i, c in enumerate(rel.columns)], "i int, column string, type_hint string")
    out = names.join(facts, "i", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "column",
        "type_hint",
        F.coalesce("null_count", zero).alias("null_count"),
        F.coalesce("non_null_count", zero).alias("non_null_count"),
        F.when(F.col("distinct") > UNIQUE_CAP, F.lit(f">={UNIQUE_CAP + 1}")).otherwise(F.coalesce("distinct", zero).cast("string")).alias("unique_count"),
        F.when((F.col("distinct") == 1) & (F.col("null_count") == 0), F.col("top")[0]["v"]).alias("constant_value"),
        F.array_join(F.transform(F.coalesce("top", F.array().cast("array<struct<r:int,v:string,n:bigint>>")), lambda t: F.concat(t["v"], F.lit("="), t["n"].cast("string"))), ";").alias("top_values"),
    )


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order."""
    cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
    r = df.select(F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))).first()
    return ":".join(str(x or 0) for x in r)


def coercion_counts(rel: Relation, casts: list[dict]) -> dict[str, int]:
    """How many values each cast of a step nulls, by one aggregate."""
    from tabflow.operators.project import cast_failures

    if not casts:
        return {}
    r = rel.df.agg(*[cast_failures(rel, c["col"], c["to"], c.get("trim", False)).alias(f"c{i}") for i, c in enumerate(casts)]).first()
    return {c["col"]: r[i] for i, c in enumerate(casts)}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
