"""Validation of clinical tables (DM, AE, LB) against a profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.governance.evidence import union_all
from tabflow.relation import Relation

#: The required columns of each domain, and its ISO date columns.
REQUIRED = {"DM": ["DOMAIN", "USUBJID", "SUBJID", "SITEID", "SEX", "RACE"], "AE": ["DOMAIN", "USUBJID", "AEDECOD", "AESTDTC"], "LB": ["DOMAIN", "USUBJID", "LBTESTCD", "LBDTC", "LBSTRESN"]}
DATES = {"DM": ["RFSTDTC"], "AE": ["AESTDTC"], "LB": ["LBDTC"]}
ISO = r"^\d{4}-\d{2}-\d{2}$"


#: Name of the row numbers while tables are checked.
ROW = "__tf_row"


def numbered(rel: Relation) -> DataFrame:
    """The visible columns and the row's number in the order, from 1.

    Rows are counted by range of the order first, then numbered within each, so no task sees a whole table.
    """
    if not rel.order:
        return rel.visible().withColumn(ROW, F.lit(None).cast("long"))
    lead, last = rel.order[:-1], F.col(f"`{rel.order[-1]}`")
    whole = rel.df.schema[rel.order[-1]].dataType.typeName() in ("integer", "long")
    # row places in a file, or numbers drawn by partition: stretches of them
    stretch = [F.shiftright(last.cast("long"), 16)] if whole else []
    parts = [*[F.col(f"`{o}`") for o in lead], *stretch]
    names = [f"__tf_p{i}" for i in range(len(parts))]
    df = rel.df.select(*[rel.col(c) for c in rel.columns], last.alias("__tf_last"), *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    if not names:
        names, df = ["__tf_p0"], df.withColumn("__tf_p0", F.lit(0))
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__tf_n"))
    ahead = counts.select(*names, (F.sum("__tf_n").over(Window.orderBy(*names)) - F.col("__tf_n")).alias("__tf_ahead"))
    on = [df[n].eqNullSafe(ahead[n]) for n in names]
    within = F.row_number().over(Window.partitionBy(*[df[n] for n in names]).orderBy("__tf_last"))
    joined = df.join(ahead, on)
    return joined.withColumn(ROW, F.col("__tf_ahead") + within).select(*[F.col(f"`{c}`") for c in rel.columns], ROW)


def validate(tables: Mapping[str, DataFrame | Relation]) -> DataFrame:
    """An issue per missing table or column and per bad row: domain, rule, column, row (from 1), value.

    A date that is missing is bad too.  Tables that carry their order have rows numbered by it:
    rows of a file by their place in the file, of several files by file and place.
    """
    rels = {k: v if isinstance(v, Relation) else Relation.of(v) for k, v in tables.items()}
    tables = {k: numbered(r) for k, r in rels.items()}
    spark = next(iter(tables.values())).sparkSession
    held = {k.upper(): v for k, v in tables.items()}
    fixed, found = [], []
    for domain, required in REQUIRED.items():
        df = held.get(domain)
        if df is None:
            fixed.append((domain, "TABLE_MISSING", None, None, None))
            continue
        names = {c.upper(): c for c in df.columns}
        fixed += [(domain, "REQUIRED_COLUMN_MISSING", c, None, None) for c in required if c not in names]

        def rows(rule: str, column: str, bad, df: DataFrame = df, domain: str = domain, names: dict = names) -> None:
            value = F.col(f"`{names[column]}`").cast("string")
            found.append(df.where(bad(value)).select(F.lit(domain).alias("domain"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(ROW).alias("row"), value.alias("value")))

        if "DOMAIN" in names:
            rows("DOMAIN_VALUE", "DOMAIN", lambda v, d=domain: ~v.eqNullSafe(F.lit(d)))
        if "USUBJID" in names:
            rows("USUBJID_MISSING", "USUBJID", lambda v: v.isNull() | (F.trim(v) == ""))
        for c in DATES.get(domain, []):
            if c in names:
                rows("DATE_NOT_ISO", c, lambda v: v.isNull() | ~v.rlike(ISO))
    schema = "domain string, rule string, column string, row long, value string"
    return union_all([spark.createDataFrame(fixed, schema), *found])
