"""Queries of what isn't a table operator: refusals, files, includes, assertions, profiles, locks, lineage, amendments, bundles.

Each returns its findings as rows, with SQL for the rows that must come out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.errors import Refusal
from tabflow.queries import ORACLES, QUERIES, pipeline, script, scratch_file, table
from tabflow.relation import Relation
from tabflow.session import compile_text, run, run_plan


def query(name: str, oracle: str) -> Callable[[Callable], Callable]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """SQL of some rows."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


# --- refusals -----------------------------------------------------------------------------

#: Scripts that must be refused, while they are compiled or run, with the code of the refusal.
REFUSED = [
    ("join_without_kind", "proc sql; create table o as select r_name from region join nation on r_regionkey = n_regionkey; quit;", "SQL_UNSUPPORTED_FORM"),
    ("join_right", "proc sql; create table o as select r_name from region right join nation on r_regionkey = n_regionkey; quit;", "SQL_UNSUPPORTED_FORM"),
    ("join_without_condition", "proc sql; create table o as select r_name from region inner join nation; quit;", "SQL_UNSUPPORTED_FORM"),
    ("select_star", "proc sql; create table o as select * from region; quit;", "SQL_UNSUPPORTED_FORM"),
    ("select_distinct", "proc sql; create table o as select distinct r_name from region; quit;", "SQL_UNSUPPORTED_FORM"),
    ("subquery", "proc sql; create table o as select r_name from (select r_name from region); quit;", "SQL_UNSUPPORTED_FORM"),
    ("unknown_column", "proc sql; create table o as select nope from region; quit;", "SQL_COLUMN_UNDEFINED"),
    ("merge_without_by", "data o; merge region nation; run;", "DATASTEP_MISSING_BY"),
    ("sort_descending", "proc sort data=region out=o; by descending r_name; run;", "SORT_UNSUPPORTED"),
    ("by_without_order", "data o; set nation; by n_regionkey; if first.n_regionkey; run;", "ORDER_REQUIRED"),
    ("do_while", "data o; set region; do while (r_regionkey > 1); end; run;", "LOOP_UNSUPPORTED"),
    ("do_until", "data o; set region; do until (r_regionkey > 1); end; run;", "LOOP_UNSUPPORTED"),
    ("loop_step_zero", "data o; set region; do i = 1 to 9 by 0; end; run;", "LOOP_STEP"),
    ("loop_too_long", "data o; set region; do i = 1 to 2000000; n = i; end; run;", "LOOP_LIMIT"),
    ("array", "data o; set region; array x a b; run;", "BLOCK_STATEFUL_TOKEN"),
    ("lag_function", "data o; set region; x = lag(r_regionkey); run;", "BLOCK_STATEFUL_TOKEN"),
    ("infile", "data o; infile 'x'; run;", "BLOCK_STATEFUL_TOKEN"),
    ("flag_without_by", "data o; set region; x = first.r_name; run;", "BY_FLAG_UNDEFINED"),
    ("transpose_same_names", "data r; set region; v = 1; id = if(r_regionkey == 0, 'a b', 'a-b'); k = 1; run;\nproc sort data=r out=s; by k; run;\nproc transpose data=s out=o; by k; id id; var v; run;", "TRANSPOSE_ID_COLLISION"),
    ("transpose_missing_id", "data r; set region; k = 1; id = .; run;\nproc sort data=r out=s; by k; run;\nproc transpose data=s out=o; by k; id id; var r_name; run;", "TRANSPOSE_MISSING_ID"),
    ("macro_if", "%if 1 %then x;", "MACRO_UNSUPPORTED"),
    ("macro_definition", "%macro m; %mend;", "MACRO_UNSUPPORTED"),
    ("include_without_place", "%include 'x.sas';", "INCLUDE_UNSUPPORTED"),
    ("format_unknown", "data o; set region; x = put(r_name, $nope.); run;", "FORMAT_UNDEFINED"),
    ("keep_and_drop", "data o; set region(keep=r_name drop=r_name); run;", "E_KEEP_DROP"),
    ("summary_without_nway", "proc summary data=region; class r_name; var r_regionkey; output out=o n= / autoname; run;", "E_SUMMARY_NWAY"),
    ("unknown_table", "data o; set nowhere; run;", "E_UNKNOWN_TABLE"),
    ("several_rows_in_two_tables", "proc sort data=nation out=a; by n_regionkey; run;\ndata o; merge a a(rename=(n_name=x)); by n_regionkey; run;", "MERGE_MANY_MANY"),
    ("select_without_match", "data o; set region; select; when (r_regionkey > 99) x = 1; end; run;", "SELECT_MISMATCH"),
]


@query("refusals", values([(n, code) for n, _, code in REFUSED], "form, code"))
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each unsupported form is refused with, while compiling or where rows are read."""
    found = []
    bound = {t: table(spark, sf_dir, t) for t in ("region", "nation")}
    for name, text, _ in REFUSED:
        try:
            run(spark, text, bound)["o"].collect()  # tables of 25 rows at most
            code = "accepted"
        except Refusal as e:
            code = e.code
        except Exception as e:  # what only rows show
            code = next((c for c in ("MERGE_MANY_MANY", "SELECT_MISMATCH") if c in str(e)), type(e).__name__)
        found.append((name, code))
    return spark.createDataFrame(found, "form string, code string")


# --- sources, macros, files ------------------------------------------------------------------

pipeline("inline_csv_block", "nation", "datasource d = inline_csv columns(k: int, label: string, share: decimal) do\n  k,label,share\n  0,zero,0.50\n  1,,1.25\n  2,two,\nend\ntable out = from(d)", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'zero', 0.5), (1, NULL, 1.25), (2, 'two', NULL)) AS t(k, label, share)")
pipeline("inline_csv_text", "nation", 'datasource d = inline_csv("a,b\\n1,x\\n2,y")\ntable out = from(d) do\n derive(twice = a * 2)\nend', "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(2 AS BIGINT)), (2, 'y', 4)) AS t(a, b, twice)")
script("select_by_drop", "supplier", "data out; set supplier(drop=s_name s_acctbal); run;", "SELECT s_suppkey, s_nationkey FROM supplier")
pipeline("unary_minus", "customer", "table out = customer do\n derive(less = -c_acctbal, more = 3 - -c_custkey, no = not (c_acctbal > 0))\n select c_custkey, less, more, no\nend", "SELECT c_custkey, -c_acctbal AS less, 3 + c_custkey AS more, NOT coalesce(c_acctbal > 0, FALSE) AS no FROM customer")
script(
    "sql_literals",
    "orders",
    "proc format; value $st 'F'='a  b where' 'O'='in case from' other='a b where'; run;\ndata t; set orders; label = put(o_orderstatus, $st.); run;\nproc sql; create table out as select o_orderkey, label from t where label = 'a  b where' or label = 'in case from'; quit;",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'a  b where' ELSE 'in case from' END AS label FROM orders WHERE o_orderstatus IN ('F', 'O')",
)


@query("include_file", "SELECT p_partkey, p_size FROM part WHERE p_size <= 7")
def include_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script whose limit and filter come from included texts, one of which includes the other."""
    texts = {"outer.sas": "%include 'inner.sas';\n%let test = p_size <= &most.;", "inner.sas": "%let most = 7;"}
    text = "%include 'outer.sas';\ndata out; set part(where=(&test)); keep p_partkey p_size; run;"
    return run(spark, text, {"part": table(spark, sf_dir, "part")}, include=texts.__getitem__)["out"]


@query("csv_inference", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, '00' || n_nationkey AS code, CAST(n_regionkey AS DOUBLE) / 2 AS half, CASE WHEN n_regionkey > 1 THEN 'true' ELSE 'false' END AS flag FROM nation")
def csv_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that are inferred from a file: whole numbers, decimals, text with leading zeros."""
    from tabflow.sources import csv as C

    df = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "concat('00', n_nationkey) code", "n_regionkey / 2 half", "if(n_regionkey > 1, 'true', 'false') flag")
    path = scratch_file(spark, "inferred.csv")
    C.write(Relation.of(df), path)
    rel = C.inferred(C.relation(spark, C.read_text(spark, path)))
    return rel.visible().withColumn("half", F.col("half").cast("double"))


@query("save_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def save_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a save writes: its own file, read back."""
    import tempfile
    from pathlib import Path

    text = f'# tabflow 0.1\ndatasource d = parquet("{sf_dir}/orders.parquet")\ntable t = from(d) do\n filter(o_totalprice > 300000)\n select o_orderkey, o_totalprice\nend\nsave t to "sub/t.csv" as "large"'
    with tempfile.TemporaryDirectory() as folder:  # on the driver, which writes and reads it here
        done = run(spark, text, {}, "pipeline").write(folder)
        lines = Path(done[0]["path"]).read_text().split("\n")[1:-1]
    return spark.createDataFrame([(int(k), float(p)) for k, p in (x.split(",") for x in lines)], "o_orderkey long, o_totalprice double")


# --- state row by row -------------------------------------------------------------------------

script(
    "retain_multiplied",
    "events",
    "proc sort data=events out=s; by event_id; run;\ndata out; set s; retain acc; x = if(event_type == 'click', ., event_id); k = event_id + 9007199254740993; acc = coalesce(acc, 0) * if(event_type == 'error', 0, 1) + if(event_type == 'view', 1, 0); keep event_id k x acc; run;",
    """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS part FROM events)
SELECT event_id, event_id + 9007199254740993 AS k, CASE WHEN event_type = 'click' THEN NULL ELSE event_id END AS x,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY event_id) AS BIGINT) AS acc FROM g""",
)
script(
    "retain_multiplied_by_group",
    "events",
    "proc format; value $n '5'='five' '7'='seven' other='other'; run;\nproc sort data=events out=s; by user_id event_id; run;\ndata out; set s; by user_id; retain acc; if first.user_id then acc = 0; x = if(event_type == 'click', ., user_id); acc = acc * if(event_type == 'error', 0, 1) + coalesce(x, 1); label = put(x, $n.); keep event_id x acc label; run;",
    """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)
SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS x,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE user_id END) OVER (PARTITION BY user_id, part ORDER BY event_id) AS BIGINT) AS acc,
       CASE WHEN event_type = 'click' THEN 'other' WHEN user_id = 5 THEN 'five' WHEN user_id = 7 THEN 'seven' ELSE 'other' END AS label FROM g""",
)
script(
    "do_loop_large_numbers",
    "nation",
    "data out; set nation; k = n_nationkey + 9007199254740993; x = if(n_regionkey == 1, ., n_nationkey); total = 0; do i = 1 to 300; total = total + coalesce(x, i); end; keep k x total; run;",
    "SELECT n_nationkey + 9007199254740993 AS k, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey END AS x, CAST(CASE WHEN n_regionkey = 1 THEN 45150 ELSE 300 * n_nationkey END AS BIGINT) AS total FROM nation",
)


@query("transpose_column_order", "SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS place, event_type AS name FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type) UNION ALL SELECT -1, 'k'")
def transpose_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transposed table's columns: the keys, then the ids in order of first appearance."""
    text = "data e; set events; k = 1; run;\nproc sort data=e out=s; by k event_id; run;\nproc transpose data=s out=out; by k; id event_type; var event_id; run;"
    names = run(spark, text, {"events": table(spark, sf_dir, "events")})["out"].columns
    return spark.createDataFrame([(i - 1, n) for i, n in enumerate(names)], "place long, name string")


# --- evidence ------------------------------------------------------------------------------------


@query("assertions", "SELECT 'row_count(big) > 0' AS predicate, count(*) > 0 AS ok, count(*) AS rows FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'row_count(big) == 1', count(*) = 1, count(*) FROM orders WHERE o_totalprice > 200000")
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions are recorded with the counts that they were decided by."""
    text = f'# tabflow 0.1\ndatasource d = parquet("{sf_dir}/orders.parquet")\ntable big = from(d) do\n filter(o_totalprice > 200000)\nend\nassert row_count(big) > 0\nassert row_count(big) == 1'
    found = run(spark, text, {}, "pipeline").asserts()
    return spark.createDataFrame([(a["predicate"], a["ok"], a["counts"]["big"]) for a in found], "predicate string, ok boolean, rows long")


_PROFILED = "(SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS buyer, 'x' AS same FROM orders)"


def _profile_sql(column: str, hint: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    top = f"(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {text} AS v, count(*) AS n FROM {_PROFILED} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"
    return (
        f"SELECT '{column}' AS \"column\", '{hint}' AS type_hint, count(*) - count({column}) AS null_count, count({column}) AS non_null_count,"
        f" CASE WHEN count(DISTINCT {column}) > 2048 THEN '>=2049' ELSE CAST(count(DISTINCT {column}) AS VARCHAR) END AS unique_count,"
        f" CASE WHEN count(DISTINCT {column}) = 1 AND count(*) = count({column}) THEN min({text}) END AS constant_value, {top} AS top_values FROM {_PROFILED}"
    )


@query("profile", " UNION ALL ".join(_profile_sql(c, h) for c, h in (("o_orderstatus", "string"), ("o_orderpriority", "string"), ("buyer", "int"), ("same", "string"))))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct values and most frequent values of each column."""
    from tabflow.governance import evidence

    df = table(spark, sf_dir, "orders").selectExpr("o_orderstatus", "o_orderpriority", "if(o_orderstatus = 'F', null, o_custkey) buyer", "'x' same")
    return evidence.profile(Relation.of(df))


@query(
    "clinical_checks",
    """WITH dm AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), ae AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT 'LB' AS domain, 'TABLE_MISSING' AS rule, NULL AS "column", CAST(NULL AS BIGINT) AS "row", NULL AS value
UNION ALL SELECT 'AE', 'REQUIRED_COLUMN_MISSING', 'AEDECOD', NULL, NULL
UNION ALL SELECT 'DM', 'DOMAIN_VALUE', 'DOMAIN', r, 'XX' FROM dm WHERE c_custkey % 50 = 0
UNION ALL SELECT 'DM', 'USUBJID_MISSING', 'USUBJID', r, NULL FROM dm WHERE c_custkey % 70 = 0
UNION ALL SELECT 'DM', 'DATE_NOT_ISO', 'RFSTDTC', r, 'not a date' FROM dm WHERE c_custkey % 90 = 0
UNION ALL SELECT 'AE', 'DATE_NOT_ISO', 'AESTDTC', r, strftime(o_orderdate, '%Y-%m') FROM ae WHERE o_orderkey % 100 = 0""",
)
def clinical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of tables made to have some: wrong domains, missing subjects, dates that aren't days."""
    from tabflow.governance import sdtm

    dm = table(spark, sf_dir, "customer").selectExpr("if(c_custkey % 50 = 0, 'XX', 'DM') DOMAIN", "if(c_custkey % 70 = 0, null, c_name) USUBJID", "c_custkey SUBJID", "'A' SITEID", "'M' SEX", "'W' RACE", "if(c_custkey % 90 = 0, 'not a date', '2020-01-31') RFSTDTC", "c_custkey k")
    ae = table(spark, sf_dir, "orders").selectExpr("'AE' DOMAIN", "'s' USUBJID", "date_format(o_orderdate, if(o_orderkey % 100 = 0, 'yyyy-MM', 'yyyy-MM-dd')) AESTDTC", "o_orderkey k")
    return sdtm.validate({"dm": Relation(dm, tuple(dm.columns), ("k",)), "ae": Relation(ae, tuple(ae.columns), ("k",))})


_FLOW = 'datasource d = inline_csv columns(a: int, b: int, label: string) do\n  a,b,label\n  6,7,x\n  3,2,y\n  9,5,x\nend\ntable t = from(d) do\n  derive(total = a + b)\n  filter(total > 6)\n  rename(label -> name)\n  select total, name\nend\ntable u = aggregate(t).class(name).var(total).stats(sum)\nsave u to "u.csv"'


def _flow(extra: str = "") -> str:
    return "# tabflow 0.1\n" + _FLOW + extra


@query("lineage", values([("a", "total", "derivation"), ("b", "total", "derivation"), ("label", "name", "rename"), ("name", "name", "flow"), ("total", "total_sum", "derivation")], '"from", "to", kind'))
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where columns come from: derivations, renames, and what an aggregate takes in."""
    from tabflow.governance import lineage as L
    from tabflow.governance import lock

    done = run(spark, _flow(), {}, "pipeline")
    edges = L.column_lineage(done.plan, {n: list(s) for n, s in lock.schemas(done.tables).items()})["edges"]
    plain = {(e["from"].rpartition(".")[2], e["to"].rpartition(".")[2], e["kind"]) for e in edges if e["kind"] != "flow" or e["to"].startswith("u.")}
    return spark.createDataFrame(sorted(plain), "from string, to string, kind string")


@query("schema_lock", values([("d", "a", "int"), ("d", "b", "int"), ("d", "label", "string")], 'datasource, "column", type'))
def schema_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns and types that a lock fixes for a datasource without pinned types."""
    from tabflow.governance import lock

    made = lock.generate(spark, compile_text(_flow().replace(" columns(a: int, b: int, label: string)", ""), "pipeline"))
    return spark.createDataFrame([(d["name"], c["name"], c["type"]) for d in made["datasources"] for c in d["columns"]], "datasource string, column string, type string")


@query("plan_round_trip", values([("x", 13), ("x", 14)], "name, total"))
def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan written as JSON, read, checked and run gives the script's table."""
    from tabflow.plans.ir import from_json, plain, to_json

    plan = from_json(json.loads(json.dumps(plain(to_json(compile_text(_flow(), "pipeline"))))))
    plan.invariants()
    return run_plan(spark, plan)["t"].select("name", "total")


@query("amended_plan", values([("x", 13), ("x", 14), ("y", 5)], "name, total"))
def amended_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed edit of a filter's literal, then the amended plan's table."""
    from tabflow.governance import amend

    plan = compile_text(_flow(), "pipeline")
    step = next(s for s in plan.steps if s.op == "filter").outputs[0]
    new = amend.apply(plan, [{"kind": "edit_expr", "step": step, "at": ["predicate", "right"], "edit": "replace_literal", "literal": 4}], set())
    return run_plan(spark, new)["t"].select("name", "total")


@query("formatted_script", values([("same_plan", 1), ("stable", 1)], "property, holds"))
def formatted_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatter keeps a script's plan, and leaves its own result alone."""
    from tabflow.governance import printer
    from tabflow.plans.ir import step_id

    ugly = _flow().replace("a + b", "a+b").replace("total > 6", "total>6").replace("  derive", "      derive")
    made = printer.format_text(ugly)
    same = [step_id(s) for s in compile_text(made, "pipeline").steps] == [step_id(s) for s in compile_text(ugly, "pipeline").steps]
    return spark.createDataFrame([("same_plan", int(same)), ("stable", int(printer.format_text(made) == made))], "property string, holds int")


@query("verified_bundle", values([("changed", "changed: outputs/u.csv"), ("intact", "")], "state, finding"))
def verified_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's bundle is intact, until an output is changed."""
    import tempfile
    from pathlib import Path

    from tabflow.governance import bundle

    with tempfile.TemporaryDirectory() as folder:  # bundles are the driver's own files
        bundle.create(spark, _flow(), folder, language="pipeline")
        intact = bundle.verify(folder)
        Path(folder, "outputs/u.csv").write_text("x\n")
        changed = bundle.verify(folder)
    return spark.createDataFrame([("intact", ";".join(intact)), ("changed", ";".join(changed))], "state string, finding string")
