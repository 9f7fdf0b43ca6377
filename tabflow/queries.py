"""One query for each operator of the languages, over the driver's tables, with the SQL of the same rows.

Queries are scripts of the two languages.  Rows are put in a unique order before anything
that observes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.relation import Relation
from tabflow.session import run

#: The event types of the test data.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def script(name: str, tables: str, text: str, oracle: str | None, language: str = "batch", result: str = "out") -> None:
    """Register a script over tables as a query."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = {t: table(spark, sf_dir, t) for t in tables.split()}
        head = "# tabflow 0.1\n" + "".join(f'datasource {t}_file = parquet("{sf_dir}/{t}.parquet")\ntable {t} = from({t}_file)\n' for t in bound) if language == "pipeline" else ""
        return run(spark, head + text, {} if language == "pipeline" else bound, language, wanted={result})[result]

    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def pipeline(name: str, tables: str, text: str, oracle: str | None) -> None:
    script(name, tables, text, oracle, "pipeline")


# --- projection, expressions, filters, casts ---------------------------------------------

pipeline("scan_identity", "nation", "table out = nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
pipeline("select_columns", "customer", "table out = customer select c_custkey, c_name, c_acctbal", "SELECT c_custkey, c_name, c_acctbal FROM customer")
pipeline("select_brackets", "part", "table out = part[p_partkey, p_brand]", "SELECT p_partkey, p_brand FROM part")
pipeline("drop_columns", "supplier", "table out = supplier do\n drop s_name, s_acctbal\nend", "SELECT s_suppkey, s_nationkey FROM supplier")
pipeline("rename_columns", "nation", "table out = nation do\n rename(n_nationkey -> n_regionkey, n_regionkey -> n_nationkey, n_name -> name)\nend", "SELECT n_nationkey AS n_regionkey, n_name AS name, n_regionkey AS n_nationkey FROM nation")
pipeline(
    "derive_sequential",
    "lineitem",
    "table out = lineitem do\n derive(gross = l_extendedprice * (1 - l_discount), net = gross * (1 + l_tax), half = l_linenumber / 2)\n select l_orderkey, l_linenumber, gross, net, half\nend",
    "SELECT l_orderkey, l_linenumber, gross, gross * (1 + l_tax) AS net, l_linenumber / 2.0::DOUBLE AS half FROM (SELECT *, l_extendedprice * (1 - l_discount) AS gross FROM lineitem)",
)
pipeline("update_overwrite", "part", "table out = part do\n update!(p_size = p_size * 2 + 1)\n select p_partkey, p_size\nend", "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS p_size FROM part")
pipeline(
    "filter_logic",
    "lineitem",
    'table out = lineitem do\n filter(l_quantity > 10 and (l_returnflag == "R" or not l_discount >= 0.05) and l_linenumber != 3)\n select l_orderkey, l_linenumber, l_quantity, l_returnflag\nend',
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 10 AND (l_returnflag = 'R' OR NOT l_discount >= 0.05) AND l_linenumber <> 3",
)
script(
    "missing_less_than",
    "customer orders",
    "proc sql; create table j as select customer.c_custkey, orders.o_totalprice from customer left join orders on customer.c_custkey = orders.o_custkey and orders.o_totalprice > 150000; quit;\ndata out; set j; if o_totalprice < 200000; run;",
    "SELECT c_custkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 WHERE o_totalprice IS NULL OR o_totalprice < 200000",
)
script(
    "null_safe_equality",
    "customer orders",
    "proc sql; create table j as select customer.c_custkey, orders.o_orderstatus from customer left join orders on customer.c_custkey = orders.o_custkey; quit;\ndata out; set j; same = if(o_orderstatus == ., 1, 0); fresh = if(o_orderstatus != 'F', 1, 0); run;",
    "SELECT c_custkey, o_orderstatus, CAST(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END AS BIGINT) AS same, CAST(CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 1 ELSE 0 END AS BIGINT) AS fresh FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
pipeline(
    "if_ternary",
    "orders",
    'table out = orders do\n derive(band = if(o_totalprice > 200000, "high", if(o_totalprice > 100000, "mid", "low")))\n select o_orderkey, band\nend',
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
)
script(
    "coalesce_values",
    "customer orders",
    "proc sql; create table j as select customer.c_custkey, orders.o_orderkey, orders.o_orderstatus from customer left join orders on customer.c_custkey = orders.o_custkey; quit;\ndata out; set j; key = coalesce(o_orderkey, -1); st = coalesce(., o_orderstatus, 'none'); keep c_custkey key st; run;",
    "SELECT c_custkey, coalesce(o_orderkey, -1) AS key, coalesce(o_orderstatus, 'none') AS st FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
pipeline(
    "const_bindings",
    "lineitem",
    'const { limit = 30, flag = "N", share = 0.5 }\nlet twice = limit * 2\ntable out = lineitem do\n filter(l_quantity > limit and l_returnflag == flag)\n derive(part = l_quantity * share, most = twice)\n select l_orderkey, l_linenumber, part, most\nend',
    "SELECT l_orderkey, l_linenumber, l_quantity * 0.5 AS part, CAST(60 AS BIGINT) AS most FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'N'",
)
pipeline("cast_int_null", "orders", "table out = orders do\n cast(o_orderpriority -> int on_error=null, o_orderkey -> str)\n select o_orderkey, o_orderpriority\nend", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS o_orderpriority FROM orders")
script(
    "cast_text_numbers",
    "orders",
    "proc format; value $pri '1-URGENT'='1' '2-HIGH'=' 2.5 ' '3-MEDIUM'='x' other=''; run;\ndata out; set orders; n = input(put(o_orderpriority, $pri.), best.); tenths = if(n == ., -1, if(n == 2.5, 25, if(n == 1, 10, 0))); keep o_orderkey tenths; run;",
    "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 25 ELSE -1 END AS BIGINT) AS tenths FROM orders",
)
pipeline(
    "cast_bool_date_datetime",
    "orders",
    "table out = orders do\n derive(day = o_orderdate, flag = o_orderkey)\n cast(day -> datetime, flag -> bool on_error=null)\n select o_orderkey, day, flag\nend",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day, CASE o_orderkey WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS flag FROM orders",
)
pipeline(
    "cast_decimal_trim",
    "part",
    "table out = part do\n derive(price = p_retailprice)\n cast(price -> decimal trim=true, p_size -> decimal)\n derive(large = if(price * p_size > 20000.5, 1, 0), same = if(price * 2 - price == price, 1, 0))\n select p_partkey, large, same\nend",
    "SELECT p_partkey, CAST(CASE WHEN p_retailprice * p_size > 20000.5 THEN 1 ELSE 0 END AS BIGINT) AS large, CAST(1 AS BIGINT) AS same FROM part",
)

# --- sort, aggregate ---------------------------------------------------------------------

script("sort_nodupkey", "orders", "proc sort data=orders out=a; by o_custkey o_orderkey; run;\nproc sort data=a out=out nodupkey; by o_custkey; run;", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
pipeline(
    "aggregate_all_stats",
    "lineitem",
    "table out = aggregate(lineitem).class(l_returnflag, l_linestatus).var(l_quantity, l_extendedprice).stats(mean, sum, min, max, count, n)",
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(f"{f}({v}) AS {v}_{s}" if s not in ("count", "n") else f"count(*) AS {v}_{s}" for v in ("l_quantity", "l_extendedprice") for s, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("count", ""), ("n", "")))
    + " FROM lineitem GROUP BY 1, 2",
)
pipeline("aggregate_global", "orders", "table out = aggregate(orders).var(o_totalprice).stats(mean, max, n)", "SELECT avg(o_totalprice) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max, count(*) AS o_totalprice_n FROM orders")
pipeline("aggregate_global_empty", "orders", "table none = orders filter o_totalprice < 0\ntable out = aggregate(none).var(o_totalprice).stats(sum, n)", "SELECT sum(o_totalprice) AS o_totalprice_sum, count(*) AS o_totalprice_n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
script(
    "aggregate_count_includes_nulls",
    "customer orders",
    "proc sql; create table j as select customer.c_nationkey, orders.o_totalprice from customer left join orders on customer.c_custkey = orders.o_custkey; quit;\nproc summary data=j nway; class c_nationkey; var o_totalprice; output out=out n= mean= / autoname; run;",
    "SELECT c_nationkey, count(*) AS o_totalprice_n, avg(o_totalprice) AS o_totalprice_mean FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
script("summary_mean", "lineitem", "proc summary data=lineitem nway; class l_returnflag; var l_discount l_tax; output out=out mean= / autoname; run;", "SELECT l_returnflag, avg(l_discount) AS l_discount_mean, avg(l_tax) AS l_tax_mean FROM lineitem GROUP BY 1")

# --- SQL ------------------------------------------------------------------------------------

script("sql_inner_join", "customer orders", "proc sql; create table out as select o.o_orderkey, c.c_name, o.o_totalprice as price from orders as o inner join customer as c on o.o_custkey = c.c_custkey where o.o_totalprice > 100000 and c.c_acctbal > 0; quit;", "SELECT o_orderkey, c_name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_acctbal > 0")
script("sql_left_join", "customer orders", "proc sql; create table out as select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey; quit;", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
script("sql_theta_join", "part supplier", "proc sql; create table out as select p.p_partkey, s.s_suppkey from part p inner join supplier s on p.p_retailprice > s.s_acctbal and p.p_size <= 5; quit;", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice > s_acctbal AND p_size <= 5")
script(
    "sql_three_way",
    "nation region supplier",
    "proc sql; create table out as select r_name, n_name, s_name from supplier inner join nation on s_nationkey = n_nationkey inner join region on n_regionkey = r_regionkey; quit;",
    "SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
script(
    "sql_where_group",
    "lineitem orders",
    "proc sql; create table out as select o_orderpriority, count(*) as n, sum(l_quantity) as qty, min(l_shipdate) as first_ship from lineitem inner join orders on l_orderkey = o_orderkey where l_quantity >= 20 group by o_orderpriority; quit;",
    "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty, min(l_shipdate) AS first_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 20 GROUP BY 1",
)
script("sql_count_col_nulls", "customer orders", "proc sql; create table out as select c_mktsegment, count(*) , count(o_orderkey), avg(o_totalprice) from customer left join orders on c_custkey = o_custkey group by c_mktsegment; quit;", "SELECT c_mktsegment, count(*) AS count, count(o_orderkey) AS count_o_orderkey, avg(o_totalprice) AS avg_o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
script("sql_global_agg", "lineitem", "proc sql; create table out as select min(l_quantity) as lo, max(l_quantity) as hi, avg(l_discount) as mid from lineitem; quit;", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_discount) AS mid FROM lineitem")
script(
    "sql_null_keys_match",
    "customer orders",
    "proc sql; create table j as select c_custkey, o_orderkey, o_orderstatus from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000; quit;\nproc sort data=j out=k nodupkey; by o_orderstatus; run;\ndata k2; set k; st = o_orderstatus; keep st; run;\nproc sql; create table out as select j.c_custkey, j.o_orderkey, k2.st from j inner join k2 on j.o_orderstatus = k2.st; quit;",
    "WITH j AS (SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000) SELECT j.c_custkey, j.o_orderkey, k.st FROM j JOIN (SELECT DISTINCT o_orderstatus AS st FROM j) k ON j.o_orderstatus IS NOT DISTINCT FROM k.st",
)

# --- formats, options ------------------------------------------------------------------------

script(
    "put_format",
    "orders",
    "proc format; value $st 'F'='finished' 'O'='open' other='other'; value $key '1'='one' other='many'; run;\ndata out; set orders; label = put(o_orderstatus, $st.); kind = put(o_orderkey, $key.); keep o_orderkey label kind; run;",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label, CASE o_orderkey WHEN 1 THEN 'one' ELSE 'many' END AS kind FROM orders",
)
pipeline("map_lookup", "orders", 'format st { "F" -> "finished", other -> "rest" }\ntable out = orders do\n derive(label = st[o_orderstatus])\n select o_orderkey, label\nend', "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'rest' END AS label FROM orders")
script("input_best", "part", "data out; set part; n = input(p_brand, best.); size = input(p_size, best.); known = if(n == ., 0, 1); keep p_partkey size known; run;", "SELECT p_partkey, p_size AS size, CAST(CASE WHEN TRY_CAST(p_brand AS DOUBLE) IS NULL THEN 0 ELSE 1 END AS BIGINT) AS known FROM part")
script(
    "dataset_options",
    "lineitem",
    "data out; set lineitem(keep=l_orderkey l_linenumber l_quantity rename=(l_quantity=qty) where=(l_quantity > 45)); dbl = qty * 2; run;",
    "SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_quantity * 2 AS dbl FROM lineitem WHERE l_quantity > 45",
)
script("stateless_order", "part", "data out; set part; if dbl > 40; dbl = p_size * 2; rename p_name = name; keep p_partkey name dbl; run;", "SELECT p_partkey, p_name AS name, CAST(p_size * 2 AS BIGINT) AS dbl FROM part WHERE p_size * 2 > 40")
script("macro_variables", "part", "%let most = 10;\n%let col = p_size;\ndata out; set part(where=(&col <= &most.)); keep p_partkey &col; run;", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10")

# --- merge -----------------------------------------------------------------------------------

_SPENT = "proc sql; create table spent0 as select o_custkey, sum(o_totalprice) as total, count(*) as n from orders where o_totalprice > 100000 group by o_custkey; quit;\ndata spent; set spent0; rename o_custkey = c_custkey; run;\nproc sort data=customer out=cust nodupkey; by c_custkey; run;\n"
_SPENT_SQL = "WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) "
script("merge_one_to_one", "customer orders", _SPENT + "data out; merge cust(keep=c_custkey c_name) spent; by c_custkey; run;", _SPENT_SQL + "SELECT coalesce(c_custkey, k) AS c_custkey, c_name, total, n FROM customer FULL JOIN s ON c_custkey = k")
_LINES = "data o; set orders(keep=o_orderkey o_orderstatus o_totalprice rename=(o_orderkey=k)); if o_totalprice > 50000; run;\ndata l; set lineitem(keep=l_orderkey l_linenumber l_quantity rename=(l_orderkey=k)); if l_quantity > 5; run;\nproc sort data=o out=os; by k; run;\nproc sort data=l out=ls; by k l_linenumber; run;\n"
_LINES_SQL = "WITH o AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 50000), l AS (SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 5) "
script("merge_one_to_many", "orders lineitem", _LINES + "data out; merge os ls; by k; run;", _LINES_SQL + "SELECT coalesce(o.k, l.k) AS k, o_orderstatus, o_totalprice, l_linenumber, l_quantity FROM o FULL JOIN l ON o.k = l.k")
script("merge_in_inner", "orders lineitem", _LINES + "data out; merge os(in=a) ls(in=b); by k; if a and b; keep k o_orderstatus l_linenumber; run;", _LINES_SQL + "SELECT o.k, o_orderstatus, l_linenumber FROM o JOIN l ON o.k = l.k")
script("merge_in_left", "orders lineitem", _LINES + "data out; merge os(in=a) ls(in=b); by k; if a; hit = if(b, 1, 0); keep k l_linenumber hit; run;", _LINES_SQL + "SELECT o.k, l_linenumber, CAST(CASE WHEN l.k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS hit FROM o LEFT JOIN l ON o.k = l.k")
script("merge_in_anti", "orders lineitem", _LINES + "data out; merge os(in=a) ls(in=b); by k; if b and not a; keep k l_linenumber l_quantity; run;", _LINES_SQL + "SELECT k, l_linenumber, l_quantity FROM l WHERE k NOT IN (SELECT k FROM o)")
script(
    "merge_column_overwrite",
    "customer orders",
    _SPENT + "data c; set cust(keep=c_custkey c_acctbal rename=(c_acctbal=total)); run;\ndata out; merge c spent(keep=c_custkey total); by c_custkey; run;",
    _SPENT_SQL + "SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN total ELSE c_acctbal END AS total FROM customer FULL JOIN s ON c_custkey = k",
)
script(
    "merge_by_flags",
    "orders lineitem",
    _LINES + "data m; merge os(in=a) ls(in=b); by k; if a and b; f = if(first.k, 1, 0); z = if(last.k, 1, 0); both = f * z; keep k f z both; run;\nproc summary data=m nway; class k; var f z both; output out=out sum= n= / autoname; run;",
    _LINES_SQL + "SELECT o.k, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}_sum, count(*) AS {c}_n" for c, v in (("f", "1"), ("z", "1"), ("both", "CASE WHEN count(*) = 1 THEN 1 ELSE 0 END"))) + " FROM o JOIN l ON o.k = l.k GROUP BY 1",
)

# --- group flags, state, control flow ------------------------------------------------------

script(
    "by_first_last",
    "lineitem",
    "proc sort data=lineitem out=s; by l_orderkey l_linenumber l_partkey; run;\ndata out; set s; by l_orderkey; if first.l_orderkey or last.l_orderkey; keep l_orderkey l_linenumber l_partkey; run;",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 OR row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1",
)
script(
    "by_first_multikey",
    "events",
    "proc sort data=events out=s; by user_id event_type event_id; run;\ndata out; set s; by user_id event_type; fu = if(first.user_id, 1, 0); ft = if(first.event_type, 1, 0); lt = if(last.event_type, 1, 0); keep event_id fu ft lt; run;",
    "SELECT event_id, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS fu, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS ft, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1 THEN 1 ELSE 0 END AS BIGINT) AS lt FROM events",
)
_EVENTS = "proc sort data=events out=s; by user_id event_id; run;\n"
script(
    "retain_running_sum",
    "events",
    _EVENTS + "data out; set s; by user_id; retain n; if first.user_id then n = 0; if event_type == 'click' then n = n + 1; keep event_id n; run;",
    "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM events",
)
script(
    "retain_locf",
    "events",
    _EVENTS + "data out; set s; by user_id; retain last; if first.user_id then last = .; if event_type == 'purchase' then last = event_id; keep event_id last; run;",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last FROM events",
)
script(
    "retain_previous",
    "events",
    _EVENTS + "data out; set s; by user_id; retain prev; if first.user_id then prev = .; gap = event_id - prev; prev = event_id; keep event_id gap; run;",
    "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events",
)
script(
    "if_then_else_chain",
    "part",
    "data out; set part; length = 0; if p_size < 10 then band = 'small'; else if p_size < 30 then do; band = 'middle'; length = p_size; end; else band = 'large'; if p_size > 0 then output; keep p_partkey band length; run;",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band, CAST(CASE WHEN p_size >= 10 AND p_size < 30 THEN p_size ELSE 0 END AS BIGINT) AS length FROM part WHERE p_size > 0",
)
script(
    "select_when",
    "orders",
    "data out; set orders; select (o_orderstatus); when ('F') code = 1; when ('O', 'P') code = 2; otherwise code = 0; end; keep o_orderkey code; run;",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus IN ('O', 'P') THEN 2 ELSE 0 END AS BIGINT) AS code FROM orders",
)
script("do_loop_output", "nation", "data out; set nation; do i = 1 to 9 by 2; sq = i * i + n_regionkey; output; end; keep n_nationkey i sq; run;", "SELECT n_nationkey, i, i * i + n_regionkey AS sq FROM nation, (SELECT unnest(range(1, 10, 2)) AS i)")
script("do_loop_long", "region", "data out; set region; total = 0; do i = 1 to 500; total = total + i; end; keep r_regionkey total; run;", "SELECT r_regionkey, CAST(125250 AS BIGINT) AS total FROM region")
script(
    "multi_output",
    "orders",
    "data big small; set orders; if o_totalprice > 200000 then output big; else output small; keep o_orderkey; run;\ndata out; merge big(in=b) small(in=s); by o_orderkey; size = if(b, 'big', 'small'); keep o_orderkey size; run;",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders",
)
script(
    "transpose_last_wins",
    "events",
    "proc sort data=events out=s; by user_id event_id; run;\nproc transpose data=s out=out; by user_id; id event_type; var event_id; run;",
    "SELECT user_id, " + ", ".join(f"max(event_id) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id",
)

# --- everything together ------------------------------------------------------------------

script(
    "revenue_by_segment",
    "customer orders lineitem",
    "proc sql; create table j as select c_mktsegment, o_orderpriority, l_extendedprice, l_discount from lineitem inner join orders on l_orderkey = o_orderkey inner join customer on o_custkey = c_custkey; quit;\ndata r; set j; revenue = l_extendedprice * (1 - l_discount); run;\nproc summary data=r nway; class c_mktsegment o_orderpriority; var revenue; output out=out sum= n= / autoname; run;",
    "SELECT c_mktsegment, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS revenue_sum, count(*) AS revenue_n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a table as CSV in order and read it back with pinned types."""
    from tabflow.sources import csv as C

    path = scratch_file(spark, "nation.csv")
    C.write(Relation.of(table(spark, sf_dir, "nation")), path)
    rel, _ = C.typed(C.relation(spark, C.read_text(spark, path)), [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")])
    return rel.visible()


def xpt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a table as a transport file and read it back; numbers come back as doubles, names with 8 bytes."""
    from tabflow.sources import xpt

    path = scratch_file(spark, "nation.xpt")
    xpt.write(Relation.of(table(spark, sf_dir, "nation")), path, "NATION")
    return xpt.read(spark, path).visible()


def scratch_file(spark: SparkSession, name: str) -> str:
    """A place in the folder that the cluster shares, as a URI, for files that the driver writes and executors read."""
    import tempfile
    import uuid

    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/checkpoints"
    at = at if "://" in at else f"file://{at}"
    return f"{at.rstrip('/')}/tabflow-{uuid.uuid4().hex}/{name}"


QUERIES["csv_roundtrip"] = csv_roundtrip
ORACLES["csv_roundtrip"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
QUERIES["xpt_roundtrip"] = xpt_roundtrip
ORACLES["xpt_roundtrip"] = "SELECT CAST(n_nationkey AS DOUBLE) AS n_nation, n_name, CAST(n_regionkey AS DOUBLE) AS n_region FROM nation"


def stream_row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-wise plan over a stream of the events' file, drained to a table in the shared folder."""
    from tabflow import streaming
    from tabflow.frontend import sas

    events = table(spark, sf_dir, "events")
    # a stream reads a folder: of the data folder, the events' file
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    plan = sas.compile_script("data out; set events(where=(value > 50)); big = if(value > 90, 1, 0); keep event_id big; run;", True)
    made = streaming.apply(plan, stream, "events", "out")
    path = scratch_file(spark, "rows")
    made.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_file(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


QUERIES["stream_row_wise"] = stream_row_wise
ORACLES["stream_row_wise"] = "SELECT event_id, CAST(CASE WHEN value > 90 THEN 1 ELSE 0 END AS BIGINT) AS big FROM events WHERE value > 50"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_segment"](spark, sf_dir).select("c_mktsegment", "o_orderpriority", "revenue_sum", F.col("revenue_n"))
