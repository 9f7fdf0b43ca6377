import pytest

from tabflow.errors import Refusal
from tabflow.operators import datastep
from tabflow.session import run

G = "id,val\n"


def out(r, name="out"):
    return [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in x) for x in r.relation(name).ordered().collect()]


CASES = [
    ("assign_subset", "data out; set x; c = a + b; if c > 20; run;", {"x": "a,b\n1,10\n2,20\n3,30\n"}, [(2, 20, 22), (3, 30, 33)]),
    ("merge_in", "data out; merge a(in=ina) b(in=inb); by id; if ina and inb; keep id aval bval; run;", {"a": "id,aval\n1,10\n2,20\n", "b": "id,bval\n1,100\n1,101\n2,200\n"}, [(1, 10, 100), (1, 10, 101), (2, 20, 200)]),
    ("merge_where", "data out; merge a(where=(aval > 0)) b; by id; run;", {"a": "id,aval\n1,0\n1,1\n", "b": "id,bval\n1,100\n"}, [(1, 1, 100)]),
    ("merge_missing_key", "data out; merge a b; by id; run;", {"a": "id,p\n,1\n1,2\n", "b": "id,q\n,5\n2,6\n"}, [(None, 1, 5), (1, 2, None), (2, None, 6)]),
    ("merge_three", "data out; merge a b c; by id; run;", {"a": "id,p\n1,1\n2,2\n", "b": "id,q\n1,5\n1,6\n", "c": "id,q\n2,9\n"}, [(1, 1, 5), (1, 1, 6), (2, 2, 9)]),
    ("merge_flags", "data out; merge a(in=ina) b(in=inb); by id; keep id ina inb; run;", {"a": "id,aval\n1,10\n2,20\n", "b": "id,bval\n1,100\n"}, [(1, True, True), (2, True, False)]),
    ("first", "data out; set x; by id; if first.id then output; run;", {"x": "id,seq\n1,1\n1,2\n2,1\n"}, [(1, 1), (2, 1)]),
    ("last_two_keys", "data out; set x; by id t; if last.t; run;", {"x": "id,t,v\n1,a,1\n1,a,2\n1,b,3\n2,a,4\n2,a,5\n"}, [(1, "a", 2), (1, "b", 3), (2, "a", 5)]),
    ("else_missing", "data out; set x; if val > 0 then flag = 1; else flag = .; run;", {"x": G + "1,0\n2,5\n"}, [(1, 0, None), (2, 5, 1)]),
    ("missing_is_small", "data out; set x; if a < 5 then output; run;", {"x": "a,b\n,1\n5,1\n"}, [(None, 1)]),
    ("loop_by", "data out; set x; do i = 1 to 5 by 2; output; end; run;", {"x": "id\n1\n"}, [(1, 1), (1, 3), (1, 5)]),
    ("loop_down_none", "data out; set x; n = 0; do i = 1 to 0; n = n + 1; end; run;", {"x": "id\n1\n"}, [(1, 0)]),
    ("nested_do", "data out; set x; if val > 1 then do; do; val = val * 2; end; val = val + 2; end; run;", {"x": G + "1,2\n"}, [(1, 6)]),
    ("select_values", "data out; set x; select (g); when ('HIGH') l = 2; when ('LOW', 'MID') l = 1; otherwise l = 0; end; run;", {"x": "g\nHIGH\nMID\nz\n"}, [("HIGH", 2), ("MID", 1), ("z", 0)]),
    ("lag", "data out; set x; retain prev; diff = val - prev; prev = val; keep id diff; run;", {"x": G + "1,10\n2,15\n3,20\n"}, [(1, None), (2, 5), (3, 5)]),
    ("retain_filtered", "data out; set x; retain prev; d = val - prev; prev = val; if id != 2; keep id d; run;", {"x": G + "1,10\n2,15\n3,21\n"}, [(1, None), (3, 6)]),
    ("running_sum_poisoned", "data out; set x; by id; retain t; if first.id then t = 0; t = t + val; if last.id then output; keep id t; run;", {"x": G + "1,2\n1,3\n2,5\n2,\n3,1\n"}, [(1, 5), (2, None), (3, 1)]),
    ("sum_without_start", "data out; set x; retain t; t = t + val; keep id t; run;", {"x": G + "1,2\n2,3\n"}, [(1, None), (2, None)]),
    ("outputs", "data out other; set x; if val > 2 then output out; else output other; if val > 4 then output; keep id; run;", {"x": G + "1,2\n2,3\n3,5\n"}, [(2,), (3,), (3,)]),
    ("keep_rename", "data out; set x(keep=id val rename=(val=score)); by id; run;", {"x": "id,val,dropme\n1,10,X\n"}, [(1, 10)]),
    ("empty_input", "data out; set x(where=(id > 9)); by id; retain t; t = val; run;", {"x": G + "1,2\n"}, []),
]


@pytest.mark.parametrize(("script", "tables", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_rows(spark, inline, script, tables, want):
    assert out(run(spark, script, {n: inline(t) for n, t in tables.items()})) == want


STATE = [
    "retain s; if first.k then s = 0; if v > 1 then s = s + v;",
    "retain s; if v > 2 then s = v; w = s;",
    "retain s; w = s; if v > 2 then s = v;",
    "retain s p; if first.k then p = .; d = v - p; p = v; if d > 0 then s = d;",
    "retain s; if last.k then s = v; if v > 0; w = s;",
    "retain s; if first.k then do; s = 1; end; s = s + 1; if v > 2 then s = 0; s = s + v;",
]


@pytest.mark.parametrize("body", STATE)
def test_windows_agree_with_the_fold(spark, inline, body, monkeypatch):
    """State solved by windows is the state of a sequential run."""
    import random

    rng = random.Random(7)
    rows = sorted((rng.randint(1, 6), i, rng.choice(["", 0, 1, 2, 3, 4])) for i in range(60))
    text = "k,i,v\n" + "\n".join(f"{k},{i},{v}" for k, i, v in rows) + "\n"
    script = f"data out; set x; by k; {body} run;"
    fast = out(run(spark, script, {"x": inline(text)}))
    monkeypatch.setattr(datastep, "UNROLL", 0)
    slow = out(run(spark, script, {"x": inline(text)}))
    assert fast == slow


@pytest.mark.parametrize("n", [2, 3])
def test_joins_agree_with_the_union(spark, n, monkeypatch):
    """Merges of tables that are known to have a key once are the same by joins as by one union, with missing keys too."""
    import random

    from tabflow.operators import merge
    from tabflow.relation import Relation

    rng = random.Random(11)
    tables = {}
    for t in range(n):
        rows = [(rng.choice([None, *range(12)]), i, rng.choice([None, 1, 2])) for i in range(30)]
        tables[f"t{t}"] = Relation(spark.createDataFrame(rows, f"k int, i{t} long, v long"), ("k", f"i{t}", "v"), ("k", f"i{t}"))
    single = "".join(f"proc sort data=t{t} out=u{t} nodupkey; by k; run;\n" for t in range(n - 1))
    names = " ".join(f"u{t}(in=f{t})" for t in range(n - 1))
    for body in ("", "if f0;", "if f0 and m;", "if m and not f0;", "a = if(f0, 1, 0); b = if(m, 1, 0); if last.k;"):
        text = f"{single}proc sort data=t{n - 1} out=m; by k; run;\ndata out; merge {names} m(in=m); by k; {body} run;"
        fast = out(run(spark, text, tables))
        with monkeypatch.context() as only:
            only.setattr(merge, "joined", lambda sides, keys, known, at: merge.grouped(sides, keys, at))
            assert fast == out(run(spark, text, tables)), body
    plan = run(spark, f"{single}proc sort data=t{n - 1} out=m; by k; run;\ndata out; merge {names} m(in=m); by k; if f0 and m; run;", tables)["out"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan


REFUSED = [
    ("data out; merge a b; run;", "DATASTEP_MISSING_BY"),
    ("data out; set a; do while (1); end; run;", "LOOP_UNSUPPORTED"),
    ("data out; set a; array x a b; run;", "BLOCK_STATEFUL_TOKEN"),
    ("data out; set a b; run;", "E_SET_TABLES"),
    ("data out; set a(keep=id drop=id); run;", "E_KEEP_DROP"),
    ("data out; set a; do i = 1 to 9 by 0; end; run;", "LOOP_STEP"),
    ("data out; set a; do i = 1 to 2000000; n = i; end; run;", "LOOP_LIMIT"),
    ("data out; set a; x = first.id; run;", "BY_FLAG_UNDEFINED"),
    ("data out; set nowhere; run;", "E_UNKNOWN_TABLE"),
    ("data out; set a; output elsewhere; run;", "E_OUTPUT_TARGET"),
    ("proc means2 data=a; run;", "E_UNKNOWN_PROC"),
    ("proc sort data=a out=b; by descending id; run;", "SORT_UNSUPPORTED"),
    ("proc sql; create table o as select * from a; quit;", "SQL_UNSUPPORTED_FORM"),
    ("proc sql; create table o as select id from a join b on a.id = b.id; quit;", "SQL_UNSUPPORTED_FORM"),
    ("proc sql; create table o as select id from a inner join b on a.id = b.id; quit;", "SQL_AMBIGUOUS_COLUMN"),
    ("proc sql; create table o as select nope from a; quit;", "SQL_COLUMN_UNDEFINED"),
    ("proc sql; create table o as select id, count(*) from a group by val; quit;", "SQL_GROUP_BY_MISMATCH"),
    ("%if 1 %then x;", "MACRO_UNSUPPORTED"),
    ("data out; set a; x = put(id, $nope.); run;", "FORMAT_UNDEFINED"),
    ("proc summary data=a; class id; var val; output out=o mean= / autoname; run;", "E_SUMMARY_NWAY"),
    ("data out; set a", "E_MISSING_SEMICOLON"),
    ("data out; set a; x = 'abc; run;", "E_UNCLOSED_STRING"),
]


@pytest.mark.parametrize(("script", "code"), REFUSED)
def test_refused(spark, inline, script, code):
    with pytest.raises(Refusal) as e:
        run(spark, script, {"a": inline("id,val\n1,2\n"), "b": inline("id,val\n1,2\n")})
    assert e.value.code == code


def test_unsorted_by_is_refused(spark, inline):
    with pytest.raises(Refusal) as e:
        run(spark, "data out; set x; by id; if first.id; run;", {"x": inline("id,v\n2,1\n1,1\n")})
    assert e.value.code == "ORDER_REQUIRED"


def test_failures_that_rows_show(spark, inline):
    many = run(spark, "data out; merge a b; by id; run;", {"a": inline("id,v\n1,A\n1,B\n"), "b": inline("id,w\n1,X\n1,Y\n")})
    with pytest.raises(Exception, match="MERGE_MANY_MANY"):
        many["out"].collect()
    none = run(spark, "data out; set x; select; when (val > 5) y = 1; end; run;", {"x": inline(G + "1,2\n")})
    with pytest.raises(Exception, match="SELECT_MISMATCH"):
        none["out"].collect()


def test_clinical_chain(spark, inline):
    """Sorting, first flags, merges with presence flags and a retained baseline, end to end."""
    dm = "subjid,siteid,sex\n101,001,M\n102,001,F\n103,002,M\n"
    ex = "subjid,exstdtc\n101,2023-01-11\n102,2023-01-12\n"
    lb = "subjid,lbdtc,lbtestcd,lbstresn\n101,2023-01-10,GLUC,96\n101,2023-01-13,GLUC,110\n101,2023-01-20,GLUC,100\n102,2023-01-10,GLUC,90\n102,2023-01-15,GLUC,91\n103,2023-01-15,GLUC,99\n"
    text = """
proc sort data=dm out=dm_s; by subjid; run;
proc sort data=ex out=ex_s; by subjid exstdtc; run;
proc sort data=lb out=lb_s; by subjid lbdtc; run;
data ex_first; set ex_s; by subjid; if first.subjid then output; keep subjid exstdtc; run;
data subj; merge dm_s(in=indm) ex_first(in=inex); by subjid; if indm and inex; keep subjid siteid sex exstdtc; run;
data lb_pre; merge lb_s(in=inlb) subj(in=insubj); by subjid; if inlb and insubj; if lbdtc <= exstdtc; run;
proc sort data=lb_pre out=lb_pre_s; by subjid lbtestcd lbdtc; run;
data base; set lb_pre_s; by subjid lbtestcd; retain baseval; if first.lbtestcd then baseval = .; baseval = lbstresn; if last.lbtestcd then output; keep subjid lbtestcd baseval; run;
data out; merge lb_s(in=inlb) subj(in=insubj) base(in=inbase); by subjid; if inlb and insubj and inbase; if lbdtc > exstdtc;
  chg = lbstresn - baseval; if baseval ne 0 then pchg = (chg / baseval) * 100; else pchg = .;
  keep subjid lbdtc siteid baseval chg pchg; run;
"""
    got = out(run(spark, text, {"dm": inline(dm), "ex": inline(ex), "lb": inline(lb)}))
    assert [(r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got] == [(101, "2023-01-13", "001", 96, 14, 14.58333), (101, "2023-01-20", "001", 96, 4, 4.16667), (102, "2023-01-15", "001", 90, 1, 1.11111)]


def test_merge_and_flags_share_one_sort(spark):
    """A merge of tables not known to have a key once, and the flags of its groups, sort rows once: a task holds one sorter."""
    one = spark.createDataFrame([(k, k * 10) for k in (1, 2, 4)], "k long, v long").repartition(2)
    many = spark.createDataFrame([(k, i) for i, k in enumerate((3, 1, 1, 2, 2, 2, None, None))], "k long, w long").repartition(3)
    text = "proc sort data=one out=a; by k; run; proc sort data=many out=b; by k w; run; data out; merge a(in=p) b(in=q); by k; f = if(first.k, 1, 0); l = if(last.k, 1, 0); keep k v w f l; run;"
    out = run(spark, text, {"one": one, "many": many})["out"]
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want = [(None, None, 6, 1, 0), (None, None, 7, 0, 1), (1, 10, 1, 1, 0), (1, 10, 2, 0, 1), (2, 20, 3, 1, 0), (2, 20, 4, 0, 0), (2, 20, 5, 0, 1), (3, None, 0, 1, 1), (4, 40, None, 1, 1)]
    assert sorted(map(tuple, out.select("k", "v", "w", "f", "l").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("test", ["a.x > b.y", "a.x <= b.y and a.k != b.j", "b.y < a.x and b.j >= 2"])
def test_joins_on_inequalities_are_dealt_by_bins(spark, test, monkeypatch):
    """Large joins on an inequality are equi-joins on bins and salts, with missing values and ties as in the nested loop."""
    from tabflow.operators import sql

    one = spark.createDataFrame([(k, None if k % 9 == 0 else float("nan") if k == 4 else float(k % 13)) for k in range(60)], "k long, x double").repartition(2)
    two = spark.createDataFrame([(j, None if j % 7 == 0 else j % 11) for j in range(50)], "j long, y int").repartition(2)
    text = f"proc sql; create table out as select a.k, b.j from one a inner join two b on {test}; quit;"
    made = lambda: run(spark, text, {"one": one, "two": two})["out"]
    want = sorted(map(tuple, made().collect()))
    monkeypatch.setattr(sql, "PAIRS", 0, raising=False)
    many = made()
    assert "NestedLoop" not in (plan := many._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert sorted(map(tuple, many.collect())) == want
