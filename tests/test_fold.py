"""The row-by-row way of running a body gives what columns and windows give, for every kind of value."""

import random
from decimal import Decimal

import pytest

from tabflow.functions import expr as E
from tabflow.operators import datastep
from tabflow.operators.fold import _double_text
from tabflow.relation import Relation
from tabflow.session import run

BIG = 2**53 + 1
FORMATS = "proc format; value $f '5'='five' '7'='seven' '2.5'='half' '7.0'='float' 'true'='yes' other='other'; run;\n"


def table(spark, rows, partitions):
    schema = "k int, i long, x long, d double, m decimal(20,4), s string, b boolean"
    df = spark.createDataFrame(rows, schema).repartition(partitions, "i") if partitions > 1 else spark.createDataFrame(rows, schema).coalesce(1)
    return Relation(df, tuple(df.columns), ("k", "i"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pick = lambda *values: rng.choice([None, *values])
    return [(rng.randint(1, 4), BIG + i, pick(5, 7, BIG, -BIG), pick(7.0, 0.1, 1e30, float("nan")), pick(Decimal("2.5"), Decimal("5"), Decimal("7.0001")), pick("a", "", "5", " 2.5 "), pick(True, False)) for i in range(80)]


BODIES = [
    "y = x + 1; z = put(x, $f.); w = put(m, $f.); v = put(d, $f.); u = put(b, $f.);",
    "y = coalesce(x, 0) / 3; z = m * 3 - x / 7; w = d + x; v = if(x > d, x, m);",
    "if x < d then y = 1; else if m >= 2.5 then y = m; if s; z = s + 'z';",
    "n = input(s, best.); if n == 2.5 then y = n * 2; if b then output; if not b or x = . then do; y = -1; output; end;",
    "do j = 1 to 3; t = j * m; if x > j then output; end;",
    "y = m + x; z = m * m; if d ne d then q = 1; else q = 0; r = if(b, b + 1, .);",
    "retain a; if x > 6 then a = x; y = a;",
    "retain a; if first.k then a = 0; a = a + coalesce(x, 1); y = put(a, $f.);",
]


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_agree_with_columns(spark, rows, body, partitions, monkeypatch):
    text = f"{FORMATS}proc sort data=x out=t; by k i; run; data out; set t; by k; {body} run;"
    shown = lambda r: [tuple(map(repr, v)) for v in r.relation("out").ordered().collect()]
    fast = run(spark, text, {"x": table(spark, rows, partitions)})
    want, kinds = shown(fast), fast["out"].dtypes
    monkeypatch.setattr(datastep, "UNROLL", 0)
    slow = run(spark, text, {"x": table(spark, rows, partitions)})
    assert [n for n, _ in slow["out"].dtypes] == [n for n, _ in kinds]
    plain = lambda t: [tuple(_same(v) for v in r) for r in t]
    assert plain(shown(slow)) == plain(want)


def _same(shown):
    """Decimals by value: columns may keep fewer places."""
    return Decimal(shown[9:-2]).normalize() if shown.startswith("Decimal(") else shown


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_multiplying_state(spark, partitions):
    """A state that is multiplied goes row by row, over all rows or by group, with whole numbers beyond 2**53 intact."""
    rows = [(1 + i % 3, BIG + i, None if i % 4 == 0 else i % 7, None, None, None, None) for i in range(40)]
    body = "acc = coalesce(acc, 0) * 2 + coalesce(x, 0); if acc > 1000 then acc = 0; label = put(x, $f.);"
    for reset in ("", "if first.k then acc = 1;"):
        got = run(spark, f"{FORMATS}proc sort data=x out=t; by k i; run; data out; set t; by k; retain acc; {reset} {body} keep k i x acc label; run;", {"x": table(spark, rows, partitions)})
        acc, last, want = None, None, []
        for k, i, x, *_ in sorted(rows, key=lambda r: r[:2]):
            if reset and k != last:
                acc = 1
            last = k
            acc = (acc or 0) * 2 + (x or 0)
            acc = 0 if acc > 1000 else acc
            want.append((k, i, x, acc, {5: "five"}.get(x, "other")))
        assert sorted(tuple(r) for r in got["out"].collect()) == want


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_long_loop(spark, partitions):
    rows = [(1, BIG + i, None if i % 2 else BIG - i, None, None, None, None) for i in range(9)]
    got = run(spark, "data out; set x; n = 0; do j = 1 to 300; n = n + coalesce(x, j); end; keep i x n; run;", {"x": table(spark, rows, partitions)})
    assert sorted(tuple(r) for r in got["out"].collect()) == sorted((i, x, 300 * x if x else 300 * 301 // 2) for _, i, x, *_ in rows)


@pytest.mark.parametrize("stretches", [2, 7, 256])
@pytest.mark.parametrize("body", ["retain s; if v > 4 then s = v; w = s;", "retain s; w = s; if v > 4 then s = v;", "retain s; if i == 3 then s = 0; s = s + v; w = s;", "retain s n; if v > 5 then s = 0; s = s + coalesce(v, 1); if v == 0 then n = i; w = n;", "retain s; if v > 5 then s = 1; s = s + v; if v > 2; w = s;"])
def test_states_are_carried_over_stretches(spark, body, stretches, monkeypatch):
    """A state that no group resets is the same whether solved in stretches of the order or row by row."""
    rng = random.Random(9)
    data = [(i // 3, i, rng.choice([None, *range(7)])) for i in range(120)]
    df = spark.createDataFrame(data, "k int, i long, v long").repartition(5)
    monkeypatch.setattr(datastep, "STRETCHES", stretches)
    text = f"proc sort data=x out=t; by k i; run; data out; set t; {body} run;"
    rel = lambda: Relation(df, ("k", "i", "v"), ("k", "i"))
    fast = [tuple(r) for r in run(spark, text, {"x": rel()}).relation("out").ordered().collect()]
    monkeypatch.setattr(datastep, "UNROLL", 0)
    assert fast == [tuple(r) for r in run(spark, text, {"x": rel()}).relation("out").ordered().collect()]


@pytest.mark.parametrize("stretches", [3, 40])
@pytest.mark.parametrize("body", ["retain s; s = coalesce(s, 3) * if(v == 5, 0, if(v == 4, -1, 1)) + k;", "retain s n; if v == . then s = .; else if v == 1 then s = 2; if n == 1 then q = 1; t = s; if v != 2; s = t * v - i + 9007199254740993 * 0 + coalesce(s, k); n = 1 - coalesce(n, 0); w = s * n; if s > 9 then w = 0;"])
def test_multiplied_states_are_carried_over_stretches(spark, body, stretches, monkeypatch):
    """Stretches of the order give what one task gives that sees all rows, and no task sees all rows."""
    rng = random.Random(9)
    data = [(i // 3, i, rng.choice([None, *range(7)])) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i long, v long").repartition(5)
    monkeypatch.setattr(datastep, "STRETCHES", stretches)
    text = f"proc sort data=x out=t; by i; run; data out; set t; {body} run;"
    made = lambda: run(spark, text, {"x": Relation(df, ("k", "i", "v"), ("k", "i"))})
    shown = lambda r: [tuple(v) for v in r.relation("out").ordered().collect()]
    many = made()
    assert "hashpartitioning(__tf_z" in many["out"]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(datastep, "linear", lambda *args: None)
    assert shown(many) == shown(made())


def test_failures(spark, rows, monkeypatch):
    monkeypatch.setattr(datastep, "UNROLL", 0)
    for body, message in (("y = 1 / (k - k);", "DIVIDE_BY_ZERO"), ("y = i * i * i;", "ARITHMETIC_OVERFLOW")):
        with pytest.raises(Exception, match=message):
            run(spark, f"data out; set x; {body} run;", {"x": table(spark, rows, 2)})["out"].collect()


def test_doubles_as_text(spark):
    values = [0.0, 5.0, -0.001, 1e7, 9999999.5, 1.5e-4, 123456789.125, 1e300, float("inf"), float("nan")]
    shown = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("cast(v as string) s").collect()
    assert [_double_text(v) for v in values] == [r["s"] for r in shown]


def test_single_expressions():
    e = E.parse("coalesce(a, 2) * 3 > b and not c")
    assert datastep.evaluate(e, {"a": None, "b": 5, "c": False}.get, {}) is True
