from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabflow.errors import Refusal
from tabflow.functions import expr as E
from tabflow.functions.columns import Compiler
from tabflow.operators.datastep import evaluate

NAMES = st.sampled_from(["a", "b", "t.c"])
LEAVES = st.one_of(st.none().map(E.Lit), st.integers(0, 99).map(E.Lit), st.booleans().map(E.Lit), st.sampled_from(["", "x y"]).map(E.Lit), NAMES.map(E.Ref), st.just(E.Lit(Decimal("2.50"))))


def _logic(op):
    def make(args):
        flat = [b for a in args for b in (a.args if isinstance(a, E.Logic) and a.op == op else (a,))]
        return E.Logic(op, tuple(flat))

    return make


TREES = st.recursive(
    LEAVES,
    lambda t: st.one_of(
        st.builds(E.Binary, st.sampled_from(["+", "-", "*", "/", *sorted(E.COMPARE)]), t, t),
        st.lists(t, min_size=2, max_size=3).map(_logic("and")),
        st.lists(t, min_size=2, max_size=3).map(_logic("or")),
        t.map(lambda x: E.Logic("not", (x,))),
        st.lists(t, min_size=1, max_size=3).map(lambda a: E.Call("coalesce", tuple(a))),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(TREES)
def test_text_and_json_round_trip(tree):
    assert E.from_json(E.to_json(tree)) == tree
    assert E.parse(E.to_text(tree)) == tree


@pytest.mark.parametrize(
    ("text", "code"),
    [("a <> 1", "E_LEGACY_EXPR"), ("a = 1", "E_BAD_EXPR"), ("a eq 1", "E_BAD_EXPR"), ("upper(a)", "E_UNSUPPORTED_FUNCTION"), ("a +", "E_BAD_EXPR"), ("(a", "E_BAD_EXPR"), ("a @ b", "E_BAD_EXPR"), ("", "E_BAD_EXPR"), ("1 < 2 < 3", "E_BAD_EXPR"), ("if(a, b)", "E_BAD_EXPR")],
)
def test_refusals(text, code):
    with pytest.raises(Refusal) as e:
        E.parse(text)
    assert e.value.code == code


def test_legacy_operators_leave_strings_alone():
    assert E.parse("a eq 'x eq y' and b ^= 2", legacy=True) == E.Logic("and", (E.Binary("==", E.Ref("a"), E.Lit("x eq y")), E.Binary("!=", E.Ref("b"), E.Lit(2))))


def test_sign_binds_tighter_than_sum():
    assert E.parse("-a + b") == E.Binary("+", E.Binary("-", E.Lit(0), E.Ref("a")), E.Ref("b"))


CASES = ["a < b", "a <= b", "a > b", "a >= b", "a == b", "a != b", "a < 2", "2 < a", "a >= 1 and not b == 2", "if(a, b, a)", "coalesce(a, b, 7)", "a + b * 2", "a - b", "a == .", "(a > 1) == (b > 1)", "a or b"]


def test_columns_agree_with_the_row_evaluator(spark, inline):
    """All pairs of values, missing included, under every expression; as a filter too."""
    values = [None, 0, 1, 2, 3]
    text = "a,b\n" + "\n".join(f"{'' if a is None else a},{'' if b is None else b}" for a in values for b in values) + "\n"
    text = text.replace("\n,\n", '\n"",""\n')
    rel = inline(text)
    rows = rel.ordered().collect()
    assert len(rows) == 25
    trees = [E.parse(c) for c in CASES]
    got = rel.df.orderBy(*rel.order_columns()).select(*[Compiler(rel.env())(t).col.alias(f"c{i}") for i, t in enumerate(trees)]).collect()
    for row, out in zip(rows, got, strict=True):
        for i, t in enumerate(trees):
            assert out[i] == evaluate(t, lambda n, row=row: row[n], {}), (CASES[i], row)
    from tabflow.operators.project import filter_rows

    for i, t in enumerate(trees):
        kept = filter_rows(rel, t).visible().count()
        assert kept == sum(bool(out[i]) for out in got), CASES[i]


def test_filter_reaches_the_scan(spark, sf):
    from tabflow.operators.project import filter_rows, select
    from tabflow.relation import Relation

    rel = Relation.of(spark.read.parquet(f"{sf}/lineitem.parquet"))
    df = select(filter_rows(rel, E.parse("l_quantity > 10 and l_tax <= 0.5")), ["l_orderkey"]).visible()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert "Or(IsNull(l_tax),LessThanOrEqual(l_tax,0.5))" in plan
    assert "l_extendedprice" not in plan


def test_strict_types(spark, inline):
    rel = inline("a,s\n1,x\n")
    for text in ("a + s", "a < s", "a == s", "not a", "if(a, 1, 2)", "a + null", "a < null", "if(true, 1, \"x\")"):
        with pytest.raises(Refusal):
            Compiler(rel.env(), strict=True)(E.parse(text))
