import random

from tabflow.operators import order, project
from tabflow.relation import Relation
from tabflow.session import run


def test_parquet_rows_keep_the_order_of_files_and_places(spark, tmp_path):
    rng = random.Random(0)
    want = []
    for name in ("b file", "a", "c"):
        rows = [(name, rng.randint(0, 9)) for _ in range(50)]
        spark.createDataFrame(rows, "f string, v long").coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        part = next((tmp_path / name).glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{name}.parquet")
    rel = Relation.of(spark.read.parquet(f"file://{tmp_path}/all"))
    assert len(rel.order) == 2
    got = [tuple(r) for r in rel.ordered().collect()]
    assert [f for f, _ in got] == ["a"] * 50 + ["b file"] * 50 + ["c"] * 50
    want = sorted(got, key=lambda r: r[1])  # a stable sort
    assert [tuple(r) for r in order.sort(rel, ["v"]).ordered().collect()] == want
    one = Relation.of(spark.read.parquet(f"file://{tmp_path}/all/a.parquet"))
    assert len(one.order) == 1


def test_changed_order_columns_keep_the_order(spark, inline):
    rel = order.sort(inline("a,b\n3,x\n1,y\n2,z\n"), ["a"])
    from tabflow.functions.expr import parse

    changed = project.assign(rel, [("a", parse("0 - a"))])
    assert [r["b"] for r in changed.ordered().collect()] == ["y", "z", "x"]
    dropped = project.drop(rel, ["a"])
    assert [r["b"] for r in dropped.ordered().collect()] == ["y", "z", "x"]
    swapped = project.rename(rel, [("a", "b"), ("b", "a")])
    assert [tuple(r) for r in swapped.ordered().collect()] == [(1, "y"), (2, "z"), (3, "x")]


def test_sort_is_not_physical_until_a_sink(spark, sf):
    r = run(spark, "proc sort data=orders out=s; by o_totalprice; run; data out; set s; x = o_totalprice * 2; keep o_orderkey x; run;", {"orders": spark.read.parquet(f"{sf}/orders.parquet")})
    plan = r["out"]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "o_custkey" not in plan.split("ReadSchema")[-1]


def test_unsorted_files_are_found(spark, tmp_path):
    import pytest

    from tabflow.errors import Refusal

    spark.range(10, 20).toDF("k").coalesce(1).write.parquet(f"file://{tmp_path}/p")
    spark.range(0, 5).toDF("k").coalesce(1).write.parquet(f"file://{tmp_path}/q")
    text = "data out; set x; by k; if first.k; run;"
    run(spark, text, {"x": spark.read.parquet(f"file://{tmp_path}/p")})
    with pytest.raises(Refusal):
        run(spark, text, {"x": spark.read.parquet(f"file://{tmp_path}/p", f"file://{tmp_path}/q").orderBy("k").selectExpr("20 - k as k").coalesce(1)})
