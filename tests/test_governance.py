import json
from decimal import Decimal

import pytest

from tabflow.errors import Refusal
from tabflow.frontend import pipeline, sas
from tabflow.governance import amend, bundle, evidence, lineage, lock, printer, sdtm
from tabflow.operators.transpose import column_name
from tabflow.plans.ir import from_json, step_id, to_json, transform_class_id
from tabflow.session import run, run_plan
from tabflow.sources import csv as C
from tabflow.sources import xpt

TEXT = '''# tabflow 0.1
datasource in = inline_csv do
  a,b,label
  6,7,x
  3,2,y
  ,5,x
end
const { k = 2 }
table t = from(in) do
  derive(base2 = a * k)
  filter(base2 > 10 or a == null)
  select a, base2, label
end
table u = aggregate(sort(t).by(a)).class(label).var(base2).stats(sum, n)
save t to "t.csv"
assert row_count(t) > 1
'''


def test_pipeline_run_and_bundle(spark, tmp_path):
    report = bundle.create(spark, TEXT, str(tmp_path / "b"), language="pipeline")
    assert report["status"] == "ok", report
    assert (tmp_path / "b/outputs/t.csv").read_text() == "a,base2,label\n6,12,x\n,,x\n"
    assert report["asserts"] == [{"predicate": "row_count(t) > 1", "ok": True, "counts": {"t": 2}}]
    steps = json.loads((tmp_path / "b/artifacts/steps.json").read_text())
    assert {"t": 2} in [s["rows"] for s in steps]
    assert len(json.loads((tmp_path / "b/artifacts/registry.json").read_text())) >= 6
    again = bundle.create(spark, TEXT, str(tmp_path / "c"), language="pipeline")
    assert again["report_sha256"] == report["report_sha256"]
    assert bundle.verify(str(tmp_path / "b")) == []
    (tmp_path / "b/outputs/t.csv").write_text("a\n")
    assert bundle.verify(str(tmp_path / "b")) == ["changed: outputs/t.csv"]


def test_refusals_are_reported(spark, tmp_path):
    bad = bundle.create(spark, TEXT.replace("base2, label", "nope"), str(tmp_path / "b"), language="pipeline")
    assert (bad["status"], bad["exit"], bad["error"]["code"]) == ("refused", 31, "E_UNKNOWN_COLUMN")
    failed = bundle.create(spark, TEXT.replace("select a, base2, label", "cast(label -> int)"), str(tmp_path / "c"), language="pipeline")
    assert (failed["status"], failed["exit"]) == ("failed", 50) or failed["error"]["code"] == "E_UNKNOWN_COLUMN"


def test_plan_round_trip_and_printing(spark):
    plan = pipeline.compile_script(TEXT)
    data = json.loads(json.dumps(to_json(plan)))
    back = from_json(data)
    assert [step_id(s) for s in back.steps] == [step_id(s) for s in plan.order()]
    want = run(spark, TEXT, language="pipeline")["u"].collect()
    assert run_plan(spark, back)["u"].collect() == want
    assert run(spark, printer.script(plan), language="pipeline")["u"].collect() == want
    data["steps"][0]["params"]["name"] = "other"
    with pytest.raises(Refusal):
        from_json(data)


def test_identities():
    a, b = (pipeline.compile_script(TEXT.replace("k = 2", f"k = {k}")) for k in (2, 3))
    assert [transform_class_id(s) for s in a.steps if s.op == "compute"] == [transform_class_id(s) for s in b.steps if s.op == "compute"]
    assert [step_id(s) for s in a.steps] != [step_id(s) for s in b.steps]
    spaced = pipeline.compile_script(TEXT.replace("a * k", "a   *  k"))
    assert [step_id(s) for s in a.steps] == [step_id(s) for s in spaced.steps]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (("# tabflow 0.1\n", ""), "E_HEADER"),
        (("a * k)", "a * k"), "E_UNBALANCED"),
        (("from(in)", "from(nowhere)"), "E_UNDECLARED_SOURCE"),
        (("save t", "save nothing"), "E_UNKNOWN_TABLE"),
        (('"t.csv"', '"../t.csv"'), "E_SAVE_PATH"),
        (("const { k = 2 }", "const { k = a + 1 }"), "E_CONST_LITERAL"),
        (("const { k", "const { in"), "E_REDECLARED"),
        (("stats(sum, n)", "stats(median)"), "E_BAD_STAT"),
        (("  derive(", "  explode("), "E_PARSE"),
        (("== null", "= null"), "E_BAD_EXPR"),
    ],
)
def test_refused_scripts(change, code):
    with pytest.raises(Refusal) as e:
        pipeline.compile_script(TEXT.replace(*change))
    assert e.value.code == code


@pytest.mark.parametrize(("body", "code"), [("derive(a = 1)", "E_STRICT_MUTATION"), ("update!(z = 1)", "E_INVALID_UPDATE"), ("select a, zz", "E_UNKNOWN_COLUMN"), ("filter(a)", "E_TYPE"), ("derive(z = label + 1)", "E_TYPE"), ("rename(a -> b)", "E_DUPLICATE_COLUMN"), ("drop zz", "E_UNKNOWN_COLUMN")])
def test_refused_transforms(spark, body, code):
    text = TEXT.split("table t")[0] + f"table t = from(in) do\n {body}\nend\n"
    with pytest.raises(Refusal) as e:
        run(spark, text, language="pipeline")
    assert e.value.code == code


def test_formatter_is_idempotent_and_keeps_the_plan():
    ugly = TEXT.replace("a * k", "a*k").replace("select a, base2, label", "SELECT a ,base2,  label").replace("table u", "TABLE u")
    made = printer.format_text(ugly)
    assert printer.format_text(made) == made
    assert "select a, base2, label" in made
    assert [step_id(s) for s in pipeline.compile_script(made).steps] == [step_id(s) for s in pipeline.compile_script(TEXT).steps]


def test_profile(spark, inline):
    got = {r["column"]: r for r in evidence.profile(inline("a,b\n1,x\n2,x\n2,x\n")).collect()}
    assert (got["a"]["unique_count"], got["a"]["top_values"], got["a"]["constant_value"]) == ("2", "2=2;1=1", None)
    assert (got["b"]["constant_value"], got["b"]["null_count"], got["b"]["non_null_count"]) == ("x", 0, 3)
    none = evidence.profile(inline("a\n1\n").with_columns(inline("a\n1\n").df.where("a > 1"), ("a",))).first()
    assert (none["null_count"], none["unique_count"]) == (0, "0")


def test_lineage_and_graph(spark):
    r = run(spark, TEXT, language="pipeline")
    schemas = {n: list(s) for n, s in lock.schemas(r.tables).items()}
    found = lineage.column_lineage(r.plan, schemas)
    assert {"from": "t.base2", "to": "u.base2_sum", "kind": "derivation"} in [e | {} for e in found["edges"]] or any(e["to"] == "u.base2_sum" and e["kind"] == "derivation" for e in found["edges"])
    assert any(e["kind"] == "derivation" and e["from"].endswith(".a") and e["to"].endswith(".base2") for e in found["edges"])
    graph = lineage.step_graph(r.plan)
    assert len([n for n in graph["nodes"] if n["kind"] == "step"]) == len({step_id(s) for s in r.plan.steps}) or graph["nodes"]
    assert [e["effect"] for e in lineage.table_effects(r.plan)] == ["filter", "sort"]


def test_lock(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,amount,flag,code\n1,2.5,true,007\n2,,false,010\n")
    text = '# tabflow 0.1\ndatasource x = csv("x.csv")\ntable t = from(x)\n'
    plan = pipeline.compile_script(text)
    with pytest.raises(Refusal):
        lock.require(plan, {})
    made = lock.generate(spark, plan, str(tmp_path))
    assert [(c["name"], c["type"]) for c in made["datasources"][0]["columns"]] == [("id", "int"), ("amount", "decimal"), ("flag", "bool"), ("code", "string")]
    lock.write(made, str(tmp_path / "schema.lock.json"))
    locks = lock.load(str(tmp_path / "schema.lock.json"))
    assert lock.discover(str(tmp_path / "s.flow")) == str(tmp_path / "schema.lock.json")
    got = run(spark, text, language="pipeline", base=str(tmp_path), locks=locks)["t"].collect()
    assert [tuple(r) for r in got] == [(1, Decimal("2.5"), True, "007"), (2, None, False, "010")]
    (tmp_path / "x.csv").write_text("id,amount\n1,2\n")
    with pytest.raises(Refusal) as e:
        run(spark, text, language="pipeline", base=str(tmp_path), locks=locks)
    assert e.value.code == "E_SCHEMA_MISSING_COL"


def test_coercion_evidence(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x, ""y"""\nq,z\n3,\n1_0,w\n')
    rel = C.relation(spark, C.read_text(spark, str(tmp_path / "x.csv")))
    with pytest.raises(Refusal) as e:
        C.typed(rel, [("a", "int"), ("b", "string")])
    assert e.value.code == "E_CSV_COERCE"
    assert e.value.evidence["a"] == {"expected": "int", "reason": "invalid_int", "failures": 2, "rows": [2, 4], "values": ["1_0", "q"]}
    with pytest.raises(Refusal) as e:
        C.typed(rel, [("b", "string"), ("a", "int")])
    assert e.value.code == "DATASOURCE_SCHEMA_MISMATCH"
    text, _ = C.typed(rel, [("a", "string"), ("b", "string")])
    C.write(text, str(tmp_path / "y.csv"))
    assert (tmp_path / "y.csv").read_text() == (tmp_path / "x.csv").read_text()


def test_parts_are_in_order(spark, tmp_path):
    r = run(spark, TEXT.replace("sort(t)", "sort(in)").replace("var(base2)", "var(b)"), language="pipeline")
    r.write(str(tmp_path), parts=True)
    lines = [x for p in sorted((tmp_path / "t.csv").glob("*.csv")) for x in p.read_text().split("\n")[1:] if x]
    assert lines == ["6,12,x", ",,x"]


def test_exact_decimals(spark, inline):
    rel = inline("a\n12345678901234567890.1234567890\n")
    assert C.cell(rel.ordered().first()["a"]) == "12345678901234567890.123456789"


def test_transport_files(spark, inline, tmp_path):
    rel = inline("id,val,msg\n1,20,ABC\n2,,LONGSTRING1234567890\n3,-0.125,\n")
    xpt.write(rel, str(tmp_path / "a.xpt"), "TEST")
    xpt.write(rel, str(tmp_path / "b.xpt"), "TEST")
    assert (tmp_path / "a.xpt").read_bytes() == (tmp_path / "b.xpt").read_bytes()
    got = xpt.read(spark, str(tmp_path / "a.xpt"))
    assert got.columns == ("id", "val", "msg")
    assert [tuple(r) for r in got.ordered().collect()] == [(1.0, 20.0, "ABC"), (2.0, None, "LONGSTRING1234567890"), (3.0, -0.125, None)]
    with pytest.raises(Refusal) as e:
        xpt.write(inline("a\n" + "x" * 201 + "\n"), str(tmp_path / "c.xpt"))
    assert e.value.code == "XPT_LENGTH_EXCEEDED"


def test_amendments(spark):
    plan = pipeline.compile_script(TEXT)
    target = next(s for s in plan.steps if s.op == "filter").outputs[0]
    new = amend.apply(plan, [{"kind": "edit_expr", "step": target, "at": ["predicate"], "find": "10", "replace": "3"}, {"kind": "add_assertion", "predicate": "row_count(u) == 2"}, {"kind": "rename_table", "from": "u", "to": "totals"}], set())
    assert run_plan(spark, new)["totals"].count() == 2
    assert [d["outputs"] for d in amend.diff(plan, new)["changed"]] == [[target]]
    for bad, code in (
        ([{"kind": "nothing"}], "E_AMEND_KIND"),
        ([{"kind": "remove_step", "step": target}], "E_AMEND_POLICY"),
        ([{"kind": "remove_assertion", "index": 0}], "E_AMEND_POLICY"),
        ([{"kind": "rewire_outputs", "step": target, "outputs": ["z"]}], "E_AMEND_POLICY"),
        ([{"kind": "edit_expr", "step": target, "at": ["predicate"], "edit": "evaluate"}], "E_AMEND_EDIT"),
        ([{"kind": "edit_expr", "step": target, "at": ["predicate", 0, "right"], "edit": "replace_literal", "literal": "x"}], "E_AMEND_TYPE"),
        ([{"kind": "edit_expr", "step": target, "at": ["predicate", 0], "edit": "replace_op", "op": "+"}], "E_AMEND_TYPE"),
        ([{"kind": "edit_expr", "step": target, "at": ["predicate", 7], "edit": "wrap_not"}], "E_AMEND_TARGET"),
        ([{"kind": "add_assertion", "predicate": "row_count(t) > 1"}], "E_AMEND_NAME"),
        ([{"kind": "edit_expr", "step": target, "at": ["predicate"], "find": "77", "replace": "3"}], "E_AMEND_TARGET"),
        ([{"kind": "rename_table", "from": "u", "to": "t"}], "E_AMEND_NAME"),
        ([{"kind": "set_params", "step": target, "params": {"zzz": 1}}], "E_AMEND_PARAM"),
        ([{"kind": "add_assertion"}], "E_AMEND_SHAPE"),
        ([{"kind": "remove_assertion", "index": 0}] * 51, "E_AMEND_LIMIT"),
    ):
        with pytest.raises(Refusal) as e:
            amend.apply(plan, bad, set())
        assert e.value.code == code
    assert plan == pipeline.compile_script(TEXT)
    with pytest.raises(Refusal) as e:
        amend.apply(plan, [{"kind": "remove_step", "step": target}], set(), amend.Policy(destructive=True))
    assert e.value.code == "E_UNKNOWN_TABLE"


def test_typed_edits_and_requests(spark):
    plan = pipeline.compile_script(TEXT)
    target = next(s for s in plan.steps if s.op == "filter").outputs[0]
    edits = [
        {"kind": "edit_expr", "step": target, "at": ["predicate", 0, "right"], "edit": "replace_literal", "literal": 3},
        {"kind": "edit_expr", "step": target, "at": ["predicate", 0], "edit": "replace_op", "op": "<="},
        {"kind": "edit_expr", "step": target, "at": ["predicate", 1], "edit": "wrap_not"},
        {"kind": "edit_expr", "step": target, "at": ["predicate", 0, "left"], "edit": "replace_column", "column": "a"},
    ]
    answer = amend.request(plan, {"edits": [*edits, {"kind": "add_assertion", "id": "few", "predicate": "row_count(t) < 9"}]}, set())
    assert answer["status"] == "ok" and answer["assertions"] == {"added": ["few"], "removed": [], "modified": []}
    new = from_json(json.loads(json.dumps(answer["plan"])))
    # a <= 3, which a missing value is, or not a == null
    assert {r["a"] for r in run_plan(spark, new)["t"].collect()} == {6, 3, None}
    more = amend.request(new, {"edits": [{"kind": "replace_assertion", "id": "few", "predicate": "row_count(t) < 5"}]}, set())
    assert [m["id"] for m in more["assertions"]["modified"]] == ["few"]
    gone = amend.request(new, {"policy": {"destructive": True}, "edits": [{"kind": "remove_assertion", "id": "few"}]}, set())
    assert gone["assertions"]["removed"] == ["few"]
    for bad, code in (({"edits": [{"kind": "remove_assertion", "id": "few"}]}, "E_AMEND_POLICY"), ({"policy": {"all": True}, "edits": []}, "E_AMEND_POLICY"), ({}, "E_AMEND_SHAPE")):
        answer = amend.request(new, bad, set())
        assert answer["status"] == "refused" and answer["refusals"][0]["code"] == code


def test_plan_invariants():
    plan = pipeline.compile_script(TEXT)
    assert any("'u'" in w for w in plan.invariants())
    save = 'save t to "t.csv"'
    for text, strict, code in ((TEXT, True, "E_PLAN_STRICT"), (TEXT.replace(save, ""), False, "E_PLAN_NO_SAVE"), (TEXT.replace(save, f"{save}\n{save}"), False, "E_PLAN_SAVED_TWICE")):
        with pytest.raises(Refusal) as e:
            pipeline.compile_script(text).invariants(strict)
        assert e.value.code == code


def test_clinical_profile(spark):
    dm = spark.createDataFrame([("DM", "1", "1", "A", "M", "W"), ("XX", None, "2", "A", "F", "W")], "DOMAIN string, USUBJID string, SUBJID string, SITEID string, SEX string, RACE string")
    ae = spark.createDataFrame([("AE", "1", "HEADACHE", "2020-13"), ("AE", "1", "PAIN", "yesterday")], "DOMAIN string, USUBJID string, AEDECOD string, AESTDTC string")
    got = {tuple(r) for r in sdtm.validate({"dm": dm, "ae": ae}).collect()}
    assert got == {
        ("LB", "TABLE_MISSING", None, None, None),
        ("DM", "DOMAIN_VALUE", "DOMAIN", 2, "XX"),
        ("DM", "USUBJID_MISSING", "USUBJID", 2, None),
        ("AE", "DATE_NOT_ISO", "AESTDTC", 1, "2020-13"),
        ("AE", "DATE_NOT_ISO", "AESTDTC", 2, "yesterday"),
    }


def test_clinical_dates(spark):
    """A domain's date must be a whole ISO day, also the reference start date of DM; rows are named by their number."""
    days = ["2020-01-01", "not a date", None, "2020-01", "2020-01-01T10:00"]
    dm = spark.createDataFrame([("DM", str(i), str(i), "A", "M", "W", d) for i, d in enumerate(days)], "DOMAIN string, USUBJID string, SUBJID string, SITEID string, SEX string, RACE string, RFSTDTC string")
    got = [tuple(r) for r in sdtm.validate({"dm": dm}).where("rule = 'DATE_NOT_ISO'").orderBy("row").collect()]
    assert got == [("DM", "DATE_NOT_ISO", "RFSTDTC", i + 1, days[i]) for i in range(1, 5)]


def test_clinical_rows_of_files(spark, tmp_path):
    df = spark.range(0, 5000, 1, 3).selectExpr("'DM' DOMAIN", "if(id % 1000 = 7, '', cast(id as string)) USUBJID", "id")
    df.coalesce(1).write.parquet(str(tmp_path / "dm"))
    found = sdtm.validate({"dm": spark.read.parquet(str(tmp_path / "dm"))}).where("rule = 'USUBJID_MISSING'")
    assert sorted(r["row"] for r in found.collect()) == [8, 1008, 2008, 3008, 4008]


def test_transport_names(spark, tmp_path):
    """The name field names a variable, whatever its label says; unknown types are refused."""
    import struct

    data = bytearray(b"".join(xpt.encode("T", [("subject", True, 8), ("AGE", True, 8)], iter([(1.0, 2.0)]))))
    at = data.find(b"HEADER RECORD*******NAMESTR") + 80
    data[at + 16 : at + 56] = b"subject identifier for the study".ljust(40)
    with pytest.warns(UserWarning, match="label"):
        assert [n for n, _ in xpt.decode(bytes(data))[0]] == ["subject", "AGE"]
    data[at : at + 2] = struct.pack(">h", 7)
    with pytest.raises(Refusal) as e:
        xpt.decode(bytes(data))
    assert e.value.code == "XPT_UNSUPPORTED"


def test_literals_of_selects_keep_their_text(spark, inline):
    """What stands in quotes is neither flattened nor searched for keywords."""
    from tabflow.relation import Relation

    rows = ["a  b", "a b", "in case", "x from y where group by z", "join on"]
    x = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    for n, s in enumerate(rows):
        got = run(spark, f"proc sql; create table o as select t.i from x as t where\n  t.s = '{s}'; quit;", {"x": Relation.of(x, ("i",))})["o"].collect()
        assert [r["i"] for r in got] == [n]
    text = "/* %if in a comment */\n* %do too;\ndata o; set x; if s = 'in then case' or s = 'a  b' then y = '50% if'; else y = 'it;s'; run;"
    got = run(spark, text, {"x": Relation.of(x, ("i",))})["o"].orderBy("i").collect()
    assert [r["y"] for r in got] == ["50% if", *["it;s"] * 4]


def test_transpose_names():
    assert [column_name(x) for x in ("GLUC", "a b", "1x", "--", "é")] == ["GLUC", "a_b", "COL_1x", "COL", "COL"]


def test_transpose_refusals(spark, inline):
    for text, code in (("k,i,v\n1,a b,1\n1,a-b,2\n", "TRANSPOSE_ID_COLLISION"), ("k,i,v\n1,,1\n", "TRANSPOSE_MISSING_ID")):
        with pytest.raises(Refusal) as e:
            run(spark, "proc transpose data=x out=o; by k; id i; var v; run;", {"x": inline(text)})
        assert e.value.code == code


def test_macros(tmp_path):
    (tmp_path / "inc.sas").write_text("%let n = 5;\n")
    text = "%include 'inc.sas';\ndata o; set x; y = &n; run;"
    assert "y = 5" in sas.expand(text, sas.includer([tmp_path]))
    for name, code in (("/etc/passwd", "INCLUDE_ABSOLUTE"), ("../x", "INCLUDE_ESCAPE"), ("none.sas", "INCLUDE_MISSING")):
        with pytest.raises(Refusal) as e:
            sas.includer([tmp_path])(name)
        assert e.value.code == code


def test_command_line(tmp_path, capsys):
    from tabflow.cli import main

    (tmp_path / "s.flow").write_text(TEXT)
    assert main(["check", str(tmp_path / "s.flow")]) == 0
    assert main(["fmt", str(tmp_path / "s.flow")]) == 0
    assert main(["fmt", "--check", str(tmp_path / "s.flow")]) == 0
    assert main(["plan", str(tmp_path / "s.flow")]) == 0
    assert main(["run", str(tmp_path / "s.flow"), "--out", str(tmp_path / "out")]) == 0
    assert main(["verify", str(tmp_path / "out")]) == 0
    capsys.readouterr()
    main(["plan", str(tmp_path / "s.flow")])
    (tmp_path / "plan.json").write_text(capsys.readouterr().out)
    assert main(["validate-plan", str(tmp_path / "plan.json")]) == 10
    assert main(["validate-plan", "--strict", str(tmp_path / "plan.json")]) == 31
    (tmp_path / "req.json").write_text(json.dumps({"edits": [{"kind": "remove_assertion", "index": 0}]}))
    capsys.readouterr()
    assert main(["amend", str(tmp_path / "plan.json"), str(tmp_path / "req.json")]) == 31
    assert json.loads(capsys.readouterr().out)["refusals"][0]["code"] == "E_AMEND_POLICY"
    (tmp_path / "shared").mkdir()
    (tmp_path / "shared/inc.sas").write_text("%let n = 5;\n")
    (tmp_path / "in.csv").write_text("x,code\n1,007\n9,008\n")
    (tmp_path / "b.sas").write_text("%include 'inc.sas';\ndata o; set t; if x > &n; run;")
    assert main(["run", str(tmp_path / "b.sas"), "--out", str(tmp_path / "no"), "--tables", f"t={tmp_path}/in.csv"]) == 30
    more = ["--include-root", str(tmp_path / "shared"), "--tables", f"t={tmp_path}/in.csv"]
    assert main(["lock", str(tmp_path / "b.sas"), "--out", str(tmp_path / "b.schema.lock.json"), *more]) == 0
    assert main(["run", str(tmp_path / "b.sas"), "--out", str(tmp_path / "yes"), "--format", "xpt", *more]) == 0
    assert [p.name for p in (tmp_path / "yes/outputs").iterdir() if p.suffix != ".crc"] == ["o.xpt"]
    assert main(["run", str(tmp_path / "b.sas"), "--out", str(tmp_path / "many"), "--parts", *more]) == 0
    assert "9,008" in "".join(p.read_text() for p in (tmp_path / "many/outputs/o.csv").glob("*.csv"))
    (tmp_path / "old.sas").write_text("data o; set t; if x gt 5; run;")
    assert main(["check", str(tmp_path / "old.sas")]) == 30 and main(["check", "--legacy", str(tmp_path / "old.sas")]) == 0
    (tmp_path / "dm.csv").write_text("DOMAIN,USUBJID,SUBJID,SITEID,SEX,RACE,RFSTDTC\nDM,1,1,A,M,W,soon\n")
    capsys.readouterr()
    assert main(["validate", "--tables", f"dm={tmp_path}/dm.csv"]) == 31
    assert '"row": 1' in capsys.readouterr().out
    (tmp_path / "bad.sas").write_text("data o; merge a b; run;")
    assert main(["check", str(tmp_path / "bad.sas")]) == 30
    capsys.readouterr()


def test_streams_take_row_wise_steps_only(spark):
    from tabflow import streaming

    stream = spark.readStream.format("rate").load().selectExpr("value as v")
    ok = streaming.apply(sas.compile_script("data o; set x; w = v * 2; if w > 2; run;", True), stream, "x", "o")
    assert ok.isStreaming
    assert ok.columns == ["v", "w"]
    with pytest.raises(Refusal):
        streaming.apply(sas.compile_script("proc sort data=x out=o; by v; run;", True), stream, "x", "o")
    with pytest.raises(Refusal):
        run(spark, "data o; set x; run;", {"x": stream})
