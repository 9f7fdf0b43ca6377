"""Command line: check, run, plan, run-plan, validate-plan, amend, lock, validate, verify, fmt."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tabflow.errors import EXIT, Refusal
from tabflow.plans.ir import from_json, plain, to_json
from tabflow.session import compile_text, run_plan


def _language(path: str) -> str:
    return "batch" if path.endswith(".sas") else "pipeline"


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def paths(tables: str, folder: str | None) -> dict[str, str]:
    """``name=path,...`` and the CSV files of a folder, by their stems."""
    found: dict[str, str] = {}
    if folder:
        files = sorted(p for p in Path(folder).iterdir() if p.suffix == ".csv")
        if any(p.is_symlink() for p in files) or not files:
            raise Refusal("E_INPUTS_DIR", "the folder has symbolic links" if files else "the folder has no CSV files", bucket="validate")
        if len({p.stem.lower() for p in files}) < len(files):
            raise Refusal("E_INPUTS_DIR", "two files of one name", bucket="validate")
        found |= {p.stem: str(p) for p in files}
    for part in filter(None, tables.split(",")):
        name, _, path = part.partition("=")
        found[name.strip()] = path.strip()
    return found


def bindings(spark, tables: str, folder: str | None, locks: dict | None = None) -> dict:
    """The bound tables; CSV files have the types of their lock, or inferred ones."""
    from tabflow.plans.execute import locked
    from tabflow.sources import csv as C
    from tabflow.sources import xpt

    out = {}
    for name, path in paths(tables, folder).items():
        if path.endswith(".xpt"):
            out[name] = xpt.read(spark, path)
        elif path.endswith(".parquet"):
            out[name] = spark.read.parquet(path)
        else:
            rel = C.relation(spark, C.read_text(spark, path))
            out[name] = locked(rel, locks[name]) if locks and name in locks else C.inferred(rel)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabflow")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "plan", "fmt", "run", "lock"):
        p = sub.add_parser(name)
        p.add_argument("script")
        if name in ("run", "lock"):
            p.add_argument("--out", required=True)
        if name != "fmt":
            p.add_argument("--include-root", action="append", default=[])
            p.add_argument("--allow-absolute-include", action="store_true")
            p.add_argument("--allow-include-escape", action="store_true")
            p.add_argument("--legacy", action="store_true", help="the older spellings of operators in batch scripts")
        if name in ("run", "lock"):
            p.add_argument("--tables", default="")
            p.add_argument("--inputs-dir")
        if name == "run":
            p.add_argument("--format", choices=("csv", "xpt"), default="csv")
            p.add_argument("--parts", action="store_true", help="folders of part files that the executors write")
            p.add_argument("--schema-lock")
            p.add_argument("--emit", choices=("auto", "saved", "all"), default="auto")
            p.add_argument("--thin", action="store_true")
        if name == "fmt":
            p.add_argument("--check", action="store_true")
    p = sub.add_parser("run-plan")
    p.add_argument("plan")
    p.add_argument("--out", required=True)
    p.add_argument("--tables", default="")
    p.add_argument("--format", choices=("csv", "xpt"), default="csv")
    p = sub.add_parser("validate-plan")
    p.add_argument("plan")
    p.add_argument("--strict", action="store_true")
    p = sub.add_parser("amend")
    p.add_argument("plan")
    p.add_argument("amendment")
    p = sub.add_parser("validate")
    p.add_argument("--tables", required=True)
    p = sub.add_parser("verify")
    p.add_argument("bundle")
    a = parser.parse_args(argv)
    try:
        return _command(a)
    except Refusal as e:
        print(e, file=sys.stderr)
        return EXIT.get(e.bucket, EXIT["runtime"])


def _includer(a: argparse.Namespace):
    """Includes are looked for beside the script, then below the further roots."""
    from tabflow.frontend.sas import includer

    return includer([Path(a.script).parent, *map(Path, a.include_root)], a.allow_absolute_include, a.allow_include_escape)


def _command(a: argparse.Namespace) -> int:
    from tabflow.governance import amend, bundle, lock, printer, sdtm

    if a.command in ("check", "plan"):
        plan = compile_text(Path(a.script).read_text(), _language(a.script), a.legacy, _includer(a))
        print(json.dumps(plain(to_json(plan)), indent=2, sort_keys=True) if a.command == "plan" else "\n".join(plan.warnings) or "ok")
        return EXIT["warnings"] if plan.warnings else EXIT["ok"]
    if a.command == "fmt":
        text = Path(a.script).read_text()
        made = printer.format_text(text)
        if a.check:
            return EXIT["ok"] if made == text else 1
        Path(a.script).write_text(made)
        return EXIT["ok"]
    if a.command == "verify":
        bad = bundle.verify(a.bundle)
        print("\n".join(bad) or "ok")
        return 1 if bad else EXIT["ok"]
    if a.command == "validate-plan":
        plan = from_json(json.loads(Path(a.plan).read_text()))
        made = {o for s in plan.steps for o in s.outputs}
        plan.check({i for s in plan.steps for i in s.inputs} - made)
        plan.order()
        warnings = plan.invariants(a.strict)
        print("\n".join(warnings) or "ok")
        return EXIT["warnings"] if warnings else EXIT["ok"]
    if a.command == "amend":
        plan = from_json(json.loads(Path(a.plan).read_text()))
        made = {o for s in plan.steps for o in s.outputs}
        answer = amend.request(plan, json.loads(Path(a.amendment).read_text()), {i for s in plan.steps for i in s.inputs} - made)
        print(json.dumps(answer, indent=2, sort_keys=True))
        return EXIT["ok"] if answer["status"] == "ok" else EXIT["validate"]
    spark = _spark()
    if a.command == "run":
        found = a.schema_lock or lock.discover(a.script)
        locks = lock.load(found) if found else None
        tables = bindings(spark, a.tables, a.inputs_dir, locks)
        report = bundle.create(spark, Path(a.script).read_text(), a.out, tables, _language(a.script), str(Path(a.script).parent), a.emit, a.thin, locks, legacy=a.legacy, include=_includer(a), form=a.format, parts=a.parts)
        print(json.dumps({k: report[k] for k in ("status", "exit") if k in report} | {"error": report.get("error")}))
        return report["exit"]
    if a.command == "lock":
        plan = compile_text(Path(a.script).read_text(), _language(a.script), a.legacy, _includer(a))
        lock.write(lock.generate(spark, plan, str(Path(a.script).parent), bound=paths(a.tables, a.inputs_dir)), a.out)
        return EXIT["ok"]
    if a.command == "run-plan":
        run = run_plan(spark, from_json(json.loads(Path(a.plan).read_text())), bindings(spark, a.tables, None))
        run.write(a.out, "auto", a.format)
        return EXIT["ok"]
    none = True
    for i in sdtm.validate(bindings(spark, a.tables, None)).toLocalIterator():
        print(json.dumps(i.asDict()))
        none = False
    return EXIT["ok"] if none else EXIT["validate"]


if __name__ == "__main__":
    sys.exit(main())
