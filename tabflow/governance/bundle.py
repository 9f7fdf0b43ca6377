"""Run bundles: inputs, artifacts and outputs with their hashes, and their verification."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from tabflow.errors import EXIT, Refusal
from tabflow.governance import evidence, lineage, lock
from tabflow.plans.ir import plain, step_id, to_json, transform_class_id, transform_id
from tabflow.session import Run, compile_text, run_plan

REPORT = "report.json"
#: Fields of a report that differ between equal runs, and its own hash.
VOLATILE = ("timing", "report_sha256")


def file_hash(path: Path) -> str:
    """Text files are hashed with line ends as LF, others as they are."""
    data = path.read_bytes()
    if path.suffix in (".csv", ".json", ".txt", ".sas", ".flow"):
        data = data.replace(b"\r\n", b"\n")
    return hashlib.sha256(data).hexdigest()


def report_hash(report: Mapping) -> str:
    kept = {k: v for k, v in report.items() if k not in VOLATILE}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _put(path: Path, content: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(content), indent=2, sort_keys=True) + "\n")


def create(spark: SparkSession, text: str, out: str, tables: Mapping | None = None, language: str = "batch", base: str = "", emit: str = "auto", thin: bool = False, locks: Mapping | None = None, profile: bool = True, legacy: bool = True, include: Callable[[str], str] | None = None, form: str = "csv", parts: bool = False) -> dict:
    """Run a script into a bundle: ``inputs/``, ``artifacts/``, ``outputs/`` and the report.  A refusal is reported, not raised."""
    root = Path(out)
    for d in ("inputs", "artifacts", "outputs"):
        (root / d).mkdir(parents=True, exist_ok=True)
    suffix = "flow" if language == "pipeline" else "sas"
    (root / "inputs" / f"source.{suffix}").write_text(text)
    began = time.time()
    report: dict = {"version": 1, "status": "ok", "exit": EXIT["ok"], "language": language}
    try:
        plan = compile_text(text, language, legacy, include)
        _put(root / "artifacts/plan.json", to_json(plan))
        _put(root / "artifacts/graph.json", lineage.step_graph(plan))
        _put(root / "artifacts/effects.json", lineage.table_effects(plan))
        compiled = time.time()
        run: Run = run_plan(spark, plan, tables, base, locks=locks, strict=language == "pipeline")
        schemas = lock.schemas(run.tables)
        _put(root / "artifacts/schemas.json", schemas)
        _put(root / "artifacts/lineage.json", lineage.column_lineage(plan, {n: list(s) for n, s in schemas.items()}))
        if not thin:
            for s in plan.steps:
                if s.op == "datasource" and s.params.get("path") and s.params["kind"] == "csv":
                    path = Path(base) / s.params["path"]
                    if path.is_file():
                        (root / "inputs/data").mkdir(exist_ok=True)
                        shutil.copyfile(path, root / "inputs/data" / path.name)
        report["outputs"] = [{"name": o["name"], "path": str(Path(o["path"]).relative_to(root)), "columns": o["columns"]} for o in run.write(str(root / "outputs"), emit, form, parts)]
        _put(root / "artifacts/registry.json", {transform_id(s): {"op": s.op, "class": transform_class_id(s), "params": s.params} for s in plan.steps})
        if profile:
            found = {t: [r.asDict() for r in evidence.profile(run.tables[t]).orderBy("column").collect()] for t in run.terminal() if t in run.tables}
            _put(root / "artifacts/profile.json", found)
            counts = {t: rows[0]["null_count"] + rows[0]["non_null_count"] for t, rows in found.items() if rows}
            casts = {s.outputs[0]: evidence.coercion_counts(run.tables[s.inputs[0]], s.params["casts"]) for s in plan.steps if s.op == "cast"}
            steps = [{"id": step_id(s), "op": s.op, "outputs": s.outputs, "rows": {o: counts[o] for o in s.outputs if o in counts}, "cast_failures": casts.get(s.outputs[0]) if s.outputs else None} for s in plan.steps]
            _put(root / "artifacts/steps.json", steps)
        report["asserts"] = run.asserts()
        report["warnings"] = plan.warnings
        if plan.warnings:
            report |= {"status": "warnings", "exit": EXIT["warnings"]}
        report["timing"] = {"compile_s": round(compiled - began, 3), "run_s": round(time.time() - compiled, 3)}
    except Refusal as e:
        report |= {"status": "refused", "exit": EXIT.get(e.bucket, EXIT["runtime"]), "error": {"code": e.code, "message": e.message, "line": e.line}}
    except Exception as e:  # what only the rows show: casts, merges, selects
        message = str(e)
        code = next((c for c in ("CAST_FAILED", "MERGE_MANY_MANY", "SELECT_MISMATCH", "DIVIDE_BY_ZERO") if c in message), "RUNTIME_ERROR")
        report |= {"status": "failed", "exit": EXIT["runtime"], "error": {"code": code, "message": message.split("\n")[0][:500], "line": None}}
    report["files"] = {str(p.relative_to(root)): file_hash(p) for p in sorted(root.rglob("*")) if p.is_file() and p.name != REPORT}
    report["report_sha256"] = report_hash(report)
    _put(root / REPORT, report)
    return report


def verify(out: str) -> list[str]:
    """What differs between a bundle and its report; nothing if it is intact."""
    root = Path(out)
    path = root / REPORT
    if not path.is_file():
        return ["no report"]
    report = json.loads(path.read_text())
    bad = [] if report_hash(report) == report.get("report_sha256") else ["the report's own hash"]
    for name, digest in report["files"].items():
        if not (root / name).is_file():
            bad.append(f"missing: {name}")
        elif file_hash(root / name) != digest:
            bad.append(f"changed: {name}")
    extra = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()} - set(report["files"]) - {REPORT}
    return bad + [f"not in the report: {x}" for x in sorted(extra)]
