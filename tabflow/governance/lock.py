"""Schema locks: the columns and types of each datasource, fixed in a file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from tabflow.errors import invalid
from tabflow.plans import execute as X
from tabflow.plans.ir import Plan
from tabflow.sources import csv as csv_io

VERSION = 1
#: Rows that inference looks at when a lock is made.
SCAN_ROWS = 10_000


def generate(spark: SparkSession, plan: Plan, base: str = "", rows: int = SCAN_ROWS, bound: Mapping[str, str] | None = None) -> dict:
    """A lock of all datasources, and of the CSV files that are bound to tables: pinned types as they are, others inferred."""
    out = []
    for name, path in sorted((bound or {}).items()):
        if not path.endswith((".parquet", ".xpt")):
            kinds = csv_io.infer(csv_io.relation(spark, csv_io.read_text(spark, path)), rows)
            rules = {"extra_columns": "ignore", "missing_columns": "error"}
            out.append({"name": name, "kind": "csv", "path": path, "rules": rules, "columns": [{"name": n, "type": k} for n, k in kinds.items()], "types": f"inferred from {rows} rows"})
    for name, spec in sorted(plan.sources.items()):
        pinned = [tuple(c) for c in spec.get("columns") or []]
        entry = {"name": name, "kind": spec["kind"], "path": spec.get("path"), "rules": {"extra_columns": "ignore", "missing_columns": "error"}}
        if pinned and all(k for _, k in pinned):
            columns, how = pinned, "pinned"
        else:
            if spec["kind"] == "inline_csv":
                rel = csv_io.relation(spark, csv_io.inline(spark, spec["text"]))
            else:
                path = spec["path"] if spec["path"].startswith("/") or not base else f"{base}/{spec['path']}"
                rel = csv_io.relation(spark, csv_io.read_text(spark, path))
            kinds = csv_io.infer(rel, rows) | {n: k for n, k in pinned if k}
            columns, how = [(c, kinds[c]) for c in rel.columns], f"inferred from {rows} rows"
        out.append(entry | {"columns": [{"name": n, "type": k} for n, k in columns], "types": how})
    return {"version": VERSION, "datasources": out}


def write(lock: dict, path: str) -> None:
    Path(path).write_text(json.dumps(lock, indent=2, sort_keys=True) + "\n")


def load(path: str) -> dict[str, list[tuple[str, str]]]:
    """Columns by datasource."""
    try:
        lock = json.loads(Path(path).read_text())
        if lock["version"] != VERSION:
            raise invalid("E_SCHEMA_LOCK_INVALID", f"lock version {lock['version']!r}")
        return {d["name"]: [(c["name"], c["type"]) for c in d["columns"]] for d in lock["datasources"]}
    except (KeyError, TypeError, ValueError) as e:
        raise invalid("E_SCHEMA_LOCK_INVALID", f"not a schema lock: {e}") from e


def discover(script: str) -> str | None:
    """The lock beside a script: of its name, or the folder's."""
    p = Path(script)
    return next((str(x) for x in (p.with_suffix(".schema.lock.json"), p.parent / "schema.lock.json") if x.is_file()), None)


def require(plan: Plan, locks: Mapping) -> None:
    """A strict run needs concrete types for every datasource that it reads."""
    for s in plan.steps:
        if s.op == "datasource" and s.params["kind"] in ("csv", "inline_csv") and s.params["name"] not in locks:
            columns = s.params.get("columns")
            if not columns or not all(k for _, k in columns):
                raise invalid("E_SCHEMA_REQUIRED", f"datasource {s.params['name']!r} has no types", s.line)


def schemas(run_tables: Mapping) -> dict[str, dict[str, str]]:
    return {n: X.schema(r) for n, r in run_tables.items()}
