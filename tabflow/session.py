"""Run scripts: compile, translate, and read or write the tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tabflow.errors import EXIT, Refusal, runtime
from tabflow.frontend import pipeline, sas
from tabflow.plans import execute as X
from tabflow.plans.ir import Plan
from tabflow.relation import Relation
from tabflow.sources import csv as csv_io
from tabflow.sources import xpt


@dataclass
class Run:
    """The relations of a run; nothing has been computed yet but guards and transposes' ids."""

    plan: Plan
    context: X.Context
    tables: dict[str, Relation]

    def __getitem__(self, name: str) -> DataFrame:
        return self.relation(name).visible()

    def relation(self, name: str) -> Relation:
        """The last table of this name."""
        later = [o for s in self.plan.steps for o in s.outputs if o.lower() == name.lower() or o.lower().startswith(name.lower() + "__")]
        found = self.tables.get(later[-1] if later else name)
        if found is None:
            raise runtime("E_UNKNOWN_TABLE", f"no table {name!r}")
        return found

    def asserts(self) -> list[dict]:
        return X.evaluate_asserts(self.context)

    def terminal(self) -> list[str]:
        """Tables that no step reads, and named ones in between."""
        made = [o for s in self.plan.steps for o in s.outputs if s.op not in ("datasource",)]
        return [o for o in made if "__" not in o]

    def write(self, out: str, emit: str = "saved", form: str = "csv", parts: bool = False) -> list[dict]:
        """Write saves, or with ``emit="all"`` all named tables, below ``out``.

        With ``parts`` executors write folders of ordered CSV part files, for tables too large for one stream.
        """
        root = Path(out)
        done = []
        wanted = [(s["inputs"][0], s["path"], s["name"]) for s in self.context.saves]
        if emit == "all" or (emit == "auto" and not wanted):
            wanted += [(t, f"{t}.{form}", t) for t in self.terminal() if t not in {w[0] for w in wanted}]
        for table, path, name in wanted:
            target = root / path
            if root.resolve() not in [target.resolve(), *target.resolve().parents]:
                raise runtime("E_SAVE_PATH", f"{path!r} isn't below the output folder")
            target.parent.mkdir(parents=True, exist_ok=True)
            rel = self.tables[table]
            if parts:
                csv_io.write_large(rel, f"file://{target.resolve()}")
                done.append({"path": str(target), "columns": list(rel.columns), "name": name, "table": table})
                continue
            done.append((xpt.write(rel, str(target), name) if path.endswith(".xpt") else csv_io.write(rel, str(target))) | {"name": name, "table": table})
        return done


def compile_text(text: str, language: str, legacy: bool = True, include: Callable[[str], str] | None = None) -> Plan:
    return pipeline.compile_script(text) if language == "pipeline" else sas.compile_script(text, legacy, include)


def run(spark: SparkSession, text: str, tables: Mapping[str, DataFrame | Relation] | None = None, language: str = "batch", legacy: bool = True, base: str = "", wanted: set[str] | None = None, locks: Mapping | None = None, strict: bool | None = None, include: Callable[[str], str] | None = None) -> Run:
    """Run a script over bound tables.  ``language``: ``batch`` (DATA and PROC steps) or ``pipeline``; ``include`` reads included files."""
    plan = compile_text(text, language, legacy, include)
    return run_plan(spark, plan, tables, base, wanted, locks, language == "pipeline" if strict is None else strict)


def run_plan(spark: SparkSession, plan: Plan, tables: Mapping[str, DataFrame | Relation] | None = None, base: str = "", wanted: set[str] | None = None, locks: Mapping | None = None, strict: bool = False) -> Run:
    bound = {}
    for n, t in (tables or {}).items():
        if isinstance(t, DataFrame):
            X.refuse_streaming(t)
            t = Relation.of(t)
        bound[n] = t
    ctx = X.Context(spark, strict, base, locks or {})
    plan.check({*bound, *{b.lower() for b in bound}, *{i for s in plan.steps for i in s.inputs if i.lower() in {b.lower() for b in bound}}})
    return Run(plan, ctx, X.execute(plan, ctx, bound, wanted))


def status(error: Refusal | None, warnings: bool = False) -> int:
    return EXIT[error.bucket if error.bucket in EXIT else "runtime"] if error else EXIT["warnings" if warnings else "ok"]
