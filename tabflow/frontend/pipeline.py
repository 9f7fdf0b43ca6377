"""The pipeline language: declarations, table expressions, pipeline blocks, save and assert, compiled to plan steps.

A script says ``# <name> 0.1`` in one of its first five non-empty lines.  Keywords and the
names of tables and datasources are the same in any case; columns' names are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from tabflow.errors import Refusal, invalid
from tabflow.functions import expr as E
from tabflow.functions.types import NAMES
from tabflow.operators.aggregate import STATS
from tabflow.operators.project import TARGETS
from tabflow.plans.ir import OpStep, Plan

_NAME = r"[A-Za-z_]\w*"
_HEADER = re.compile(r"#\s*\w+\s+0\.1\s*$")
KEYWORDS = ("datasource", "let", "const", "format", "table", "save", "to", "as", "assert", "from", "do", "end", "sort", "aggregate", "summary", "by", "nodupkey", "class", "var", "stats", "csv", "xpt", "parquet", "inline_csv", "columns", "select", "drop", "filter", "derive", "rename", "cast", "true", "false", "null", "and", "or", "not")
_POSTFIX = re.compile(r"[ \t]*(select|drop|filter|derive|update!|rename|cast)\b[ \t]*|[ \t]*(\[)")


class _Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    @property
    def line(self) -> int:
        return self.text.count("\n", 0, self.at) + 1

    def fail(self, code: str, message: str) -> Refusal:
        return Refusal(code, message, self.line)

    def skip(self) -> None:
        """White space and comments."""
        m = re.compile(r"(?:\s|#[^\n]*)*").match(self.text, self.at)
        self.at = m.end()

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.text)

    def take(self, pattern: str, skip: bool = True) -> re.Match | None:
        """What matches here; keywords match in any case."""
        if skip:
            self.skip()
        m = re.compile(pattern, re.I).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def need(self, pattern: str, what: str) -> re.Match:
        m = self.take(pattern)
        if not m:
            raise self.fail("E_PARSE", f"expected {what}, not {self.text[self.at : self.at + 20]!r}")
        return m

    def name(self) -> str:
        return self.need(_NAME, "a name")[0]

    def balanced(self) -> str:
        """What stands between the parentheses that begin here."""
        self.need(r"\(", "'('")
        begin, depth, quote = self.at, 1, ""
        for i in range(self.at, len(self.text)):
            c = self.text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "#":
                pass
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return self.text[begin:i]
        raise self.fail("E_UNBALANCED", "parentheses don't match")

    def rest_of_line(self, stop: str | None = None) -> str:
        m = re.compile(r"(?:[^\n#\"']|\"[^\"\n]*\"|'[^'\n]*')*").match(self.text, self.at)
        text = m[0]
        if stop and (s := re.search(stop, text, re.I)):
            text = text[: s.start()]
        self.at += len(text)
        return text


def split(text: str, by: str = ",") -> list[str]:
    """Parts between commas outside quotes and brackets."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == by and not depth:
            out.append(part)
            part = ""
            continue
        part += c
    out.append(part)
    out = [p.strip() for p in out]
    return out[:-1] if out and not out[-1] else out


class Parser:
    def __init__(self, text: str):
        self.s = _Scanner(text)
        self.steps: list[OpStep] = []
        self.sources: dict[str, dict] = {}
        self.tables: set[str] = set()
        self.scalars: dict[str, E.Expr] = {}
        self.maps: set[str] = set()
        self.number = 0
        head = [x for x in text.split("\n") if x.strip()][:5]
        if not any(_HEADER.match(x.strip()) for x in head):
            raise Refusal("E_HEADER", "the version comment isn't in the first five lines", 1)

    # names

    def declare(self, name: str, kind: str) -> None:
        held = [k for k, names in (("table", self.tables), ("scalar", self.scalars), ("datasource", self.sources), ("format", self.maps)) if name in names]
        if held:
            raise self.s.fail("E_REDECLARED", f"{name!r} is already a {held[0]}" if held[0] != kind else f"{name!r} is declared twice")

    def temp(self) -> str:
        self.number += 1
        return f"__t{self.number}__"

    def expression(self, text: str, line: int | None = None) -> E.Expr:
        return E.substitute(E.parse(text, False, line or self.s.line), self.scalars)

    def add(self, op: str, inputs: list[str], output: str | None, params: dict, line: int | None = None) -> None:
        self.steps.append(OpStep(op, inputs, [output] if output else [], params, line or self.s.line))

    # statements

    def parse(self) -> Plan:
        s = self.s
        while not s.done():
            line = s.line
            word = s.need(r"[A-Za-z_]\w*", "a statement")[0].lower()
            if word == "datasource":
                self.datasource(line)
            elif word == "let":
                name = s.name()
                s.need("=(?!=)", "'='")
                self.declare(name, "scalar")
                s.skip()
                self.scalars[name] = self.expression(s.rest_of_line(), line)
                self.add("let_scalar", [], None, {"name": name, "expr": self.scalars[name]}, line)
            elif word == "const":
                self.const(line)
            elif word == "format":
                self.format(line)
            elif word == "table":
                name = s.name().lower()
                s.need("=(?!=)", "'='")
                self.declare(name, "table")
                self.expr(name)
                self.tables.add(name)
            elif word == "save":
                table = s.name().lower()
                path = s.need(r"to\s*\"([^\"\n]*)\"", 'to "path"')[1]
                alias = s.take(r"[ \t]*as\s*\"([^\"\n]*)\"", skip=False)
                if table not in self.tables:
                    raise s.fail("E_UNKNOWN_TABLE", f"no table {table!r}")
                if path.startswith("/") or ".." in path.split("/") or not path:
                    raise Refusal("E_SAVE_PATH", f"{path!r} isn't below the output folder", line)
                self.add("save", [table], None, {"path": path, "name": alias[1] if alias else table}, line)
            elif word == "assert":
                s.skip()
                e = self.expression(s.rest_of_line(), line)
                used = [a.args[0].name.lower() for a in E.walk(e) if isinstance(a, E.Call) and a.name == "row_count" and isinstance(a.args[0], E.Ref)]
                missing = [t for t in used if t not in self.tables]
                if missing:
                    raise Refusal("E_UNKNOWN_TABLE", f"no table {missing[0]!r}", line)
                self.add("assert", used, None, {"predicate": e}, line)
            elif word in ("from", "sort", "aggregate", "summary"):  # a table that nothing names
                s.at -= len(word)
                self.expr(self.temp())
            else:
                raise Refusal("E_UNKNOWN_STATEMENT", f"no statement {word!r}", line)
        return Plan(self.steps, self.sources)

    def columns(self, text: str) -> list[tuple[str, str | None]]:
        out = []
        for part in split(text):
            m = re.fullmatch(rf"({_NAME})(?:\s*:\s*({_NAME}))?", part)
            if not m or (m[2] and m[2] not in NAMES):
                raise self.s.fail("E_DATASOURCE_COLUMNS", f"not a column: {part!r}")
            out.append((m[1], NAMES[m[2]] if m[2] else None))
        if len({n for n, _ in out}) < len(out):
            raise self.s.fail("E_DUPLICATE_COLUMN", "a column is pinned twice")
        return out

    def datasource(self, line: int) -> None:
        s = self.s
        name = s.name().lower()
        s.need("=(?!=)", "'='")
        self.declare(name, "datasource")
        kind = s.need(r"csv|xpt|parquet|inline_csv", "csv, xpt, parquet or inline_csv")[0].lower()
        spec: dict = {"kind": kind}
        if kind == "inline_csv" and not s.take(r"(?=\()"):
            pinned = s.take(r"columns(?=\()")
            if pinned:
                spec["columns"] = self.columns(s.balanced())
            if not s.take(r"do[ \t]*\n"):
                raise s.fail("E_PARSE", "inline_csv needs a text or a do block")
            lines = []
            while True:
                if s.at >= len(s.text):
                    raise s.fail("E_MISSING_END", "a block isn't closed by end")
                stop = s.text.find("\n", s.at)
                stop = len(s.text) if stop < 0 else stop
                row, s.at = s.text[s.at : stop], min(len(s.text), stop + 1)
                if row.strip() == "end":
                    break
                lines.append(row.strip())
            spec["text"] = "\n".join(lines).strip("\n") + "\n"
        elif kind == "inline_csv":
            triple = s.text[s.at :].lstrip("( \n\t").startswith('"""')
            m = s.need(r'(?s:\(\s*"""(.*?)""")', "a text in triple quotes") if triple else s.need(r'\(\s*"([^"\n]*)"', "a text")
            spec["text"] = "\n".join(x.strip() for x in m[1].replace("\\n", "\n").strip().split("\n")) + "\n"
            self._rest(spec)
        else:
            spec["path"] = s.need(r'\(\s*"([^"\n]*)"', "a path")[1]
            self._rest(spec)
        self.sources[name] = spec
        self.add("datasource", [], f"__datasource__{name}", {"name": name, **spec}, line)

    def _rest(self, spec: dict) -> None:
        s = self.s
        while s.take(","):
            s.need(r"columns(?=\s*\()", "columns(...)")
            spec["columns"] = self.columns(s.balanced())
        s.need(r"\)", "')'")

    def literal(self, text: str) -> E.Expr:
        try:
            e = E.parse(text)
        except Refusal:
            e = None
        if not isinstance(e, E.Lit) or (isinstance(e.value, Decimal) and "e" in text.lower()):
            raise self.s.fail("E_CONST_LITERAL", f"not a literal: {text!r}")
        return e

    def const(self, line: int) -> None:
        m = self.s.need(r"\{([^{}]*)\}", "{ name = literal, ... }")
        made = {}
        for part in split(re.sub(r"#[^\n]*", "", m[1])):
            p = re.fullmatch(rf"({_NAME})\s*=(?!=)\s*(.+)", part, re.S)
            if not p:
                raise self.s.fail("E_CONST", f"not a constant: {part!r}")
            self.declare(p[1], "scalar")
            made[p[1]] = self.scalars[p[1]] = self.literal(p[2].strip())
        self.add("const", [], None, {"bindings": made}, line)

    def format(self, line: int) -> None:
        s = self.s
        name = s.need(rf"\$?{_NAME}", "a format's name")[0]
        self.declare(name, "format")
        m = s.need(r"\{([^{}]*)\}", '{ "a" -> "x", other -> "y" }')
        found, other = {}, None
        for part in split(m[1]):
            p = re.fullmatch(r'(?:(other)|"([^"]*)")\s*->\s*"([^"]*)"', part)
            if not p:
                raise s.fail("E_FORMAT", f"not a mapping: {part!r}")
            if p[1]:
                other = p[3]
            else:
                found[p[2]] = p[3]
        self.maps.add(name)
        self.add("format", [], None, {"name": name, "map": found, "other": other}, line)

    # tables

    def expr(self, output: str) -> None:
        """A table expression whose result is the table ``output``."""
        begin = len(self.steps)
        at = self.base()
        while True:
            if self.s.take(r"[ \t]*do\b", skip=False):
                at = self.pipeline(at)
                continue
            m = self.s.take(_POSTFIX.pattern, skip=False)
            if not m:
                break
            if m[2]:
                stop = self.s.need(r"([^\]]*)\]", "']'")
                at = self.transform("select", at, self.s.line, stop[1])
            else:
                at = self.transform(m[1].lower(), at, self.s.line)
        last = next((s for s in reversed(self.steps[begin:]) if s.outputs == [at]), None)
        if last is not None:
            last.outputs = [output]
        else:
            self.add("identity", [at], output, {})

    def inner(self, text: str) -> str:
        """A table expression within parentheses: the table that it makes."""
        if re.fullmatch(_NAME, text.strip()):
            name = text.strip().lower()
            if name in self.tables:
                return name
            if name in self.sources:
                return self.source(name)
            raise self.s.fail("E_UNKNOWN_TABLE", f"no table {name!r}")
        held, self.s = self.s, _Scanner(text)
        name = self.temp()
        self.expr(name)
        if not self.s.done():
            raise held.fail("E_PARSE", f"unexpected {self.s.text[self.s.at :][:20]!r}")
        self.s = held
        return name

    def source(self, name: str) -> str:
        made = self.temp()
        self.add("identity", [f"__datasource__{name}"], made, {"source": name})
        return made

    def base(self) -> str:
        s = self.s
        name = s.name()
        word = name.lower() if name.lower() in ("from", "sort", "aggregate", "summary") and s.text[s.at :].lstrip().startswith("(") else name
        if word == "from":
            name = s.balanced().strip().lower()
            if name in self.sources:
                return self.source(name)
            if name in self.tables:
                return name
            raise s.fail("E_UNDECLARED_SOURCE", f"no datasource or table {name!r}")
        if word == "sort":
            at = self.inner(s.balanced())
            calls = self.calls({"by", "nodupkey"})
            by = self.listed(calls, "by")
            made = self.temp()
            flag = calls.get("nodupkey", "false").strip().lower()
            if flag not in ("true", "false"):
                raise s.fail("E_PARSE", "nodupkey(true) or nodupkey(false)")
            self.add("sort", [at], made, {"by": by, "nodupkey": flag == "true"})
            return made
        if word in ("aggregate", "summary"):
            at = self.inner(s.balanced())
            calls = self.calls({"class", "var", "stats"})
            stats = self.listed(calls, "stats") if "stats" in calls else ["mean"]
            bad = [x for x in stats if x not in STATS]
            if bad:
                raise s.fail("E_BAD_STAT", f"no statistic {bad[0]!r}")
            made = self.temp()
            self.add(word, [at], made, {"class": self.listed(calls, "class") if "class" in calls else [], "vars": self.listed(calls, "var"), "stats": stats})
            return made
        if word.lower() in self.tables:
            return word.lower()
        raise s.fail("E_UNKNOWN_TABLE", f"no table {word!r}")

    def calls(self, allowed: set[str]) -> dict[str, str]:
        out: dict[str, str] = {}
        while m := self.s.take(rf"\.\s*({_NAME})(?=\s*\()"):
            key = m[1].lower()
            if key not in allowed or key in out:
                raise self.s.fail("E_BUILDER", f"no .{m[1]} here")
            out[key] = self.s.balanced()
        return out

    def listed(self, calls: dict[str, str], key: str) -> list[str]:
        if key not in calls:
            raise self.s.fail("E_BUILDER", f".{key}(...) is missing")
        return self.names(calls[key])

    def names(self, text: str) -> list[str]:
        out = split(text)
        if not out or any(not re.fullmatch(_NAME, n) for n in out):
            raise self.s.fail("E_BAD_NAMES", f"expected names, not {text.strip()!r}")
        return out

    def pipeline(self, at: str) -> str:
        s = self.s
        while True:
            if s.done():
                raise s.fail("E_MISSING_END", "a pipeline isn't closed by end")
            if s.take(r"end\b"):
                return at
            line = s.line
            m = s.need(r"(rename|derive|update!|filter|select|drop|cast)(?![\w])", "a transform")
            at = self.transform(m[1].lower(), at, line)

    def transform(self, word: str, at: str, line: int, given: str | None = None) -> str:
        s = self.s
        paren = given is None and s.take(r"[ \t]*(?=\()", skip=False) is not None
        if word in ("select", "drop"):
            text = given if given is not None else s.balanced() if paren else s.need(rf"{_NAME}(?:\s*,\s*{_NAME})*", "names")[0]
            params = {"cols": self.names(text)}
            op = word
        elif word == "filter":
            text = s.balanced() if paren and self._whole() else s.rest_of_line(r"[ \t](?:select|drop|do)\b")
            op, params = "filter", {"predicate": self.expression(text, line)}
        elif word == "rename":
            found = []
            for part in split(s.balanced()):
                p = re.fullmatch(rf"({_NAME})\s*->\s*({_NAME})", part)
                if not p:
                    raise Refusal("E_BAD_RENAME", f"expected old -> new, not {part!r}", line)
                found.append((p[1], p[2]))
            op, params = "rename", {"pairs": sorted(found)}
        elif word in ("derive", "update!"):
            items = []
            for part in split(s.balanced()):
                p = re.fullmatch(rf"({_NAME})\s*=(?!=)\s*(.+)", part, re.S)
                if not p:
                    raise Refusal("E_BAD_ASSIGNMENT", f"expected name = expression, not {part!r}", line)
                items.append((p[1], self.expression(p[2], line)))
            op, params = "compute", {"mode": word.rstrip("!"), "items": items}
        else:
            casts = []
            for part in split(s.balanced()):
                p = re.fullmatch(rf"({_NAME})\s*->\s*({_NAME})((?:\s+\w+\s*=\s*\w+)*)", part)
                if not p or p[2] not in TARGETS:
                    raise Refusal("E_BAD_CAST", f"expected column -> type, not {part!r}", line)
                extra = dict(re.findall(r"(\w+)\s*=\s*(\w+)", p[3]))
                if set(extra) - {"on_error", "trim"} or extra.get("on_error", "fail") not in ("fail", "null") or extra.get("trim", "false") not in ("true", "false"):
                    raise Refusal("E_BAD_CAST", f"unknown option in {part!r}", line)
                casts.append({"col": p[1], "to": p[2], "on_error": extra.get("on_error", "fail"), "trim": extra.get("trim", "false") == "true"})
            op, params = "cast", {"casts": casts}
        made = self.temp()
        self.add(op, [at], made, params, line)
        return made

    def _whole(self) -> bool:
        """Whether the parenthesis here closes at the end of the statement, so that it isn't the beginning of a longer expression."""
        keep = self.s.at
        self.s.balanced()
        rest = self.s.rest_of_line().strip()
        self.s.at = keep
        return not rest or re.match(r"(select|drop|do|end|\)|\])", rest) is not None


def compile_script(text: str, include: Callable[[str], str] | None = None) -> Plan:
    plan = Parser(text).parse()
    used = {r for s in plan.steps for r in _used(s)}
    plan.warnings += [f"let {s.params['name']} isn't used" for s in plan.steps if s.op == "let_scalar" and s.params["name"] not in used and not re.search(rf"\b{s.params['name']}\b", text.split(f"let {s.params['name']}", 1)[-1].split("\n", 1)[-1])]
    if not plan.steps:
        raise invalid("E_EMPTY", "the script has no statements")
    return plan


def _used(s: OpStep) -> list[str]:
    found = [s.params.get("predicate")] + [e for _, e in s.params.get("items", [])]
    return [r for e in found if e is not None for r in E.references(e)]
