"""The batch language: statements, macros, DATA steps and procedures, compiled to plan steps."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from tabflow.errors import Refusal
from tabflow.functions import expr as E
from tabflow.operators import datastep as D
from tabflow.operators.sql import Item, Query, Source
from tabflow.plans.ir import OpStep, Plan


@dataclass
class Statement:
    text: str
    line: int


def masked(text: str, comments: bool = False) -> str:
    """The text with what stands in quotes (and in comments) blanked, place by place, so that no keyword is found there."""
    out, i, quote, fresh = list(text), 0, "", True
    while i < len(text):
        c = text[i]
        if quote:
            if c == quote:
                quote = ""
            elif c != "\n":
                out[i] = "\0"
        elif c in "'\"":
            quote, fresh = c, False
        elif comments and (text.startswith("/*", i) or (c == "*" and fresh)):
            mark = "*/" if c == "/" else ";"
            end = text.find(mark, i + 1 + (c == "/"))
            end = len(text) if end < 0 else end + len(mark)
            out[i:end] = [x if x == "\n" else " " for x in text[i:end]]
            i = end
            continue
        elif c == ";":
            fresh = True
        elif not c.isspace():
            fresh = False
        i += 1
    return "".join(out)


def flattened(text: str) -> str:
    """White space outside quotes as single spaces."""
    return re.sub(r"('[^']*'|\"[^\"]*\")|\s+", lambda m: m[1] or " ", text).strip()


def split_at(pattern: str, text: str, most: int = 0) -> list[str]:
    """Parts of the text between matches outside quotes; groups of the pattern stand between them, as in ``re.split``."""
    out, at = [], 0
    for n, m in enumerate(re.finditer(pattern, masked(text), re.I)):
        if most and n == most:
            break
        out += [text[at : m.start()], *[text[slice(*m.span(g))] for g in range(1, (m.re.groups or 0) + 1)]]
        at = m.end()
    return [*out, text[at:]]


def matched(pattern: str, text: str) -> list[str] | None:
    """The groups of a full match whose keywords stand outside quotes; None if there is none."""
    m = re.fullmatch(pattern, masked(text), re.I | re.S)
    return m and [text[slice(*m.span(g))] for g in range(1, m.re.groups + 1)]


def statements(text: str) -> list[Statement]:
    """Split at semicolons outside quotes and comments (``/* */`` and ``* ... ;``)."""
    out, buffer, line, begin, quote, i = [], [], 1, None, "", 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            line += 1
        if quote:
            buffer.append(c)
            quote = "" if c == quote else quote
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise Refusal("E_UNCLOSED_COMMENT", "a comment isn't closed", line)
            line += text.count("\n", i + 1, end)
            buffer.append(" ")
            i = end + 1
        elif c == "*" and not "".join(buffer).strip():
            end = text.find(";", i)
            end = len(text) if end < 0 else end
            line += text.count("\n", i + 1, end)
            buffer, i = [], end
        elif c == ";":
            if "".join(buffer).strip():
                out.append(Statement(" ".join("".join(buffer).split()) if not re.search(r"['\"]", "".join(buffer)) else "".join(buffer).strip(), begin or line))
            buffer, begin = [], None
        else:
            if c in "'\"":
                quote = c
            if begin is None and not c.isspace():
                begin = line
            buffer.append(c)
        i += 1
    if quote:
        raise Refusal("E_UNCLOSED_STRING", "a string isn't closed", begin)
    if "".join(buffer).strip():
        raise Refusal("E_MISSING_SEMICOLON", "the last statement has no semicolon", begin)
    return out


# --- macros --------------------------------------------------------------------------------


def expand(text: str, include: Callable[[str], str] | None = None, values: dict[str, str] | None = None, stack: tuple[str, ...] = ()) -> str:
    """``%let``, ``%include`` and ``&name`` before parsing; control flow in macros is refused."""
    values = values if values is not None else {}
    out = []
    for number, (line, bare) in enumerate(zip(text.split("\n"), masked(text, comments=True).split("\n"), strict=True), 1):
        if m := re.search(r"%(if|do|end|macro|mend|sysfunc|else|then)\b", bare, re.I):
            raise Refusal("MACRO_UNSUPPORTED", f"%{m[1].lower()} isn't supported", number)
        if not re.match(r"\s*%(let|include)\b", bare, re.I):
            out.append(re.sub(r"&([A-Za-z_]\w*)\.?", lambda m: values.get(m[1].lower(), m[0]), line))
            continue
        line = re.sub(r"&([A-Za-z_]\w*)\.?", lambda m: values.get(m[1].lower(), m[0]), line)
        if m := re.match(r"\s*%let\s+([A-Za-z_]\w*)\s*=\s*(.*?)\s*;\s*$", line, re.I):
            values[m[1].lower()] = m[2]
            out.append("")
        elif m := re.match(r"\s*%include\s+['\"]([^'\"]+)['\"]\s*;\s*$", line, re.I):
            if m[1] in stack:
                raise Refusal("INCLUDE_CYCLE", f"{m[1]} includes itself", number)
            if include is None:
                raise Refusal("INCLUDE_UNSUPPORTED", "this script has no place for includes", number)
            out.append(expand(include(m[1]), include, values, (*stack, m[1])))
        else:
            out.append(line)
    return "\n".join(out)


def includer(roots: list[Path], allow_absolute: bool = False, allow_escape: bool = False) -> Callable[[str], str]:
    """Reads includes below the roots; absolute paths and paths that leave the roots are refused unless allowed."""

    def read(name: str) -> str:
        if Path(name).is_absolute() and not allow_absolute:
            raise Refusal("INCLUDE_ABSOLUTE", f"absolute include {name!r}")
        for root in roots:
            path = (root / name).resolve()
            if not allow_escape and not Path(name).is_absolute() and root.resolve() not in path.parents:
                raise Refusal("INCLUDE_ESCAPE", f"{name!r} leaves its root")
            if path.is_file():
                return path.read_text()
        raise Refusal("INCLUDE_MISSING", f"no file {name!r}")

    return read


# --- pieces of statements --------------------------------------------------------------------

_NAME = r"[A-Za-z_]\w*"


def names(text: str, line: int) -> list[str]:
    out = text.split()
    if not out or any(not re.fullmatch(_NAME, n) for n in out):
        raise Refusal("E_BAD_NAMES", f"expected names, not {text!r}", line)
    return out


def pairs(text: str, line: int) -> list[tuple[str, str]]:
    found = re.findall(rf"({_NAME})\s*=\s*({_NAME})", text)
    if not found or re.sub(rf"{_NAME}\s*=\s*{_NAME}", "", text).strip():
        raise Refusal("E_BAD_RENAME", f"expected old=new, not {text!r}", line)
    return found


@dataclass
class TableSpec:
    name: str
    keep: list[str]
    drop: list[str]
    rename: list[tuple[str, str]]
    where: E.Expr | None
    flag: str | None


def _parens(text: str, at: int, line: int) -> int:
    """The place after the parenthesis that closes the one at ``at``."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
    raise Refusal("E_UNBALANCED", "parentheses don't match", line)


def table_specs(text: str, line: int, legacy: bool, merge: bool) -> list[TableSpec]:
    """Tables with dataset options."""
    out, at = [], 0
    while at < len(text):
        m = re.compile(rf"\s*({_NAME})\s*").match(text, at)
        if not m:
            raise Refusal("E_BAD_TABLE", f"expected a table, not {text[at:]!r}", line)
        spec, at = TableSpec(m[1], [], [], [], None, None), m.end()
        if at < len(text) and text[at] == "(":
            end = _parens(text, at, line)
            inner, at = text[at + 1 : end - 1], end
            place = 0
            while inner[place:].strip():
                o = re.compile(rf"\s*({_NAME})\s*=\s*").match(inner, place)
                if not o:
                    raise Refusal("E_BAD_OPTION", f"bad dataset option in {inner!r}", line)
                key, place = o[1].lower(), o.end()
                if key in ("rename", "where"):
                    if place >= len(inner) or inner[place] != "(":
                        raise Refusal("E_BAD_OPTION", f"{key}= needs parentheses", line)
                    stop = _parens(inner, place, line)
                    body, place = inner[place + 1 : stop - 1], stop
                    if key == "rename":
                        spec.rename = pairs(body, line)
                    else:
                        spec.where = E.parse(body, legacy, line)
                elif key in ("keep", "drop", "in"):
                    stop = re.compile(rf"(?:{_NAME}\b(?!\s*=)\s*)+").match(inner, place)
                    if not stop:
                        raise Refusal("E_BAD_OPTION", f"{key}= needs names", line)
                    listed, place = names(stop[0], line), stop.end()
                    if key == "in":
                        if not merge or len(listed) > 1:
                            raise Refusal("E_BAD_OPTION", "in= names one flag of a merge", line)
                        spec.flag = listed[0]
                    else:
                        setattr(spec, key, listed)
                else:
                    raise Refusal("E_BAD_OPTION", f"no dataset option {key}=", line)
            if spec.keep and spec.drop:
                raise Refusal("E_KEEP_DROP", "keep= and drop= together", line)
        out.append(spec)
    return out


# --- blocks ------------------------------------------------------------------------------------


class Compiler:
    """Compiles a script; temporary tables have ``__`` in their names."""

    def __init__(self, legacy: bool = False):
        self.legacy, self.steps, self.number = legacy, [], 0
        self.current: dict[str, str] = {}  # script name (lower case) to the plan's table
        self.external: dict[str, str] = {}

    def temp(self) -> str:
        self.number += 1
        return f"__t{self.number}__"

    def source(self, name: str) -> str:
        return self.current.get(name.lower(), name)

    def bind(self, name: str) -> str:
        """A table of the plan for a new table of the script; redefinitions get names of their own."""
        table = name
        while table.lower() in {o.lower() for s in self.steps for o in s.outputs}:
            self.number += 1
            table = f"{name}__{self.number}"
        return table

    def add(self, op: str, inputs: list[str], outputs: list[str], params: dict, line: int) -> None:
        self.steps.append(OpStep(op, inputs, outputs, params, line))

    def expression(self, text: str, line: int) -> E.Expr:
        return E.parse(text, self.legacy, line)

    def compile(self, text: str) -> Plan:
        todo = statements(text)
        i = 0
        while i < len(todo):
            head = todo[i]
            words = head.text.split()
            kind = words[0].lower()
            j = i + 1
            if kind == "data":
                while j < len(todo) and todo[j].text.lower() != "run":
                    if re.match(r"(data|proc)\s", todo[j].text, re.I):
                        raise Refusal("E_MISSING_RUN", "a DATA step isn't closed by run", head.line)
                    j += 1
                if j == len(todo):
                    raise Refusal("E_MISSING_RUN", "a DATA step isn't closed by run", head.line)
                self.data(head, todo[i + 1 : j])
            elif kind == "proc":
                last = "quit" if words[1:2] and words[1].lower() == "sql" else "run"
                while j < len(todo) and todo[j].text.lower() not in (last, "run", "quit"):
                    j += 1
                if j == len(todo):
                    raise Refusal("E_MISSING_RUN", f"a procedure isn't closed by {last}", head.line)
                self.proc(head, todo[i + 1 : j])
            elif kind in ("options", "title", "footnote") or head.text.lower() in ("run", "quit"):
                j = i + 1
                i = j
                continue
            else:
                raise Refusal("E_UNKNOWN_STATEMENT", f"statement outside steps: {head.text[:40]!r}", head.line, "parse")
            i = j + 1
        return Plan(self.steps)

    # DATA steps

    def data(self, head: Statement, body: list[Statement]) -> None:
        outputs = names(head.text.split(None, 1)[1] if " " in head.text else "", head.line)
        source, merge, by, retain, keep, drop, rename = None, False, [], [], [], [], []
        rest: list[Statement] = []
        for s in body:
            word = s.text.split(None, 1)[0].lower()
            tail = s.text.split(None, 1)[1] if " " in s.text else ""
            if re.match(r"(array|call|infile|input|proc|file|put)\b", s.text, re.I) or re.search(r"%|\blag\w*\s*\(", masked(s.text), re.I):
                raise Refusal("BLOCK_STATEFUL_TOKEN", f"not supported in a DATA step: {s.text[:40]!r}", s.line)
            if word in ("set", "merge"):
                if source is not None:
                    raise Refusal("E_TWO_INPUTS", "a DATA step has one set or merge", s.line)
                source, merge = table_specs(tail, s.line, self.legacy, word == "merge"), word == "merge"
                if not merge and len(source) != 1:
                    raise Refusal("E_SET_TABLES", "set names one table", s.line)
            elif word == "by" and "=" not in s.text:
                by = names(tail, s.line)
            elif word == "retain" and "=" not in s.text:
                retain += names(tail, s.line)
            elif word in ("keep", "drop") and "=" not in s.text:
                (keep if word == "keep" else drop).extend(names(tail, s.line))
            elif word == "rename" and re.match(rf"rename\s+{_NAME}\s*=", s.text, re.I):
                rename += pairs(tail, s.line)
            else:
                rest.append(s)
        if source is None:
            raise Refusal("E_NO_INPUT", "a DATA step needs set or merge", head.line)
        if keep and drop:
            raise Refusal("E_KEEP_DROP", "keep and drop together", head.line)
        if merge and not by:
            raise Refusal("DATASTEP_MISSING_BY", "merge needs by", head.line)
        parser = _Body(rest, self)
        stmts = parser.block(set())
        simple = not (merge or by or retain) and all(isinstance(s, D.Assign | D.Subset) for s in stmts) and sum(isinstance(s, D.Subset) for s in stmts) <= 1
        flagged = any(re.match(r"(first|last)\.", r, re.I) for e in D.expressions(stmts) for r in E.references(e))
        if simple and not flagged and len(outputs) == 1:
            self.stateless(outputs[0], source[0], stmts, keep, drop, rename, head.line)
            return
        made = [self.bind(o) for o in outputs]
        step = D.Step(made, stmts, by, retain, keep, drop, rename, head.line)
        known = {o.lower(): m for o, m in zip(outputs, made, strict=True)}
        for s in D.statements(stmts):
            if isinstance(s, D.Output) and s.target is not None and s.target.lower() not in known:
                raise Refusal("E_OUTPUT_TARGET", f"output {s.target}: not an output of this step", s.line)
        step.body = _retarget(stmts, known)
        params = {"mode": "merge" if merge else "set", "tables": source, "step": step}
        self.add("data_step", [self.source(t.name) for t in source], made, params, head.line)
        self.current |= {o.lower(): m for o, m in zip(outputs, made, strict=True)}

    def stateless(self, out: str, t: TableSpec, stmts: list[D.Stmt], keep: list[str], drop: list[str], rename: list[tuple[str, str]], line: int) -> None:
        """A step without state, in its canonical order: options, rename, assignments, the subsetting if, keep or drop."""
        at = self.source(t.name)
        chain: list[tuple[str, dict]] = []
        if t.where is not None:
            chain.append(("filter", {"predicate": t.where}))
        if t.keep:
            chain.append(("select", {"cols": t.keep}))
        if t.drop:
            chain.append(("drop", {"cols": t.drop}))
        if t.rename:
            chain.append(("rename", {"pairs": t.rename}))
        if rename:
            chain.append(("rename", {"pairs": rename}))
        sets = [(s.name, s.value) for s in stmts if isinstance(s, D.Assign)]
        if sets:
            chain.append(("compute", {"mode": "any", "items": sets}))
        chain += [("filter", {"predicate": s.test}) for s in stmts if isinstance(s, D.Subset)]
        if keep:
            chain.append(("select", {"cols": keep}))
        if drop:
            chain.append(("drop", {"cols": drop}))
        if not chain:
            chain.append(("identity", {}))
        for n, (op, params) in enumerate(chain):
            to = self.bind(out) if n == len(chain) - 1 else self.temp()
            self.add(op, [at], [to], params, line)
            at = to
        self.current[out.lower()] = at

    # procedures

    def proc(self, head: Statement, body: list[Statement]) -> None:
        kind = head.text.split()[1].lower() if len(head.text.split()) > 1 else ""
        parts = {"sort": self.proc_sort, "transpose": self.proc_transpose, "sql": self.proc_sql, "format": self.proc_format, "summary": self.proc_summary, "means": self.proc_summary}
        if kind not in parts:
            raise Refusal("E_UNKNOWN_PROC", f"no procedure {kind!r}", head.line)
        parts[kind](head, body)

    def options(self, head: Statement, allowed: set[str]) -> dict[str, str]:
        tail = re.sub(r"^proc\s+\w+", "", head.text, flags=re.I)
        found: dict[str, str] = {}
        for m in re.finditer(rf"({_NAME})(?:\s*=\s*({_NAME}))?|(\S)", tail):
            if m[3] or m[1].lower() not in allowed:
                raise Refusal("E_PROC_OPTION", f"not supported: {m[0]!r}", head.line)
            found[m[1].lower()] = m[2] or ""
        return found

    def clauses(self, body: list[Statement], allowed: set[str]) -> dict[str, tuple[str, int]]:
        out: dict[str, tuple[str, int]] = {}
        for s in body:
            word, _, tail = s.text.partition(" ")
            if word.lower() not in allowed or word.lower() in out:
                raise Refusal("E_PROC_STATEMENT", f"not supported: {s.text[:40]!r}", s.line)
            out[word.lower()] = (tail.strip(), s.line)
        return out

    def need(self, found: dict, key: str, line: int):
        if not found.get(key):
            raise Refusal("E_PROC_INCOMPLETE", f"{key} is missing", line)
        return found[key]

    def proc_sort(self, head: Statement, body: list[Statement]) -> None:
        o = self.options(head, {"data", "out", "nodupkey", "nodup"})
        by, line = self.need(self.clauses(body, {"by"}), "by", head.line)
        if "descending" in by.lower().split():
            raise Refusal("SORT_UNSUPPORTED", "descending keys aren't supported", line)
        data = self.need(o, "data", head.line)
        out = o.get("out") or data
        made = self.bind(out)
        self.add("sort", [self.source(data)], [made], {"by": names(by, line), "nodupkey": "nodupkey" in o or "nodup" in o}, head.line)
        self.current[out.lower()] = made

    def proc_transpose(self, head: Statement, body: list[Statement]) -> None:
        o = self.options(head, {"data", "out"})
        c = self.clauses(body, {"by", "id", "var"})
        data, out = self.need(o, "data", head.line), self.need(o, "out", head.line)
        by, ident, var = (names(*self.need(c, k, head.line)) for k in ("by", "id", "var"))
        if len(ident) != 1 or len(var) != 1:
            raise Refusal("E_TRANSPOSE", "one id and one var", head.line)
        made = self.bind(out)
        self.add("transpose", [self.source(data)], [made], {"by": by, "id": ident[0], "var": var[0]}, head.line)
        self.current[out.lower()] = made

    def proc_format(self, head: Statement, body: list[Statement]) -> None:
        for s in body:
            m = re.fullmatch(rf"value\s+(\$?{_NAME})\s+(.*)", s.text, re.I | re.S)
            if not m:
                raise Refusal("E_FORMAT", f"not supported: {s.text[:40]!r}", s.line)
            item = re.compile(r"\s*(?:(other)|(\"[^\"]*\"|'[^']*'))\s*=\s*(\"[^\"]*\"|'[^']*')\s*", re.I)
            found, other, at = {}, None, 0
            while at < len(m[2]):
                p = item.match(m[2], at)
                if not p:
                    raise Refusal("E_FORMAT", f"bad mapping in format {m[1]}", s.line)
                if p[1]:
                    other = p[3][1:-1]
                else:
                    found[p[2][1:-1]] = p[3][1:-1]
                at = p.end()
            self.add("format", [], [], {"name": m[1], "map": found, "other": other}, s.line)

    def proc_summary(self, head: Statement, body: list[Statement]) -> None:
        o = self.options(head, {"data", "nway", "noprint"})
        c = self.clauses(body, {"class", "var", "output"})
        if "nway" not in o:
            raise Refusal("E_SUMMARY_NWAY", "summary needs nway", head.line)
        text, line = self.need(c, "output", head.line)
        m = re.fullmatch(rf"out\s*=\s*({_NAME})\s+(.*?)\s*/\s*autoname", text, re.I) or re.fullmatch(rf"out\s*=\s*({_NAME})\s+((?:\w+\s*=\s*)+)", text, re.I)
        stats = re.findall(r"(\w+)\s*=", m[2]) if m else []
        if not m or not stats or re.sub(r"\w+\s*=", "", m[2]).strip():
            raise Refusal("E_SUMMARY_OUTPUT", "output out=<table> <stat>= / autoname", line)
        keys = names(*c["class"]) if c.get("class") else []
        made = self.bind(m[1])
        params = {"class": keys, "vars": names(*self.need(c, "var", head.line)), "stats": [s.lower() for s in stats]}
        self.add("summary", [self.source(self.need(o, "data", head.line))], [made], params, head.line)
        self.current[m[1].lower()] = made

    def proc_sql(self, head: Statement, body: list[Statement]) -> None:
        if len(body) != 1:
            raise Refusal("SQL_UNSUPPORTED_FORM", "one create table in a procedure", head.line)
        s = body[0]
        flat = flattened(s.text)
        m = matched(rf"create table ({_NAME}) as select (.+?) from (.+)", flat)
        if not m:
            raise Refusal("SQL_UNSUPPORTED_FORM", "create table t as select ... from ...", s.line)
        bare = masked(flat)
        if re.search(r"\b(union|intersect|except|having|order by|distinct|case|over|right|full|cross)\b", bare, re.I) or re.search(r"\(\s*select\b", bare, re.I):
            raise Refusal("SQL_UNSUPPORTED_FORM", "outside the supported SELECT", s.line)
        rest, group = (split_at(r"\bgroup by\b", m[2], 1) + [""])[:2]
        rest, where = (split_at(r"\bwhere\b", rest, 1) + [""])[:2]
        parts = split_at(r"\b(inner join|left join|join)\b", rest)
        sources = [self.sql_table(parts[0], s.line, "from")]
        for kind, spec in zip(parts[1::2], parts[2::2], strict=True):
            if kind.lower() == "join":
                raise Refusal("SQL_UNSUPPORTED_FORM", "say inner join or left join", s.line)
            table, e = (split_at(r"\bon\b", spec, 1) + [""])[:2]
            if not e.strip():
                raise Refusal("SQL_UNSUPPORTED_FORM", "a join needs on", s.line)
            found = self.sql_table(table, s.line, kind.split()[0].lower())
            found.on = E.parse(e, True, s.line)
            sources.append(found)
        query = Query([self.sql_item(i, s.line) for i in m[1].split(",")], sources, E.parse(where, True, s.line) if where.strip() else None, [g.strip() for g in group.split(",")] if group.strip() else [])
        made = self.bind(m[0])
        self.add("sql_select", [x.table for x in sources], [made], {"query": query}, s.line)
        self.current[m[0].lower()] = made

    def sql_table(self, text: str, line: int, kind: str) -> Source:
        m = re.fullmatch(rf"({_NAME})(?:\s+(?:as\s+)?({_NAME}))?", text.strip(), re.I)
        if not m:
            raise Refusal("SQL_UNSUPPORTED_FORM", f"not a table: {text.strip()!r}", line)
        return Source(self.source(m[1]), m[2] or m[1], kind)

    def sql_item(self, text: str, line: int) -> Item:
        col = rf"{_NAME}(?:\.{_NAME})?"
        m = re.fullmatch(rf"(?:(count|sum|min|max|avg)\s*\(\s*(\*|{col})\s*\)|({col}))(?:\s+(?:as\s+)?({_NAME}))?", text.strip(), re.I)
        if not m or (m[2] == "*" and m[1].lower() != "count"):
            raise Refusal("SQL_UNSUPPORTED_FORM", f"not a column or aggregate: {text.strip()!r}", line)
        if m[1]:
            return Item(None if m[2] == "*" else m[2], m[1].lower(), m[4])
        return Item(m[3], None, m[4])


def _retarget(body: list[D.Stmt], known: dict[str, str]) -> list[D.Stmt]:
    """Outputs under the plan's names."""
    out: list[D.Stmt] = []
    for s in body:
        if isinstance(s, D.Output) and s.target is not None:
            s = D.Output(known[s.target.lower()], s.line)
        elif isinstance(s, D.Branch):
            s = D.Branch(tuple((e, tuple(_retarget(list(b), known))) for e, b in s.cases), None if s.otherwise is None else tuple(_retarget(list(s.otherwise), known)), s.required, s.line)
        elif isinstance(s, D.Loop):
            s = D.Loop(s.name, s.first, s.last, s.step, tuple(_retarget(list(s.body), known)), s.line)
        out.append(s)
    return out


class _Body:
    """Parses the executable statements of a DATA step."""

    def __init__(self, todo: list[Statement], compiler: Compiler):
        self.todo, self.at, self.c, self.depth = todo, 0, compiler, 0

    def block(self, stops: set[str]) -> list[D.Stmt]:
        self.depth += 1
        if self.depth > D.MAX_DEPTH + 1:
            raise Refusal("CONTROL_DEPTH", f"control flow nested more than {D.MAX_DEPTH} deep")
        out: list[D.Stmt] = []
        while self.at < len(self.todo):
            if self.todo[self.at].text.lower() in stops:
                self.depth -= 1
                return out
            s = self.todo[self.at]
            self.at += 1
            out.append(self.statement(s.text, s.line))
        if stops:
            raise Refusal("E_MISSING_END", "a block isn't closed by end")
        self.depth -= 1
        return out

    def ended(self) -> list[D.Stmt]:
        out = self.block({"end"})
        self.at += 1
        return out

    def statement(self, text: str, line: int) -> D.Stmt:
        if m := matched(r"if\s+(.*?)\s+then\b\s*(.*)", text):
            return self.chain(m[0], m[1], line)
        if m := re.fullmatch(r"if\b\s*(.*)", text, re.I | re.S):
            return D.Subset(self.c.expression(m[1], line), line)
        if m := re.fullmatch(rf"do\s+({_NAME})\s*=\s*(-?\d+)\s+to\s+(-?\d+)(?:\s+by\s+(-?\d+))?", text, re.I):
            body = self.ended()
            return D.Loop(m[1], int(m[2]), int(m[3]), int(m[4] or 1), tuple(body), line)
        if text.lower() == "do":
            return D.Branch(((E.Lit(True), tuple(self.ended())),), None, False, line)
        if re.match(r"do\b", text, re.I):
            raise Refusal("LOOP_UNSUPPORTED", f"not a loop over whole numbers: {text[:40]!r}", line)
        if m := re.fullmatch(r"select\b\s*(?:\((.*)\))?", text, re.I | re.S):
            return self.select(m[1], line)
        if m := re.fullmatch(rf"output(?:\s+({_NAME}))?", text, re.I):
            return D.Output(m[1], line)
        if m := re.fullmatch(rf"({_NAME})\s*=(?!=)\s*(.*)", text, re.S):
            return D.Assign(m[1], self.c.expression(m[2], line), line)
        raise Refusal("E_UNKNOWN_STATEMENT", f"not supported in a DATA step: {text[:40]!r}", line)

    def action(self, text: str, line: int) -> tuple[D.Stmt, ...]:
        if text.lower() == "do":
            return tuple(self.ended())
        return (self.statement(text, line),)

    def chain(self, test: str, then: str, line: int) -> D.Stmt:
        cases = [(self.c.expression(test, line), self.action(then, line))]
        otherwise = None
        while self.at < len(self.todo) and (m := re.match(r"else\b\s*(.*)", self.todo[self.at].text, re.I | re.S)):
            here = self.todo[self.at].line
            self.at += 1
            if inner := matched(r"if\s+(.*?)\s+then\b\s*(.*)", m[1]):
                cases.append((self.c.expression(inner[0], here), self.action(inner[1], here)))
                continue
            otherwise = self.action(m[1], here)
            break
        return D.Branch(tuple(cases), otherwise, False, line)

    def select(self, selector: str | None, line: int) -> D.Stmt:
        """``select;`` tests conditions; ``select (x);`` compares x with each when's values."""
        left = self.c.expression(selector, line) if selector and selector.strip() else None
        cases, otherwise = [], None
        while self.at < len(self.todo):
            s = self.todo[self.at]
            self.at += 1
            if s.text.lower() == "end":
                return D.Branch(tuple(cases), otherwise, True, line)
            if m := re.match(r"otherwise\b\s*(.*)", s.text, re.I | re.S):
                otherwise = self.action(m[1], s.line) if m[1] else ()
                continue
            m = re.match(r"when\s*\(", s.text, re.I)
            if not m:
                raise Refusal("E_SELECT", f"expected when or otherwise: {s.text[:40]!r}", s.line)
            stop = _parens(s.text, m.end() - 1, s.line)
            inner, then = s.text[m.end() : stop - 1], s.text[stop:].strip()
            if left is None:
                test = self.c.expression(inner, s.line)
            else:
                tests = [E.Binary("==", left, self.c.expression(v, s.line)) for v in _commas(inner)]
                test = tests[0] if len(tests) == 1 else E.Logic("or", tuple(tests))
            cases.append((test, self.action(then, s.line)))
        raise Refusal("E_MISSING_END", "select isn't closed by end", line)


def _commas(text: str) -> list[str]:
    """Parts between commas outside quotes and parentheses."""
    return [p for p in re.findall(r"(?:[^,\"'()]|\"[^\"]*\"|'[^']*'|\([^()]*\))+", text) if p.strip()]


def compile_script(text: str, legacy: bool = False, include: Callable[[str], str] | None = None) -> Plan:
    return Compiler(legacy).compile(expand(text, include))
