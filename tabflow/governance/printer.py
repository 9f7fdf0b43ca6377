"""Plans back to source text, and the formatter."""

from __future__ import annotations

import re

from tabflow.errors import invalid
from tabflow.frontend import pipeline
from tabflow.functions import expr as E
from tabflow.plans.ir import KERNEL, Plan, step_id

HEADER = "# tabflow 0.1"


def _columns(spec: dict) -> str:
    cols = spec.get("columns")
    return ", columns(" + ", ".join(f"{n}:{k}" if k else n for n, k in cols) + ")" if cols else ""


def script(plan: Plan) -> str:
    """A pipeline script of a plan of kernel steps: one table per step, in canonical order."""
    out = [HEADER]
    names: dict[str, str] = {}

    def name(table: str) -> str:
        if table not in names:
            plain = re.sub(r"^__t(\d+)__$", r"step_\1", table)
            names[table] = plain.removeprefix("__datasource__") if table.startswith("__datasource__") else plain
        return names[table]

    steps = plan.order()
    for s in [*(s for s in steps if s.outputs), *(s for s in steps if not s.outputs)]:
        if s.op not in KERNEL:
            raise invalid("E_PRINT_OP", f"{s.op} has no pipeline syntax")
        p = s.params
        if s.op in ("const", "let_scalar"):
            continue  # already substituted
        if s.op == "datasource":
            body = f'inline_csv("""\n{p["text"]}"""{_columns(p)})' if p["kind"] == "inline_csv" else f'{p["kind"]}("{p["path"]}"{_columns(p)})'
            out.append(f"datasource {p['name']} = {body}")
            continue
        if s.op == "save":
            out.append(f'save {name(s.inputs[0])} to "{p["path"]}" as "{p["name"]}"')
            continue
        if s.op == "assert":
            out.append(f"assert {E.to_text(p['predicate'])}")
            continue
        at, to = s.inputs[0], name(s.outputs[0])
        source = f"from({name(at)})"
        if s.op == "identity":
            out.append(f"table {to} = {source}")
        elif s.op == "sort":
            out.append(f"table {to} = sort({source}).by({', '.join(p['by'])}).nodupkey({'true' if p.get('nodupkey') else 'false'})")
        elif s.op == "aggregate":
            keys = f".class({', '.join(p['class'])})" if p["class"] else ""
            out.append(f"table {to} = aggregate({source}){keys}.var({', '.join(p['vars'])}).stats({', '.join(p['stats'])})")
        else:
            out.append(f"table {to} = {source} do\n\t{transform(s.op, p)}\nend")
    return "\n".join(out) + "\n"


def transform(op: str, p: dict) -> str:
    if op in ("select", "drop"):
        return f"{op} {', '.join(p['cols'])}"
    if op == "filter":
        return f"filter({E.to_text(p['predicate'])})"
    if op == "rename":
        return f"rename({', '.join(f'{a} -> {b}' for a, b in p['pairs'])})"
    if op == "cast":
        return "cast(" + ", ".join(f"{c['col']} -> {c['to']} on_error={c.get('on_error', 'fail')} trim={'true' if c.get('trim') else 'false'}" for c in p["casts"]) + ")"
    word = "update!" if p.get("mode") == "update" else "derive"
    return f"{word}({', '.join(f'{n} = {E.to_text(e)}' for n, e in p['items'])})"


def format_text(text: str) -> str:
    """The script with canonical spacing: the same plan, and formatting it again changes nothing.

    Lines keep their order and comments; inside blocks they are indented by one tab; spaces
    outside strings are normalised around operators, commas and parentheses.
    """
    before = pipeline.compile_script(text)
    out, depth, raw = [], 0, False
    for line in text.split("\n"):
        if raw:
            out.append(line.rstrip())
            raw = '"""' not in line and line.strip() != "end"
            if not raw and line.strip() == "end":
                out[-1] = "end"
            continue
        words = line.strip()
        if words.count('"""') == 1 or re.match(r"datasource\b.*\binline_csv\b.*\bdo$", words):
            out.append(_spaced(words) if '"""' not in words else words)
            raw = True
            continue
        if not words:
            if out and out[-1]:
                out.append("")
            continue
        if words.startswith("#"):
            out.append("\t" * depth + words)
            continue
        words = _spaced(words)
        if re.match(r"(end|\})", words):
            depth = max(0, depth - 1)
        out.append("\t" * depth + words)
        if re.search(r"(\bdo|\{)$", words):
            depth += 1
    made = "\n".join(out).strip("\n") + "\n"
    after = pipeline.compile_script(made)
    if [step_id(s) for s in before.steps] != [step_id(s) for s in after.steps]:
        raise invalid("E_FORMAT_PLAN", "formatting would change the plan")
    return made


def _spaced(line: str) -> str:
    parts = re.split(r"(\"[^\"]*\"|'[^']*'|#.*$)", line)
    for i in range(0, len(parts), 2):
        p = re.sub(r"\s+", " ", parts[i])
        p = re.sub(r"\s*(->|==|!=|<=|>=|(?<![-<>=!])[<>](?![=])|(?<![=!<>])=(?!=)|\+|(?<=[\w)\]]) ?-(?!>)|\*|/)\s*", lambda m: f" {m[1].strip()} ", p)
        p = re.sub(r"\s*,\s*", ", ", p)
        p = re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", p))
        p = re.sub(r"(?i:update)\s*!\s*\(", "update!(", p)
        p = re.sub(r"(on_error|trim) = ", r"\1=", p)
        if i == 0:  # keywords in lower case, where they stand as such
            p = re.sub(r"^(datasource|let|const|format|table|save|assert|select|drop|filter|derive|rename|cast|end)\b|^update!", lambda m: m[0].lower(), p, flags=re.I)
            p = re.sub(r"(?<== )(from|sort|aggregate|summary|csv|xpt|parquet|inline_csv)(?=\()", lambda m: m[0].lower(), p, flags=re.I)
            p = re.sub(r"\bcolumns(?=\()", "columns", p, flags=re.I)
        p = re.sub(r"\.(by|nodupkey|class|var|stats)\(", lambda m: m[0].lower(), p, flags=re.I)
        p = re.sub(r"(?<=\.nodupkey\()(true|false)(?=\))", lambda m: m[0].lower(), p, flags=re.I)
        p = re.sub(r"(?<=\) )(select|drop|filter|do)\b", lambda m: m[0].lower(), p, flags=re.I)
        p = re.sub(r"^(save \w+) to\b|^ as $", lambda m: m[0].lower(), p, flags=re.I)
        parts[i] = p
    return "".join(parts).strip()
