"""Plan amendments: a list of edits that apply together or not at all."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from tabflow.errors import Refusal, invalid
from tabflow.functions import expr as E
from tabflow.plans.ir import KERNEL, OpStep, Plan, _read, plain, step_id, to_json, transform_id

MAX_OPS = 50


def _step(plan: Plan, ref: object) -> int:
    """A step by the table that it makes, by its id (or the id's beginning), or by its place."""
    if isinstance(ref, int):
        if 0 <= ref < len(plan.steps):
            return ref
    found = [i for i, s in enumerate(plan.steps) if ref in s.outputs or (isinstance(ref, str) and len(ref) >= 8 and step_id(s).startswith(ref))]
    if len(found) != 1:
        raise invalid("E_AMEND_TARGET", f"{ref!r} names {len(found)} steps")
    return found[0]


def _make(d: dict) -> OpStep:
    if d.get("op") not in KERNEL:
        raise invalid("E_AMEND_OP", f"an amendment can't make {d.get('op')!r}")
    return OpStep(d["op"], list(d.get("inputs", [])), list(d.get("outputs", [])), _read(d.get("params", {})))


def _expression(x: object) -> E.Expr:
    return E.parse(x) if isinstance(x, str) else E.from_json(x)


def add_step(plan: Plan, a: dict) -> None:
    at = _step(plan, a["after"]) + 1 if "after" in a else len(plan.steps)
    plan.steps.insert(at, _make(a["step"]))


def remove_step(plan: Plan, a: dict) -> None:
    s = plan.steps.pop(_step(plan, a["step"]))
    if len(s.inputs) == 1 and a.get("rewire"):
        for t in plan.steps:
            t.inputs = [s.inputs[0] if i in s.outputs else i for i in t.inputs]


def replace_step(plan: Plan, a: dict) -> None:
    plan.steps[_step(plan, a["step"])] = _make(a["with"])


def rewire_inputs(plan: Plan, a: dict) -> None:
    plan.steps[_step(plan, a["step"])].inputs = list(a["inputs"])


def rewire_outputs(plan: Plan, a: dict) -> None:
    plan.steps[_step(plan, a["step"])].outputs = list(a["outputs"])


def rename_table(plan: Plan, a: dict) -> None:
    old, new = a["from"], a["to"]
    if any(new in (*s.inputs, *s.outputs) for s in plan.steps):
        raise invalid("E_AMEND_NAME", f"{new!r} is taken")
    if not any(old in (*s.inputs, *s.outputs) for s in plan.steps):
        raise invalid("E_AMEND_TARGET", f"no table {old!r}")
    for s in plan.steps:
        s.inputs = [new if i == old else i for i in s.inputs]
        s.outputs = [new if o == old else o for o in s.outputs]


def set_params(plan: Plan, a: dict) -> None:
    s = plan.steps[_step(plan, a["step"])]
    unknown = set(a["params"]) - set(s.params)
    if unknown:
        raise invalid("E_AMEND_PARAM", f"{s.op} has no parameter {sorted(unknown)[0]!r}")
    s.params = s.params | _read(a["params"])


def _place(s: OpStep, path: list) -> tuple[Callable[[], E.Expr], Callable[[E.Expr], None]]:
    """The expression at a place of a step: ``["predicate"]`` or ``["items", column]``."""
    if path == ["predicate"] and "predicate" in s.params:
        return lambda: s.params["predicate"], lambda e: s.params.__setitem__("predicate", e)
    if len(path) == 2 and path[0] == "items":
        items = s.params.get("items", [])
        for i, (n, e) in enumerate(items):
            if n == path[1]:
                return lambda: e, lambda new: items.__setitem__(i, (n, new))
    raise invalid("E_AMEND_TARGET", f"no expression at {path!r}")


def replace_expr(plan: Plan, a: dict) -> None:
    _, put = _place(plan.steps[_step(plan, a["step"])], list(a["at"]))
    put(_expression(a["expr"]))


def _inside(e: E.Expr, path: list, change: Callable[[E.Expr], E.Expr]) -> E.Expr:
    """The expression with the part at ``path`` changed: ``left``, ``right``, or an argument's number."""
    if not path:
        return change(e)
    at, rest = path[0], path[1:]
    if isinstance(e, E.Binary) and at in ("left", "right"):
        sides = {"left": e.left, "right": e.right}
        return E.Binary(e.op, **(sides | {at: _inside(sides[at], rest, change)}))
    if isinstance(e, E.Logic | E.Call) and isinstance(at, int) and 0 <= at < len(e.args):
        args = tuple(_inside(x, rest, change) if i == at else x for i, x in enumerate(e.args))
        return E.Logic(e.op, args) if isinstance(e, E.Logic) else E.Call(e.name, args)
    raise invalid("E_AMEND_TARGET", f"no part {at!r} in {E.to_text(e)!r}")


def _literal(e: E.Expr, a: dict) -> E.Expr:
    if not isinstance(e, E.Lit):
        raise invalid("E_AMEND_TYPE", f"{E.to_text(e)!r} isn't a literal")
    new = E.Lit(Decimal(a["literal"]["value"]) if isinstance(a["literal"], dict) else a["literal"])
    if e.value is not None and new.value is not None and _kind(e.value) != _kind(new.value):
        raise invalid("E_AMEND_TYPE", f"{new.value!r} is of another type than {e.value!r}")
    return new


def _kind(value: object) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, int | Decimal) else "text"


def _column(e: E.Expr, a: dict) -> E.Expr:
    if not isinstance(e, E.Ref):
        raise invalid("E_AMEND_TYPE", f"{E.to_text(e)!r} isn't a column")
    return E.Ref(a["column"])


#: Operators that may stand for one another.
GROUPS = ({"==", "!=", "<", "<=", ">", ">="}, {"+", "-", "*", "/"}, {"and", "or"})


def _operator(e: E.Expr, a: dict) -> E.Expr:
    own = e.op if isinstance(e, E.Binary | E.Logic) else None
    if not any(own in g and a["op"] in g for g in GROUPS):
        raise invalid("E_AMEND_TYPE", f"{a['op']!r} can't stand for {own!r}")
    return E.Binary(a["op"], e.left, e.right) if isinstance(e, E.Binary) else E.Logic(a["op"], e.args)


def _negated(e: E.Expr, a: dict) -> E.Expr:
    if not (isinstance(e, E.Logic) or (isinstance(e, E.Binary) and e.op in GROUPS[0])):
        raise invalid("E_AMEND_TYPE", f"{E.to_text(e)!r} isn't true or false")
    return E.Logic("not", (e,))


#: The typed edits; others are refused.
EDITS = {"replace_literal": _literal, "replace_column": _column, "replace_op": _operator, "wrap_not": _negated}


def edit_expr(plan: Plan, a: dict) -> None:
    """A typed edit of the part of an expression at a path, or, with ``find``, a replacement wherever a part occurs."""
    at = list(a["at"])
    base, path = (at[:1], at[1:]) if at[0] == "predicate" else (at[:2], at[2:])
    get, put = _place(plan.steps[_step(plan, a["step"])], base)
    if "edit" in a:
        if a["edit"] not in EDITS:
            raise invalid("E_AMEND_EDIT", f"no edit {a['edit']!r} of expressions")
        put(_inside(get(), path, lambda e: EDITS[a["edit"]](e, a)))
        return
    old, new = _expression(a["find"]), _expression(a["replace"])
    hits = 0

    def go(e: E.Expr) -> E.Expr:
        nonlocal hits
        if e == old:
            hits += 1
            return new
        if isinstance(e, E.Binary):
            return E.Binary(e.op, go(e.left), go(e.right))
        if isinstance(e, E.Logic):
            return E.Logic(e.op, tuple(map(go, e.args)))
        return E.Call(e.name, tuple(map(go, e.args))) if isinstance(e, E.Call) else e

    put(go(get()))
    if not hits:
        raise invalid("E_AMEND_TARGET", f"{E.to_text(old)!r} isn't in the expression")


def assertion_id(s: OpStep) -> str:
    """The id that an assertion was given, else one that follows from what it says."""
    return s.params.get("id") or "a" + transform_id(s)[:12]


def _asserted(plan: Plan, a: dict) -> int:
    """The step of the assertion with an id, or of a number among the assertions."""
    found = [i for i, s in enumerate(plan.steps) if s.op == "assert"]
    if "id" not in a:
        return found[a["index"]]
    hits = [i for i in found if assertion_id(plan.steps[i]) == a["id"]]
    if len(hits) != 1:
        raise invalid("E_AMEND_TARGET", f"{a['id']!r} names {len(hits)} assertions")
    return hits[0]


def _assertion(plan: Plan, e: E.Expr, name: str | None) -> OpStep:
    used = [c.args[0].name for c in E.walk(e) if isinstance(c, E.Call) and c.name == "row_count" and isinstance(c.args[0], E.Ref)]
    made = OpStep("assert", used, [], {"predicate": e} | ({"id": name} if name else {}))
    if any(s.op == "assert" and assertion_id(s) == assertion_id(made) for s in plan.steps):
        raise invalid("E_AMEND_NAME", f"assertion {assertion_id(made)!r} is there already")
    return made


def add_assertion(plan: Plan, a: dict) -> None:
    plan.steps.append(_assertion(plan, _expression(a["predicate"]), a.get("id")))


def remove_assertion(plan: Plan, a: dict) -> None:
    del plan.steps[_asserted(plan, a)]


def replace_assertion(plan: Plan, a: dict) -> None:
    at = _asserted(plan, a)
    old = plan.steps.pop(at)
    plan.steps.insert(at, _assertion(plan, _expression(a["predicate"]), old.params.get("id")))


KINDS: dict[str, Callable[[Plan, dict], None]] = {f.__name__: f for f in (add_step, remove_step, replace_step, rewire_inputs, rewire_outputs, rename_table, set_params, replace_expr, edit_expr, add_assertion, remove_assertion, replace_assertion)}


@dataclass(frozen=True)
class Policy:
    """What a request's edits may do: take steps and assertions away, give steps other outputs, and how many there may be.
    ``kinds``: only these, if given."""

    destructive: bool = False
    rewire_outputs: bool = False
    most: int = MAX_OPS
    kinds: frozenset[str] | None = None

    @staticmethod
    def of(given: dict) -> Policy:
        unknown = set(given) - {"destructive", "rewire_outputs", "most"}
        if unknown:
            raise invalid("E_AMEND_POLICY", f"no policy {sorted(unknown)[0]!r}")
        return Policy(bool(given.get("destructive")), bool(given.get("rewire_outputs")), min(MAX_OPS, int(given.get("most", MAX_OPS))))

    def check(self, kind: str) -> None:
        if kind in ("remove_step", "remove_assertion") and not self.destructive:
            raise invalid("E_AMEND_POLICY", f"{kind} takes something away, which the policy doesn't allow")
        if kind == "rewire_outputs" and not self.rewire_outputs:
            raise invalid("E_AMEND_POLICY", "the policy doesn't allow other outputs")
        if self.kinds is not None and kind not in self.kinds:
            raise invalid("E_AMEND_POLICY", f"edits of kind {kind!r} aren't allowed")


def apply(plan: Plan, amendments: list[dict], tables: set[str], policy: Policy = Policy()) -> Plan:  # noqa: B008
    """The amended plan.  One refused edit, or a plan that doesn't hold together, refuses all; the given plan stays as it is."""
    if len(amendments) > policy.most:
        raise invalid("E_AMEND_LIMIT", f"more than {policy.most} edits")
    new = copy.deepcopy(plan)
    for n, a in enumerate(amendments):
        kind = a.get("kind")
        if kind not in KINDS:
            raise invalid("E_AMEND_KIND", f"no edit {kind!r}")
        try:
            policy.check(kind)
            KINDS[kind](new, a)
        except (KeyError, IndexError, TypeError, ArithmeticError) as e:
            raise invalid("E_AMEND_SHAPE", f"edit {n} ({kind}) is incomplete: {e}") from e
        except Refusal as e:
            raise Refusal(e.code, f"edit {n} ({kind}): {e.message}", e.line, e.bucket) from e
    new.check(tables)
    new.order()
    return new


def request(plan: Plan, asked: dict | list, tables: set[str]) -> dict:
    """The answer to a request (edits, or ``policy`` and ``edits``): status, the new plan, what differs, and refusals."""
    given = asked if isinstance(asked, dict) else {"edits": asked}
    try:
        new = apply(plan, given["edits"], tables, Policy.of(given.get("policy", {})))
    except KeyError:
        return {"status": "refused", "refusals": [{"code": "E_AMEND_SHAPE", "message": "a request has edits"}], "warnings": []}
    except Refusal as e:
        return {"status": "refused", "refusals": [{"code": e.code, "message": e.message}], "warnings": []}
    try:
        warnings = new.invariants()
    except Refusal as e:
        warnings = [f"{e.code}: {e.message}"]
    return {"status": "ok", "plan": plain(to_json(new)), "diff": diff(plan, new), "assertions": assertion_diff(plan, new), "refusals": [], "warnings": warnings}


def assertion_diff(old: Plan, new: Plan) -> dict:
    """Assertions by id that came, went, or say something else."""
    a, b = ({assertion_id(s): E.to_text(s.params["predicate"]) for s in p.steps if s.op == "assert"} for p in (old, new))
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "modified": [{"id": k, "from": a[k], "to": b[k]} for k in sorted(a.keys() & b.keys()) if a[k] != b[k]]}


def diff(old: Plan, new: Plan) -> dict:
    """Steps added, removed, and changed (the same outputs by another transform)."""
    a = {tuple(s.outputs) or (s.op, step_id(s)): s for s in old.steps}
    b = {tuple(s.outputs) or (s.op, step_id(s)): s for s in new.steps}
    return {
        "added": sorted(str(list(k)) for k in b.keys() - a.keys()),
        "removed": sorted(str(list(k)) for k in a.keys() - b.keys()),
        "changed": [{"outputs": list(k), "from": plain(a[k].params), "to": plain(b[k].params), "op": [a[k].op, b[k].op]} for k in sorted(a.keys() & b.keys(), key=str) if transform_id(a[k]) != transform_id(b[k]) or a[k].inputs != b[k].inputs],
    }
