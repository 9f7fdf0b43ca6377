"""Syntax of scalar expressions: tokens, a precedence parser, and a tree that serialises to JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from tabflow.errors import Refusal


@dataclass(frozen=True)
class Lit:
    value: None | bool | int | Decimal | str


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


Expr = Lit | Ref | Binary | Logic | Call

#: The functions of the language; a second argument that names a format is a string literal in the tree.
FUNCTIONS = {"coalesce": (1, None), "if": (3, 3), "put": (2, 2), "input": (2, 2), "row_count": (1, 1)}
COMPARE = {"==", "!=", "<", "<=", ">", ">="}
#: The spellings of older scripts.
LEGACY = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "=": "==", "^=": "!=", "~=": "!="}
KEYWORDS = {"and", "or", "not", "null", "true", "false"}

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>\d+(?:\.\d+)?)|
    (?P<str>"[^"]*"|'[^']*')|
    (?P<fmt>\$[A-Za-z_]\w*\.?|[A-Za-z_]\w*\.(?![\w]))|
    (?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|
    (?P<op><>|\^=|~=|==|!=|<=|>=|[-+*/<>=()\[\],])|
    (?P<dot>\.)
    )""",
    re.X,
)


def tokens(text: str, line: int | None = None) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = _TOKEN.match(text, at)
        if m is None:
            raise Refusal("E_BAD_EXPR", f"unexpected character in expression: {text[at:].strip()[:20]!r}", line)
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, legacy: bool, line: int | None):
        self.items, self.at, self.legacy, self.line, self.text = tokens(text, line), 0, legacy, line, text

    def fail(self, message: str) -> Refusal:
        return Refusal("E_BAD_EXPR", f"{message} in {self.text.strip()!r}", self.line)

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("", "")

    def word(self) -> str:
        """The next token as an operator or keyword, older spellings translated."""
        kind, text = self.peek()
        low = text.lower()
        if kind == "op" and text == "<>":
            raise Refusal("E_LEGACY_EXPR", "the operator <> is ambiguous", self.line)
        if kind in ("op", "name") and low in LEGACY and (kind == "op" or self.legacy):
            if not self.legacy:
                raise Refusal("E_BAD_EXPR", f"write {LEGACY[low]} for {text}", self.line)
            return LEGACY[low]
        return low if kind == "op" or (kind == "name" and low in KEYWORDS) else ""

    def accept(self, *words: str) -> str:
        found = self.word()
        if found in words:
            self.at += 1
            return found
        return ""

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise self.fail(f"expected {word!r}")

    def disjunction(self) -> Expr:
        return self._chain("or", self.conjunction)

    def conjunction(self) -> Expr:
        return self._chain("and", self.negation)

    def _chain(self, op: str, part) -> Expr:
        args = [part()]
        while self.accept(op):
            args.append(part())
        flat = [b for a in args for b in (a.args if isinstance(a, Logic) and a.op == op else (a,))]
        return flat[0] if len(flat) == 1 else Logic(op, tuple(flat))

    def negation(self) -> Expr:
        if self.accept("not"):
            return Logic("not", (self.negation(),))
        left = self.sum()
        if op := self.accept(*COMPARE):
            left = Binary(op, left, self.sum())
            if self.word() in COMPARE:
                raise self.fail("comparisons don't chain")
        return left

    def sum(self) -> Expr:
        left = self.product()
        while op := self.accept("+", "-"):
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Expr:
        left = self.sign()
        while op := self.accept("*", "/"):
            left = Binary(op, left, self.sign())
        return left

    def sign(self) -> Expr:
        if self.accept("-"):
            inner = self.sign()
            if isinstance(inner, Lit) and isinstance(inner.value, int | Decimal) and not isinstance(inner.value, bool):
                return Lit(-inner.value)
            return Binary("-", Lit(0), inner)
        if self.accept("+"):
            return self.sign()
        return self.postfix()

    def postfix(self) -> Expr:
        item = self.primary()
        while self.accept("["):
            key = self.disjunction()
            self.expect("]")
            if not isinstance(item, Ref):
                raise self.fail("only a named map can be looked up")
            item = Call("put", (key, Lit(item.name)))
        return item

    def primary(self) -> Expr:
        kind, text = self.peek()
        self.at += 1
        if kind == "num":
            return Lit(Decimal(text) if "." in text else int(text))
        if kind == "str":
            return Lit(text[1:-1])
        if kind == "dot":
            return Lit(None)
        if kind == "name":
            low = text.lower()
            if low in ("null", "true", "false"):
                return Lit({"null": None, "true": True, "false": False}[low])
            if self.peek() == ("op", "("):
                return self.call(low)
            if low not in KEYWORDS:
                return Ref(text)
        if (kind, text) == ("op", "("):
            inner = self.disjunction()
            self.expect(")")
            return inner
        raise self.fail(f"unexpected {text!r}" if text else "unexpected end")

    def call(self, name: str) -> Expr:
        if name not in FUNCTIONS:
            raise Refusal("E_UNSUPPORTED_FUNCTION", f"unsupported function {name!r}", self.line)
        self.expect("(")
        args: list[Expr] = []
        while not self.accept(")"):
            if args:
                self.expect(",")
            kind, text = self.peek()
            if name in ("put", "input") and len(args) == 1 and kind in ("fmt", "name"):
                self.at += 1
                args.append(Lit(text.removesuffix(".")))
                continue
            args.append(self.disjunction())
        least, most = FUNCTIONS[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise self.fail(f"wrong number of arguments of {name}")
        return Call(name, tuple(args))


def parse(text: str, legacy: bool = False, line: int | None = None) -> Expr:
    p = _Parser(text, legacy, line)
    if not p.items:
        raise p.fail("empty expression")
    out = p.disjunction()
    if p.at < len(p.items):
        raise p.fail(f"unexpected {p.peek()[1]!r}")
    return out


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, Binary):
        return (e.left, e.right)
    return e.args if isinstance(e, Logic | Call) else ()


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def references(e: Expr) -> list[str]:
    """Column names in order of first use."""
    return list(dict.fromkeys(x.name for x in walk(e) if isinstance(x, Ref)))


def substitute(e: Expr, values: dict[str, Expr]) -> Expr:
    if isinstance(e, Ref):
        return values.get(e.name, e)
    if isinstance(e, Binary):
        return Binary(e.op, substitute(e.left, values), substitute(e.right, values))
    if isinstance(e, Logic):
        return Logic(e.op, tuple(substitute(a, values) for a in e.args))
    if isinstance(e, Call):
        return Call(e.name, tuple(substitute(a, values) for a in e.args))
    return e


def to_json(e: Expr) -> dict:
    if isinstance(e, Lit):
        if isinstance(e.value, Decimal):
            return {"type": "decimal", "value": format(e.value, "f")}
        return {"type": "literal", "value": e.value}
    if isinstance(e, Ref):
        return {"type": "column", "name": e.name}
    if isinstance(e, Binary):
        return {"type": "binary", "op": e.op, "left": to_json(e.left), "right": to_json(e.right)}
    if isinstance(e, Logic):
        return {"type": "logic", "op": e.op, "args": [to_json(a) for a in e.args]}
    return {"type": "call", "name": e.name, "args": [to_json(a) for a in e.args]}


def from_json(d: dict) -> Expr:
    kind = d["type"]
    if kind == "decimal":
        return Lit(Decimal(d["value"]))
    if kind == "literal":
        return Lit(d["value"])
    if kind == "column":
        return Ref(d["name"])
    if kind == "binary":
        return Binary(d["op"], from_json(d["left"]), from_json(d["right"]))
    if kind == "logic":
        return Logic(d["op"], tuple(map(from_json, d["args"])))
    if kind == "call":
        return Call(d["name"], tuple(map(from_json, d["args"])))
    raise Refusal("E_BAD_EXPR", f"unknown node {kind!r}")


_LEVEL = {"or": 1, "and": 2, "not": 3, "+": 5, "-": 5, "*": 6, "/": 6} | dict.fromkeys(COMPARE, 4)


def to_text(e: Expr, outer: int = 0) -> str:
    """Source text with the fewest parentheses that parse back to the same tree."""
    if isinstance(e, Lit):
        v = e.value
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        return f'"{v}"' if isinstance(v, str) else format(v, "f") if isinstance(v, Decimal) else str(v)
    if isinstance(e, Ref):
        return e.name
    if isinstance(e, Call):
        return f"{e.name}({', '.join(map(to_text, e.args))})"
    level = _LEVEL[e.op]
    if isinstance(e, Binary):
        tight = level + 1
        text = f"{to_text(e.left, tight if e.op in COMPARE else level)} {e.op} {to_text(e.right, tight)}"
    elif e.op == "not":
        text = f"not {to_text(e.args[0], level)}"
    else:
        text = f" {e.op} ".join(to_text(a, level + 1) for a in e.args)
    return f"({text})" if level < outer else text
