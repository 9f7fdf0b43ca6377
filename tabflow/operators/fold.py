"""The DATA step's body row by row, for bodies that columns and windows can't express.

Expressions are compiled once a task to functions over a row's variables, with the static
types that ``functions.columns`` gives them, so both ways of running a body agree.  Rows
travel as Arrow batches: whole numbers, decimals and missing values keep their exact values.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import types as T

from tabflow.errors import runtime
from tabflow.functions.expr import COMPARE, Binary, Call, Expr, Lit, Logic, Ref
from tabflow.functions.types import NUMERIC, unify

#: Wide enough for products of two decimals of the widest type.
EXACT = Context(prec=80, rounding=ROUND_HALF_UP)
SCALE, NARROW = Decimal("1e-18"), Decimal("1e-6")
LONG = 1 << 63

Env = dict[str, object]
Row = Callable[[Env], object]


def _double_text(v: float) -> str:
    """A double as Spark prints it."""
    if math.isnan(v) or math.isinf(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        text = format(Decimal(repr(v)), "f")
        return text if "." in text else text + ".0"
    sign, digits, exponent = Decimal(repr(v)).normalize().as_tuple()
    shown = "".join(map(str, digits))
    return f"{'-' if sign else ''}{shown[0]}.{shown[1:] or '0'}E{exponent + len(shown) - 1}"


def text_of(v: object) -> str | None:
    """A value as the text that formats look up: decimals without trailing zeros."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Decimal):
        text = format(v, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return _double_text(v) if isinstance(v, float) else str(v)


def convert(v: object, kind: str) -> object:
    """A value as one of its type."""
    if v is None or kind in ("null", "unknown"):
        return v
    if kind == "float":
        return float(v)
    if kind == "decimal":
        exact = v if isinstance(v, Decimal) else Decimal(repr(v)) if isinstance(v, float) else Decimal(int(v))
        return exact.quantize(SCALE, context=EXACT)
    return int(v) if kind == "int" and not isinstance(v, Linear) else v


class Linear:
    """``a`` times a whole number that isn't known yet, and ``b`` more."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def __add__(self, o: Linear | int) -> Linear:
        return Linear(self.a + o.a, self.b + o.b) if isinstance(o, Linear) else Linear(self.a, self.b + o)

    def __mul__(self, o: int) -> Linear:
        return Linear(self.a * o, self.b * o)

    def __sub__(self, o: Linear | int) -> Linear:
        return self + o * -1

    def __rsub__(self, o: int) -> Linear:
        return self * -1 + o

    __radd__, __rmul__ = __add__, __mul__


def _whole(v: int) -> int:
    if not isinstance(v, Linear) and not -LONG <= v < LONG:
        raise OverflowError("ARITHMETIC_OVERFLOW: a whole number leaves 64 bits")
    return v


def _below(a: object, b: object, strict: bool) -> bool:
    """``a < b`` or ``a <= b``; missing is smallest, not-a-number largest."""
    if a is None:
        return b is not None or not strict
    if b is None:
        return False
    if a != a or b != b:
        return (b != b and (a == a or not strict))
    return a < b if strict else a <= b


def truth(v: object) -> bool:
    """Two-valued truth: missing is false, numbers are true unless 0, texts unless empty."""
    return v is not None and (bool(v) if isinstance(v, bool | int | float | Decimal | str) else True)


class RowCompiler:
    """Expressions as functions of a row's variables (by lower-case name), each with its type."""

    def __init__(self, kinds: Mapping[str, str], formats: Mapping[str, dict]):
        self.kinds, self.formats = {k.lower(): v for k, v in kinds.items()}, formats

    def __call__(self, e: Expr) -> tuple[Row, str]:
        if isinstance(e, Lit):
            value = e.value
            kind = "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "decimal" if isinstance(value, Decimal) else "string"
            return (lambda env: value), kind
        if isinstance(e, Ref):
            name = e.name.lower()
            return (lambda env: env.get(name)), self.kinds.get(name, "bool" if "." in name else "null")
        if isinstance(e, Logic):
            args = [self(a)[0] for a in e.args]
            if e.op == "not":
                return (lambda env: not truth(args[0](env))), "bool"
            over = all if e.op == "and" else any
            return (lambda env: over(truth(a(env)) for a in args)), "bool"
        if isinstance(e, Binary):
            return self.compare(e) if e.op in COMPARE else self.arithmetic(e)
        return self.call(e)

    def compare(self, e: Binary) -> tuple[Row, str]:
        (a, ka), (b, kb) = self(e.left), self(e.right)
        if ka != kb and "float" in (ka, kb):
            x, y = a, b
            a, b = (lambda env: convert(x(env), "float")), (lambda env: convert(y(env), "float"))
        if e.op in ("==", "!="):
            want = e.op == "=="

            def equal(env: Env) -> bool:
                p, q = a(env), b(env)
                return (p == q or (p != p and q != q)) == want

            return equal, "bool"
        if e.op in (">", ">="):
            a, b = b, a
        strict = e.op in ("<", ">")
        return (lambda env: _below(a(env), b(env), strict)), "bool"

    def arithmetic(self, e: Binary) -> tuple[Row, str]:
        (a, ka), (b, kb) = self(e.left), self(e.right)
        ka, kb = ("int" if k == "bool" else k for k in (ka, kb))
        if "null" in (ka, kb):
            other = kb if ka == "null" else ka
            return (lambda env: None), other if other in NUMERIC else "float"
        if ka == kb == "string":
            return _both(a, b, lambda p, q: p + q), "string"
        op = e.op
        if ka == kb == "int":
            if op == "/":
                return _both(a, b, lambda p, q: _ratio(float(p), float(q))), "float"
            return _both(a, b, lambda p, q: _whole(p + q if op == "+" else p - q if op == "-" else p * q)), "int"
        if "float" in (ka, kb):
            return _both(a, b, lambda p, q: _floats(op, float(p), float(q))), "float"
        # operands of products and quotients are narrowed as columns are
        cuts = [op in "*/" and k == "decimal" and not isinstance(side, Lit) for k, side in ((ka, e.left), (kb, e.right))]

        def decimals(p: object, q: object) -> Decimal:
            p, q = (EXACT.quantize(Decimal(v), NARROW) if cut else Decimal(v) for v, cut in zip((p, q), cuts, strict=True))
            if any(cut and abs(v) >= 10**12 for v, cut in zip((p, q), cuts, strict=True)):
                raise OverflowError("NUMERIC_VALUE_OUT_OF_RANGE: an operand of a product or quotient has over 12 digits")
            if op == "/" and not q:
                raise ZeroDivisionError("DIVIDE_BY_ZERO")
            made = EXACT.add(p, q) if op == "+" else EXACT.subtract(p, q) if op == "-" else EXACT.multiply(p, q) if op == "*" else EXACT.divide(p, q)
            return EXACT.quantize(made, SCALE)

        return _both(a, b, decimals), "decimal"

    def call(self, e: Call) -> tuple[Row, str]:
        if e.name in ("coalesce", "if"):
            parts = [self(a) for a in e.args]
            values = parts if e.name == "coalesce" else parts[1:]
            kind = "null"
            for _, k in values:
                kind = unify(kind, k)
            kind = "string" if kind == "null" else kind
            if e.name == "if":
                test, (yes, _), (no, _) = parts[0][0], *values
                return (lambda env: convert((yes if truth(test(env)) else no)(env), kind)), kind
            return (lambda env: convert(next((v for v in (f(env) for f, _ in values) if v is not None), None), kind)), kind
        value, kind = self(e.args[0])
        if e.name == "put":
            name = e.args[1].value
            found = self.formats.get(name) or self.formats.get(name.removeprefix("$")) or self.formats.get("$" + name)
            if found is None:
                raise runtime("FORMAT_UNDEFINED", f"no format {name!r}")
            held, other = found["map"], found.get("other")
            return (lambda env: held.get(text_of(value(env)), other)), "string"
        if kind in NUMERIC:
            return value, kind
        return (lambda env: number(text_of(value(env)))), "decimal"


def number(text: str | None) -> Decimal | None:
    """The number that a text spells plainly, else missing."""
    text = (text or "").strip(" ")
    bare = text[1:] if text[:1] in ("+", "-") else text
    if not bare or not bare.isascii() or not bare.replace(".", "", 1).isdigit():
        return None
    made = EXACT.quantize(Decimal(text), SCALE)
    return made if abs(made) < 10**20 else None


def _both(a: Row, b: Row, f: Callable[[object, object], object]) -> Row:
    def apply(env: Env) -> object:
        p, q = a(env), b(env)
        return None if p is None or q is None else f(p, q)

    return apply


def _ratio(p: float, q: float) -> float:
    if not q:
        raise ZeroDivisionError("DIVIDE_BY_ZERO")
    return p / q


def _floats(op: str, p: float, q: float) -> float:
    return p + q if op == "+" else p - q if op == "-" else p * q if op == "*" else _ratio(p, q)


class Program:
    """A body compiled for rows: variables are assigned as values of their types, in the order of statements."""

    def __init__(self, body: Sequence, kinds: Mapping[str, str], formats: Mapping[str, dict]):
        self.kinds = {k.lower(): v for k, v in kinds.items()}
        self.compile = RowCompiler(kinds, formats)
        self.steps = [self.statement(s) for s in body]

    def statement(self, s: object) -> Callable[[Env, Callable], bool]:
        """A function that runs a statement; false if the row ends there."""
        from tabflow.operators import datastep as D

        if isinstance(s, D.Assign):
            name, kind, value = s.name.lower(), self.kinds[s.name.lower()], self.compile(s.value)[0]

            def assign(env: Env, emit: Callable) -> bool:
                env[name] = convert(value(env), kind)
                return True

            return assign
        if isinstance(s, D.Subset):
            test = self.compile(s.test)[0]
            return lambda env, emit: truth(test(env))
        if isinstance(s, D.Output):

            def output(env: Env, emit: Callable) -> bool:
                emit(s.target)
                return True

            return output
        if isinstance(s, D.Loop):
            name, steps, n = s.name.lower(), [self.statement(x) for x in s.body], D.iterations(s)

            def loop(env: Env, emit: Callable) -> bool:
                for i in range(n):
                    env[name] = s.first + i * s.step
                    if not all(x(env, emit) for x in steps):
                        return False
                return True

            return loop
        cases = [(self.compile(e)[0], [self.statement(x) for x in b]) for e, b in s.cases]
        otherwise = None if s.otherwise is None else [self.statement(x) for x in s.otherwise]

        def branch(env: Env, emit: Callable) -> bool:
            found = next((b for e, b in cases if truth(e(env))), otherwise)
            if found is None:
                if s.required:
                    raise RuntimeError("SELECT_MISMATCH: no when matches and there is no otherwise")
                return True
            return all(x(env, emit) for x in found)

        return branch

    def run(self, env: Env, emit: Callable[[str | None], None]) -> bool:
        return all(x(env, emit) for x in self.steps)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _stored(v: object, kind: T.DataType) -> object:
    if v is not None and isinstance(kind, T.DecimalType):
        return EXACT.quantize(Decimal(v), Decimal(1).scaleb(-kind.scale))
    return v


class Runner:
    """Runs a program over Arrow batches.  ``state`` holds the retained variables from row to row."""

    #: Rows of an output batch, about.
    ROWS = 4096

    def __init__(self, body: Sequence, kinds: Mapping[str, str], formats: Mapping, schema: T.StructType, columns: Sequence[str], group: Mapping[str, str], retain: Sequence[str], names: Sequence[str], order: Sequence[str], explicit: bool):
        self.body, self.kinds, self.formats, self.schema = tuple(body), dict(kinds), dict(formats), schema
        self.columns, self.group, self.retain, self.names, self.order, self.explicit = list(columns), dict(group), list(retain), list(names), list(order), explicit
        self._program: Program | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_program": None}

    def rows(self, batches: Iterator[pa.RecordBatch], state: dict[str, object], stretch: str | None = None, given: str | None = None) -> Iterator[pa.RecordBatch]:
        """The rows' results.  Where the column ``stretch`` changes, the state is that of ``given``, in the order of ``retain``."""
        program = self._program = self._program or Program(self.body, self.kinds, self.formats)
        made = arrow_schema(self.schema)
        out: list[list] = []
        place, at = 0, None
        for batch in batches:
            for record in batch.to_pylist():
                if stretch is not None and (at is None or record[stretch] != at):
                    at = record[stretch]
                    state = dict(zip([r.lower() for r in self.retain], record[given] or [None] * len(self.retain), strict=True))
                env: Env = {c.lower(): record[c] for c in self.columns}
                env |= {k.lower(): record[v] for k, v in self.group.items()}
                env |= {r.lower(): state.get(r.lower()) for r in self.retain}

                def emit(target: str | None, env: Env = env, record: dict = record) -> None:
                    nonlocal place
                    out.append([*[env.get(n.lower()) for n in self.names], *[record[o] for o in self.order], place, target])
                    place += 1

                if program.run(env, emit) and not self.explicit:
                    emit(None)
                state.update({r.lower(): env[r.lower()] for r in self.retain})
                if len(out) >= self.ROWS:
                    yield self._batch(out, made)
                    out = []
        yield self._batch(out, made)

    def _batch(self, out: list[list], made: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * len(made)
        return pa.RecordBatch.from_arrays([pa.array([_stored(v, f.dataType) for v in c], type=a.type) for c, f, a in zip(cols, self.schema.fields, made, strict=True)], schema=made)


#: What a state comes to where the row fails for it; if it is so, the row fails when it runs.
FAILS = "fails"


def after(image: object, value: object) -> object:
    """An image, (of a missing state, of a whole number), of a value: missing, ``FAILS``, a number, or ``Linear`` of an earlier one."""
    if isinstance(value, str):
        return FAILS
    none, some = image
    if value is None:
        return none
    if not isinstance(some, Linear):
        return some
    return value * some.a + some.b


class Carrier:
    """What the rows of each stretch make of the states, whatever these were before; each depends on itself at most, linearly."""

    #: Images kept, by the values that a row's image depends on.
    KEPT = 10_000

    def __init__(self, body: Sequence, kinds: Mapping[str, str], formats: Mapping, columns: Sequence[str], group: Mapping[str, str], retain: Sequence[str], stretch: str):
        self.body, self.kinds, self.formats, self.stretch = tuple(body), dict(kinds), dict(formats), stretch
        self.inputs = [(c.lower(), c) for c in columns] + [(k.lower(), v) for k, v in group.items()]
        self.states = [r.lower() for r in retain]

    def images(self, program: Program, values: tuple) -> list[tuple]:
        """Of each state, what the row makes of a missing one and of a number."""
        made = []
        for before in (None, Linear(1, 0)):
            env: Env = {n: v for (n, _), v in zip(self.inputs, values, strict=True)} | dict.fromkeys(self.states, before)
            try:
                program.run(env, lambda target: None)
                made.append([env[s] for s in self.states])
            except Exception:  # noqa: BLE001 - the row fails, with this error, only if the state is so
                made.append([FAILS] * len(self.states))
        return list(zip(*made, strict=True))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each stretch: its number and the pickled images."""
        program, kept, at, total = Program(self.body, self.kinds, self.formats), {}, None, []
        for batch in batches:
            stretches = batch.column(self.stretch).to_pylist()
            columns = [batch.column(c).to_pylist() for _, c in self.inputs]
            for place, values in zip(stretches, zip(*columns, strict=True) if columns else [()] * len(stretches), strict=True):
                if place != at:
                    if at is not None:
                        yield self.batch(at, total)
                    at, total = place, [(None, Linear(1, 0))] * len(self.states)
                found = kept.get(values)
                if found is None:
                    found = self.images(program, values)
                    if len(kept) < self.KEPT:
                        kept[values] = found
                total = [(after(f, none), after(f, some)) for f, (none, some) in zip(found, total, strict=True)]
        if at is not None:
            yield self.batch(at, total)

    @staticmethod
    def batch(at: int, total: list[tuple]) -> pa.RecordBatch:
        plain = [[(v.a, v.b) if isinstance(v, Linear) else v for v in image] for image in total]
        return pa.RecordBatch.from_pydict({"stretch": pa.array([at], pa.int32()), "images": pa.array([pickle.dumps(plain)], pa.binary())})

    def given(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states that each stretch is handed, from the stretches in order."""
        states: list = [None] * len(self.states)
        for batch in batches:
            for record in batch.to_pylist():
                # what leaves 64 bits or fails does so in an earlier stretch, when its rows run
                shown = [v if isinstance(v, int) and -LONG <= v < LONG else None for v in states]
                yield pa.RecordBatch.from_pydict({"stretch": pa.array([record["stretch"]], pa.int32()), "given": pa.array([shown], pa.list_(pa.int64()))})
                images = [tuple(Linear(*v) if isinstance(v, tuple) else v for v in i) for i in pickle.loads(record["images"])]  # noqa: S301 - written by ``batch``
                states = [after(i, v) for i, v in zip(images, states, strict=True)]
