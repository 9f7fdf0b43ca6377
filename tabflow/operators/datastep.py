"""The DATA step's body as columns: control flow, group flags, retained state, and several outputs.

The body is executed symbolically.  Each assignment becomes a column under the condition
that leads to it; what a row inherits from the row before (``retain``) is solved by windows
where the state is set, or set and added to; other bodies fall back to a sequential fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.errors import Refusal, invalid
from tabflow.functions.columns import Compiler, Typed, literal, truthy
from tabflow.functions.expr import Binary, Call, Expr, Lit, Logic, Ref, references
from tabflow.functions.types import spark_type, unify
from tabflow.operators.fold import Carrier, RowCompiler, Runner
from tabflow.relation import Relation, hidden_name
from tabflow.workers import importable

#: Limits of the language.
MAX_DEPTH, MAX_ITERATIONS = 50, 1_000_000
#: Loops of at most so many statements in all are unrolled.
UNROLL = 256


@dataclass(frozen=True)
class Assign:
    name: str
    value: Expr
    line: int | None = None


@dataclass(frozen=True)
class Subset:
    """``if p;``: rows for which it is false end here."""

    test: Expr
    line: int | None = None


@dataclass(frozen=True)
class Branch:
    """``if``/``else`` chains and ``select``.  ``required``: no match and no otherwise is an error."""

    cases: tuple[tuple[Expr, tuple[Stmt, ...]], ...]
    otherwise: tuple[Stmt, ...] | None = None
    required: bool = False
    line: int | None = None


@dataclass(frozen=True)
class Loop:
    name: str
    first: int
    last: int
    step: int
    body: tuple[Stmt, ...]
    line: int | None = None


@dataclass(frozen=True)
class Output:
    target: str | None = None
    line: int | None = None


Stmt = Assign | Subset | Branch | Loop | Output


@dataclass
class Step:
    """A DATA step: its outputs, the statements after set or merge, and its declarations."""

    outputs: list[str]
    body: list[Stmt]
    by: list[str] = field(default_factory=list)
    retain: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    rename: list[tuple[str, str]] = field(default_factory=list)
    line: int | None = None


def statements(body: Sequence[Stmt]) -> Iterator[Stmt]:
    for s in body:
        yield s
        if isinstance(s, Branch):
            for _, b in s.cases:
                yield from statements(b)
            yield from statements(s.otherwise or ())
        elif isinstance(s, Loop):
            yield from statements(s.body)


def expressions(body: Sequence[Stmt]) -> Iterator[Expr]:
    for s in statements(body):
        if isinstance(s, Assign):
            yield s.value
        elif isinstance(s, Subset):
            yield s.test
        elif isinstance(s, Branch):
            for e, _ in s.cases:
                yield e


def _weight(body: Sequence[Stmt]) -> int:
    """Statements that the body comes to when its loops are unrolled."""
    total = 0
    for s in body:
        if isinstance(s, Loop):
            total += iterations(s) * (1 + _weight(s.body))
        elif isinstance(s, Branch):
            total += 1 + sum(_weight(b) for _, b in s.cases) + _weight(s.otherwise or ())
        else:
            total += 1
    return total


def iterations(s: Loop) -> int:
    if s.step == 0:
        raise invalid("LOOP_STEP", "a loop's step mustn't be 0", s.line)
    return max(0, (s.last - s.first) // s.step + 1)


def check(body: Sequence[Stmt], depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise invalid("CONTROL_DEPTH", f"control flow nested more than {MAX_DEPTH} deep")
    for s in body:
        if isinstance(s, Loop):
            if iterations(s) > MAX_ITERATIONS:
                raise invalid("LOOP_LIMIT", f"more than {MAX_ITERATIONS} iterations", s.line)
            check(s.body, depth + 1)
        elif isinstance(s, Branch):
            for _, b in s.cases:
                check(b, depth + 1)
            check(s.otherwise or (), depth + 1)


def flags(rel: Relation, by: Sequence[str], wanted: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns for ``first.k`` and ``last.k``: a row's prefix of keys differs from the row before or after it."""
    df, made = rel.df, {}
    keys = [rel.resolve(k) for k in by]
    for i, k in enumerate(keys):
        window = Window.partitionBy(*[rel.col(x) for x in keys[: i + 1]]).orderBy(*rel.order_columns(keys[: i + 1]))
        for word, value in (("first", F.row_number().over(window) == 1), ("last", F.lead(F.lit(1)).over(window).isNull())):
            name = f"{word}.{by[i].lower()}"
            if name in wanted:
                made[name] = hidden_name("g")
                df = df.withColumn(made[name], value)
    return df, made


class Symbolic:
    """One symbolic run over ``df``; values of variables are columns of it."""

    def __init__(self, df: DataFrame, env: dict[str, Typed], formats: Mapping, taint: Mapping[str, set[str]]):
        self.df, self.env, self.formats = df, dict(env), formats
        self.alive: Column = F.lit(True)
        self.certain = True  # alive is still the constant true
        self.taint = {k: set(v) for k, v in taint.items()}
        self.alive_taint: set[str] = set()
        self.emitted: list[tuple[Column, str | None, dict[str, Typed]]] = []
        self.carry: dict[str, dict] = {}
        self.nonlinear = False

    def lookup(self, name: str) -> Typed:
        for k in (name, name.lower()):
            if k in self.env:
                return self.env[k]
        near = [k for k in self.env if k.lower() == name.lower()]
        return self.env[near[0]] if near else literal(None)

    def own(self, name: str) -> str:
        return next((k for k in self.env if k.lower() == name.lower()), name)

    def compile(self, e: Expr, line: int | None) -> Typed:
        return Compiler(self.lookup, self.formats, line=line)(e)

    def depends(self, e: Expr) -> set[str]:
        return {t for r in references(e) for t in self.taint.get(self.own(r), ())}

    def kept(self, value: Typed) -> Typed:
        """The value as a column of the table, so that later expressions don't repeat it."""
        name = hidden_name("v")
        col = value.col.cast("string") if value.type == "null" else value.col
        self.df = self.df.withColumn(name, col)
        return Typed(F.col(name), value.type, value.literal)

    def run(self, body: Sequence[Stmt], guard: Column | None, guard_taint: set[str]) -> None:
        for s in body:
            if isinstance(s, Assign):
                self.assign(s, guard, guard_taint)
            elif isinstance(s, Subset):
                test = truthy(self.compile(s.test, s.line))
                ok = test if guard is None else ~guard | test
                self.alive = self.kept(Typed(ok if self.certain else self.alive & ok, "bool")).col
                self.certain = False
                self.alive_taint |= self.depends(s.test) | guard_taint
            elif isinstance(s, Branch):
                self.branch(s, guard, guard_taint)
            elif isinstance(s, Loop):
                for i in range(iterations(s)):
                    name = self.own(s.name)
                    self.assign(Assign(name, Lit(s.first + i * s.step), s.line), guard, guard_taint)
                    self.run(s.body, guard, guard_taint)
            else:
                now = self.active(guard)
                self.emitted.append((now if now is not None else F.lit(True), s.target, dict(self.env)))

    def active(self, guard: Column | None) -> Column | None:
        """The condition of reaching this place; None if it is always reached."""
        if guard is None:
            return None if self.certain else self.alive
        return guard if self.certain else guard & self.alive

    def branch(self, s: Branch, guard: Column | None, guard_taint: set[str]) -> None:
        none = None  # no case so far
        seen = set(guard_taint)
        for e, body in s.cases:
            test = truthy(self.compile(e, s.line))
            seen |= self.depends(e)
            here = test if none is None else none & test
            here = self.kept(Typed(here if guard is None else guard & here, "bool")).col
            rest = ~test if none is None else none & ~test
            none = self.kept(Typed(rest, "bool")).col
            self.run(body, here, seen)
        if s.otherwise is not None:
            self.run(s.otherwise, none if guard is None else guard & none, seen)
        elif s.required:
            reached = self.active(none if guard is None else guard & none)
            fail = F.when(reached, F.raise_error(F.lit("SELECT_MISMATCH: no when matches and there is no otherwise")).cast("boolean")).otherwise(F.lit(True))
            checked = self.kept(Typed(fail, "bool")).col
            self.alive, self.certain = (checked if self.certain else self.alive & checked), False

    def assign(self, s: Assign, guard: Column | None, guard_taint: set[str]) -> None:
        name = self.own(s.name)
        value = self.compile(s.value, s.line)
        when = self.active(guard)
        taint = self.depends(s.value) | guard_taint | self.alive_taint
        if name in self.carry:
            self.track(name, s, value, when, guard_taint | self.alive_taint)
        old = self.env.get(name)
        if when is not None:
            kind = unify(value.type, old.type if old else "null", s.line)
            before = old.cast(kind).col if old else F.lit(None).cast(spark_type(kind))
            value = Typed(F.when(when, value.cast(kind).col).otherwise(before), kind)
            taint |= self.taint.get(name, set())
        elif old is not None and old.type != value.type and value.type == "null":
            value = value.cast(old.type)
        self.env[name] = self.kept(value)
        self.taint[name] = taint

    def track(self, name: str, s: Assign, value: Typed, when: Column | None, control: set[str]) -> None:
        """Keep a retained variable as (set to, then added to), as long as it is only set and added to."""
        c = self.carry[name]
        if control:
            self.nonlinear = True
            return
        now = when if when is not None else F.lit(True)
        e = s.value
        parts = (e.left, e.right) if isinstance(e, Binary) and e.op == "+" else ()
        own = [p for p in parts if isinstance(p, Ref) and self.own(p.name) == name]
        added = next((p for p in parts if not (isinstance(p, Ref) and self.own(p.name) == name)), None)
        if not self.depends(e):
            c["set"] = self.kept(Typed(c["set"] | now, "bool")).col
            kind = unify(c["value"].type, value.type, s.line)
            c["value"] = self.kept(Typed(F.when(now, value.cast(kind).col).otherwise(c["value"].cast(kind).col), kind))
            if c["add"] is not None:
                c["add"] = self.kept(Typed(F.when(now, F.lit(0).cast(spark_type(c["add"].type))).otherwise(c["add"].col), c["add"].type))
        elif len(own) == 1 and added is not None and not self.depends(added):
            more = self.compile(added, s.line)
            kind = unify(more.type, c["add"].type if c["add"] else "null", s.line)
            zero = F.lit(0).cast(spark_type(kind))
            before = c["add"].cast(kind).col if c["add"] else zero
            c["add"] = self.kept(Typed(F.when(now, before + more.cast(kind).col).otherwise(before), kind))
        else:
            self.nonlinear = True


def execute(rel: Relation, step: Step, formats: Mapping | None = None) -> dict[str, Relation]:
    """Run the body over ``rel``; a relation for each output."""
    formats = formats or {}
    check(step.body)
    names = {n.lower(): n for n in rel.columns}
    retain = [names.get(r.lower(), r) for r in step.retain]
    retain = [r for r in retain if r not in rel.columns]  # a column of the input wins over the state
    used = {r.lower() for e in expressions(step.body) for r in references(e)}
    wanted = {u for u in used if u.startswith(("first.", "last."))}
    for w in wanted:
        if w.partition(".")[2] not in {b.lower() for b in step.by}:
            raise invalid("BY_FLAG_UNDEFINED", f"{w} needs its variable in by", step.line)
    df, group = flags(rel, step.by, wanted)
    base = Relation(df, rel.columns, rel.order, rel.unique)
    env = {c: rel.typed(c) for c in rel.columns} | {k: Typed(F.col(v), "bool") for k, v in group.items()}
    if _weight(step.body) > UNROLL:
        return fold(base, group, step, retain, formats)
    active = [r for r in retain if any(isinstance(s, Assign | Loop) and s.name.lower() == r.lower() for s in statements(step.body))]
    if active:
        state = solve(base, env, step, active, formats)
        if state is None:
            return fold(base, group, step, retain, formats)
        base, previous = state
        env |= previous
    for r in retain:
        env.setdefault(r, Typed(F.lit(None).cast("double"), "float"))
    run = Symbolic(base.df, env, formats, {})
    run.run(step.body, None, set())
    return emit(base, run, step, list(rel.columns), retain, explicit=any(isinstance(s, Output) for s in statements(step.body)))


def solve(rel: Relation, env: dict[str, Typed], step: Step, active: list[str], formats: Mapping) -> tuple[Relation, dict[str, Typed]] | None:
    """Columns with the state that each row inherits, or None if it isn't a matter of setting and adding.

    A variable that a row sets keeps the value until the next row that sets it; what rows add
    in between is a running sum, which a missing addend makes missing.  If a plain ``if
    first.k`` sets every variable, groups are independent and so are the windows.
    """
    trial = Symbolic(rel.df, env, formats, {r: {r} for r in active})
    kinds = {r: "null" for r in active}
    for _ in range(2):  # once to learn the types of the states, and once with them
        trial = Symbolic(rel.df, env, formats, {r: {r} for r in active})
        for r in active:
            kind = kinds[r] if kinds[r] != "null" else "float"
            trial.env[r] = Typed(F.lit(None).cast(spark_type(kind)), kind)
            trial.carry[r] = {"set": F.lit(False), "value": Typed(F.lit(None).cast(spark_type(kinds[r])) if kinds[r] != "null" else F.lit(None), kinds[r]), "add": None}
        try:
            trial.run(step.body, None, set())
        except Refusal as e:
            if kinds == {r: "null" for r in active} and e.code == "E_TYPE":
                return None
            raise
        for r in active:
            c = trial.carry[r]
            kinds[r] = unify(c["value"].type, c["add"].type if c["add"] else "null")
    if trial.nonlinear:
        return None
    df = trial.df
    depth = max((reset_depth(step, r) for r in active), default=0) if all(reset_depth(step, r) for r in active) else 0
    names = [rel.resolve(k) for k in step.by[:depth]]
    if not names and (place := stretch(rel)) is not None:
        return in_stretches(rel, df, trial, active, kinds, place)
    keys = [rel.col(n) for n in names]
    order = rel.order_columns(names)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    previous = {}
    for r in active:
        c, kind = trial.carry[r], kinds[r] if kinds[r] != "null" else "float"
        spark = spark_type(kind)
        held = hidden_name("s")
        df = df.withColumn(held, F.last(F.when(c["set"], F.struct(c["value"].col.cast(spark).alias("v"))), ignorenulls=True).over(upto))
        after = F.col(held)["v"]
        if c["add"] is not None:
            part = hidden_name("p")
            df = df.withColumn(part, F.sum(c["set"].cast("int")).over(upto))
            since = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            add = c["add"].col
            missing = F.max(add.isNull().cast("int")).over(since) > 0
            after = F.when(missing, F.lit(None).cast(spark)).otherwise((F.col(held)["v"] + F.sum(F.coalesce(add, F.lit(0))).over(since)).cast(spark))
        done, before = hidden_name("a"), hidden_name("b")
        df = df.withColumn(done, after)
        df = df.withColumn(before, F.lag(done).over(Window.partitionBy(*keys).orderBy(*order)))
        previous[r] = Typed(F.col(before), kind)
    return rel.with_columns(df, rel.columns), previous


#: Stretches of the order that a state is carried over, so that no task sees all rows.
STRETCHES = 256


def stretch(rel: Relation) -> Column | None:
    """The number of the row's stretch of the order, by the first order column; None if that has no cuts."""
    if not rel.order:
        return None
    first = rel.col(rel.order[0])
    if not isinstance(rel.df.schema[rel.order[0]].dataType, T.IntegralType | T.FractionalType):
        return None
    found = rel.df.agg(F.percentile_approx(first.cast("double"), [i / STRETCHES for i in range(1, STRETCHES)], 10_000).alias("b")).first()["b"]
    cuts = F.array(*[F.lit(c) for c in sorted({c for c in found or [] if c == c})])
    # missing comes first; not-a-number, which orders last, is above all cuts
    return F.when(first.isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < first.cast("double"))))


def in_stretches(rel: Relation, df: DataFrame, trial: Symbolic, active: list[str], kinds: dict[str, str], place: Column) -> tuple[Relation, dict[str, Typed]]:
    """States that no group resets: solved within each stretch of the order, and carried from stretch to stretch.

    Of a stretch only what it hands on meets in one task: whether it sets the state, to
    what, and what it adds; a row for each stretch.
    """
    at = hidden_name("z")
    df = df.withColumn(at, place)
    order = rel.order_columns()
    upto = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before, previous = Window.partitionBy(at).orderBy(*order), {}
    for r in active:
        c, kind = trial.carry[r], kinds[r] if kinds[r] != "null" else "float"
        spark = spark_type(kind)
        held, part, added, lost, own = (hidden_name(t) for t in ("s", "p", "d", "l", "w"))
        df = df.withColumn(held, F.last(F.when(c["set"], F.struct(c["value"].col.cast(spark).alias("v"))), ignorenulls=True).over(upto))
        df = df.withColumn(part, F.sum(c["set"].cast("int")).over(upto))
        since = Window.partitionBy(at, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        add = c["add"].col if c["add"] is not None else F.lit(0).cast(spark)
        df = df.withColumn(added, F.sum(F.coalesce(add, F.lit(0))).over(since)).withColumn(lost, F.max(add.isNull().cast("int")).over(since) > 0)
        # what a stretch hands on, and what it is handed: the last state set before it, and all that was added since
        last = df.groupBy(at).agg(F.max_by(F.struct(held, added, lost), F.struct(*[F.col(f"`{o}`") for o in rel.order])).alias("x")).select(at, *[F.col("x")[n].alias(n) for n in (held, added, lost)])
        over = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        group = hidden_name("y")
        run = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        sets = last.withColumn(group, F.sum(F.col(held).isNotNull().cast("int")).over(over)).withColumn(own, F.last(held, ignorenulls=True).over(over))
        sums = sets.withColumn(added, F.sum(added).over(run)).withColumn(lost, F.max(lost).over(run))
        after = hidden_name("q")
        given = sums.select(at, F.lag(F.struct(F.col(own).alias("s"), F.col(added).alias("d"), F.col(lost).alias("l"))).over(Window.orderBy(at)).alias(after))
        df = df.join(F.broadcast(given), at)  # a row for each of at most STRETCHES + 1 stretches
        mine = F.col(held).isNotNull()
        state = F.when(mine, F.col(held)["v"]).otherwise(F.col(after)["s"]["v"])
        total = F.when(mine, F.col(added)).otherwise(F.col(added) + F.col(after)["d"])
        gone = F.when(mine, F.col(lost)).otherwise(F.col(lost) | F.col(after)["l"])
        value = state if c["add"] is None else F.when(gone, F.lit(None).cast(spark)).otherwise((state + total).cast(spark))
        done, old = hidden_name("a"), hidden_name("b")
        df = df.withColumn(done, value)
        # the row before, or for the first of a stretch what the stretches before it came to
        given_state = F.col(after)["s"]["v"]
        first = given_state if c["add"] is None else F.when(F.col(after)["l"], F.lit(None).cast(spark)).otherwise((given_state + F.col(after)["d"]).cast(spark))
        df = df.withColumn(old, F.when(F.row_number().over(before) == 1, first).otherwise(F.lag(done).over(before)))
        previous[r] = Typed(F.col(old), kind)
    return rel.with_columns(df, rel.columns), previous


def reset_depth(step: Step, name: str) -> int:
    """How many by keys a top-level ``if first.k then v = <without v>`` spans, before anything reads v; 0 if none does."""
    by = [b.lower() for b in step.by]
    for s in step.body:
        if isinstance(s, Branch) and len(s.cases) == 1 and isinstance(s.cases[0][0], Ref):
            word = s.cases[0][0].name.lower()
            body = s.cases[0][1]
            for t in body:
                if isinstance(t, Assign) and t.name.lower() == name.lower() and word.startswith("first.") and name.lower() not in {r.lower() for r in references(t.value)}:
                    return by.index(word.removeprefix("first.")) + 1
        if name.lower() in {r.lower() for e in expressions([s]) for r in references(e)} or isinstance(s, Subset | Output):
            return 0
    return 0


def finish(rel: Relation, step: Step, columns: list[str], produced: Sequence[str]) -> list[str]:
    """The names of an output row: kept, or all but dropped ones and group flags."""
    names = list(dict.fromkeys([*columns, *produced]))
    low = {n.lower(): n for n in names}
    if step.keep:
        missing = [k for k in step.keep if k.lower() not in low and not k.lower().startswith(("first.", "last."))]
        if missing:
            raise invalid("E_UNKNOWN_COLUMN", f"keep names {missing[0]!r}, which the step doesn't have", step.line)
        names = [low[k.lower()] for k in step.keep if k.lower() in low]
    gone = {d.lower() for d in step.drop}
    return [n for n in names if n.lower() not in gone]


def emit(rel: Relation, run: Symbolic, step: Step, columns: list[str], retain: list[str], explicit: bool) -> dict[str, Relation]:
    """Filter for one emission per row, an exploded array of structs for several."""
    made = [n for n in dict.fromkeys([*retain, *run.env]) if n not in columns and "." not in n]
    names = finish(rel, step, columns, made)
    new = {a.lower(): b for a, b in step.rename}
    final = [new.get(n.lower(), n) for n in names]
    emitted = run.emitted if explicit else [(run.alive, None, run.env)]
    out = {}
    for target in step.outputs:
        own = [(g, env) for g, t, env in emitted if t is None or t.lower() == target.lower()]
        kinds = {}
        for n in names:
            kind = "null"
            for _, env in own:
                kind = unify(kind, env[n].type if n in env else "null", step.line)
            kinds[n] = kind

        def value(env: dict[str, Typed], n: str, kinds: dict[str, str] = kinds) -> Column:
            found = env.get(n)
            if found is None or found.type == "null":
                return F.lit(None).cast("string" if kinds[n] == "null" else spark_type(kinds[n]))
            return found.col if kinds[n] == "unknown" else found.cast(kinds[n]).col

        base = rel.protected(list(names) + final)
        df = run.df if base.df is rel.df else run.df.withColumns({o: F.col(f"`{a}`") for a, o in zip(rel.order, base.order, strict=True) if a != o})
        order = [F.col(f"`{o}`").alias(f"__tf_e{i}") for i, o in enumerate(base.order)]
        tags = [f"__tf_e{i}" for i in range(len(base.order))]
        if len(own) == 1:
            g, env = own[0]
            df = df.where(g).select(*[value(env, n).alias(f) for n, f in zip(names, final, strict=True)], *order)
            place = tuple(tags)
        else:
            rows = [F.when(g, F.struct(*[value(env, n).alias(f"c{i}") for i, n in enumerate(names)])) for g, env in own]
            if rows:
                df = df.select(F.posexplode(F.array_compact(F.array(*rows))).alias("__tf_at", "__tf_row"), *order)
            else:
                df = df.where(F.lit(False)).select(F.lit(0).alias("__tf_at"), F.struct(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(len(names))]).alias("__tf_row"), *order)
            df = df.select(*[F.col(f"__tf_row.c{i}").alias(f) for i, f in enumerate(final)], *tags, "__tf_at")
            place = (*tags, "__tf_at")
        fresh = {t: hidden_name("o") for t in place}
        df = df.select(*[F.col(f"`{f}`") for f in final], *[F.col(t).alias(n) for t, n in fresh.items()])
        # where an order column is kept as it is, later steps see the order by its name
        written = {s.name.lower() for s in statements(step.body) if isinstance(s, Assign | Loop)}
        order_names = []
        for o, t in zip(rel.order, tags, strict=True):
            same = o in names and new.get(o.lower(), o) == o and o.lower() not in written
            order_names.append(o if same else fresh[t])
        if "__tf_at" in place:
            order_names.append(fresh["__tf_at"])
        out[target] = Relation(df, tuple(final), tuple(order_names))
    return out


# --- the sequential fold -----------------------------------------------------------------


def evaluate(e: Expr, get: Callable[[str], object], formats: Mapping) -> object:
    """One expression over named Python values, with the same meaning as the columns."""
    from tabflow.functions.columns import literal

    names = {r: get(r) for r in references(e)}
    return RowCompiler({n: literal(v).type for n, v in names.items()}, formats)(e)[0]({n.lower(): v for n, v in names.items()})


def sliced(body: Sequence[Stmt], wanted: set[str]) -> tuple[Stmt, ...]:
    """The statements that set one of these variables, with the control flow around them, and those that end rows."""
    out: list[Stmt] = []
    for s in body:
        if isinstance(s, Branch):
            cases, otherwise = tuple((e, sliced(b, wanted)) for e, b in s.cases), None if s.otherwise is None else sliced(s.otherwise, wanted)
            if otherwise or any(b for _, b in cases):
                out.append(replace(s, cases=cases, otherwise=otherwise))
        elif isinstance(s, Loop):
            inner = sliced(s.body, wanted)
            if inner or s.name.lower() in wanted:
                out.append(replace(s, body=inner))
        elif isinstance(s, Subset) or (isinstance(s, Assign) and s.name.lower() in wanted):
            out.append(s)
    return tuple(out)


class _NotLinear(Exception):
    pass


def linear(body: Sequence[Stmt], retain: Sequence[str], kinds: Mapping[str, str], formats: Mapping) -> tuple[Stmt, ...] | None:
    """What of the body the states depend on, if a row makes of each whole-number state a multiple of itself and a sum; else None."""
    wanted = {r.lower() for r in retain}
    while (more := wanted | {r.lower() for e in expressions(sliced(body, wanted)) for r in references(e)}) != wanted:
        wanted = more
    cut = sliced(body, wanted)
    kind_of = RowCompiler(kinds, formats)
    held: dict[str, frozenset[str]] = {r.lower(): frozenset([r.lower()]) for r in retain}

    def states(e: Expr) -> frozenset[str]:
        """The states that the expression is linear in."""
        if isinstance(e, Lit):
            return frozenset()
        if isinstance(e, Ref):
            found = held.get(e.name.lower(), frozenset())
        else:
            parts = [states(x) for x in (e.args if isinstance(e, Logic | Call) else (e.left, e.right))]
            found = frozenset().union(*parts)
            sums = isinstance(e, Binary) and (e.op in ("+", "-") or (e.op == "*" and not all(parts)))
            choices = isinstance(e, Call) and (e.name == "coalesce" or (e.name == "if" and not parts[0]))
            if found and not (sums or choices):
                raise _NotLinear
        if found and kind_of(e)[1] != "int":
            raise _NotLinear
        return found

    def walk(part: Sequence[Stmt], always: bool) -> None:
        for s in part:
            if isinstance(s, Assign):
                name, made = s.name.lower(), states(s.value)
                held[name] = made if always else made | held.get(name, frozenset())
                if held[name] and kind_of(Ref(name))[1] != "int":
                    raise _NotLinear
            elif isinstance(s, Subset):
                always = False
                if states(s.test):
                    raise _NotLinear
            elif isinstance(s, Branch):
                for e, inner in s.cases:
                    if states(e):
                        raise _NotLinear
                    walk(inner, False)
                walk(s.otherwise or (), False)
            else:
                for _ in range(len(held) + len(wanted) + 1):  # what is handed from one variable to the next has come through
                    held[s.name.lower()] = held.get(s.name.lower(), frozenset())
                    walk(s.body, False)

    try:
        walk(cut, True)
    except _NotLinear:
        return None
    return cut if all(held[r.lower()] <= {r.lower()} for r in retain) else None


def carried(df: DataFrame, place: Column, runner: Runner, body: Sequence[Stmt], order: list[Column]) -> tuple[DataFrame, str, str]:
    """Rows in stretches of the order, each of which knows the states that it is handed; and the columns of both.

    Stretches are run twice: first for what they make of any state, of which a row each
    meets in one task, then from the state that they are handed.
    """
    at, given = hidden_name("z"), hidden_name("y")
    used = {r.lower() for e in expressions(body) for r in references(e)}
    carrier = Carrier(body, runner.kinds, runner.formats, [c for c in runner.columns if c.lower() in used], {k: v for k, v in runner.group.items() if k.lower() in used}, runner.retain, at)
    df = df.withColumn(at, place.cast("int"))
    made = df.repartition(F.col(at)).sortWithinPartitions(at, *order).select(at, *dict.fromkeys(c for _, c in carrier.inputs)).mapInArrow(carrier.rows, "stretch int, images binary")
    states = made.repartition(1).sortWithinPartitions("stretch").mapInArrow(carrier.given, "stretch int, given array<bigint>")
    states = states.select(F.col("stretch").alias(at), F.col("given").alias(given))
    return df.join(F.broadcast(states), at).repartition(F.col(at)).sortWithinPartitions(at, *order), at, given  # a row for each of at most STRETCHES + 1 stretches


def fold(rel: Relation, group: dict[str, str], step: Step, retain: list[str], formats: Mapping) -> dict[str, Relation]:
    """Run the body row by row.  Without state rows are independent; with it, rows of a by group are if every state is
    reset at its first row, and stretches of the order if each state is multiplied and added to; else all rows go
    through one task in order."""
    importable(rel.df.sparkSession)
    kinds, words = infer(rel, step, retain, formats)
    names = finish(rel, step, list(rel.columns), [n for n in kinds if n not in rel.columns])
    schema = T.StructType([*[T.StructField(f"c{i}", kinds[n]) for i, n in enumerate(names)], *[T.StructField(f"o{i}", rel.df.schema[o].dataType) for i, o in enumerate(rel.order)], T.StructField("at", T.LongType()), T.StructField("target", T.StringType())])
    explicit = any(isinstance(s, Output) for s in statements(step.body))
    read = {n.lower() for n in names} | {r.lower() for e in expressions(step.body) for r in references(e)} | {s.name.lower() for s in statements(step.body) if isinstance(s, Assign | Loop)}
    columns, order = [c for c in rel.columns if c.lower() in read], list(rel.order)
    runner = Runner(step.body, words, formats, schema, columns, group, retain, names, order, explicit)
    depth = min((reset_depth(step, r) for r in retain), default=0) if retain else 0
    keys = [F.col(f"`{rel.resolve(k)}`") for k in step.by[:depth]]
    needed = dict.fromkeys([*columns, *order, *group.values(), *[rel.resolve(k) for k in step.by[:depth]]])
    df = rel.df.select(*[F.col(f"`{c}`") for c in needed])
    body = linear(step.body, retain, words, formats) if retain and not depth else None
    if not retain:
        df = df.mapInArrow(lambda it: runner.rows(it, {}), schema)
    elif body is not None and (place := stretch(rel)) is not None:
        df, at, given = carried(df, place, runner, body, rel.order_columns())
        df = df.mapInArrow(lambda it: runner.rows(it, {}, at, given), schema)
    else:
        # a group starts anew where its by keys change: its state is set there before it is read,
        # so the rows of a partition pass one by one and no group is held whole
        df = df.repartition(*keys) if keys else df.repartition(1)
        df = df.sortWithinPartitions(*[k.asc_nulls_first() for k in keys], *rel.order_columns()).mapInArrow(lambda it: runner.rows(it, {}), schema)
    new = {a.lower(): b for a, b in step.rename}
    final = [new.get(n.lower(), n) for n in names]
    fresh = [hidden_name("o") for _ in (*order, "at")]
    out = {}
    for target in step.outputs:
        own = df.where(F.col("target").isNull() | (F.lower("target") == target.lower()))
        out[target] = Relation(own.select(*[F.col(f"c{i}").alias(f) for i, f in enumerate(final)], *[F.col(c).alias(n) for c, n in zip([*[f"o{i}" for i in range(len(order))], "at"], fresh, strict=True)]), tuple(final), tuple(fresh))
    return out


def infer(rel: Relation, step: Step, retain: list[str], formats: Mapping) -> tuple[dict[str, T.DataType], dict[str, str]]:
    """Types of all variables, to a fixed point over the body's assignments: as Spark's and by name."""
    kinds: dict[str, str] = dict.fromkeys(retain, "null")
    known = {c: rel.typed(c) for c in rel.columns}

    def lookup(name: str) -> Typed:
        for k, v in known.items():
            if k.lower() == name.lower() and k not in written:
                return v
        kind = next((v for k, v in kinds.items() if k.lower() == name.lower()), "bool" if "." in name else "null")
        return Typed(F.lit(None).cast(spark_type(kind if kind != "unknown" else "string")), kind)

    written = list(dict.fromkeys(next((c for c in rel.columns if c.lower() == s.name.lower()), s.name) for s in statements(step.body) if isinstance(s, Assign | Loop)))
    for w in written:
        kinds.setdefault(w, known[w].type if w in known else "null")
    for _ in range(4):
        for s in statements(step.body):
            if isinstance(s, Assign | Loop):
                name = next(k for k in kinds if k.lower() == s.name.lower())
                kinds[name] = unify(kinds[name], Compiler(lookup, formats, line=s.line)(s.value).type if isinstance(s, Assign) else "int", s.line)
    for e in expressions(step.body):  # tests must compile too
        Compiler(lookup, formats, line=step.line)(e)
    found = {c: rel.df.schema[c].dataType for c in rel.columns}
    words = {c: known[c].type for c in rel.columns} | kinds
    return found | {n: spark_type("string" if k == "null" else k) for n, k in kinds.items()}, words
