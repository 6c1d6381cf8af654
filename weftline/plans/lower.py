"""Lowering: a graph becomes projections over a DataFrame.

Branches are `when` chains over the variables, early returns a flag and a value, loops a fold over an array whose
accumulator holds the variables they assign. Nothing is run per row in Python, so Catalyst plans the whole graph.

A variable is an expression of the columns until its tree outgrows LIMIT: then it lands as a column of one more
projection, guarded by the branch it is assigned in, and goes on as that column. So plans grow with the length of a
graph and not with the paths through it. Inside folds, where no projection can stand, a one-element `transform` binds it.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .frontend import MAX_DEPTH, Graph, assigned, call_target, with_kind
from .merge import merge_branches
from .values import Value

_OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**",
    ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>",
}
_ORDER = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


#: Nodes of an expression tree beyond which it lands as a column; trees worth a column of their own; trees that Catalyst
#: may merge again before a row generator of one row, which it doesn't look through, stands between them.
LIMIT, WORTH, MERGED = 48, 6, 400


class BudgetError(RuntimeError):
    pass


@dataclass(frozen=True)
class Budget:
    """Bounds of a graph: nodes that it is lowered to, bytes of a row's variables as JSON, milliseconds of an execution, depth of subgraphs."""

    nodes: int = 10_000
    size: int | None = None
    millis: int | None = None
    depth: int = MAX_DEPTH


@dataclass
class Stage:
    """The DataFrame that variables land in, and the condition under which the statements at hand run."""

    df: DataFrame
    path: Column | None = None
    landed: int = 0
    merged: int = 0
    nodes: int = 0

    def land(self, cols: list[Column], cost: int) -> list[Column]:
        """Columns of a new projection that hold these, null where the path isn't taken."""
        names = [f"__weft_{self.landed + i}" for i in range(len(cols))]
        self.landed += len(cols)
        guarded = [(c if self.path is None else F.when(self.path, c)).alias(n) for n, c in zip(names, cols, strict=True)]
        self.merged += cost
        if self.merged > MERGED:
            self.df, self.merged = self.df.select("*", F.inline(F.array(F.struct(*guarded)))), 0
        else:
            self.df = self.df.select("*", *guarded)
        return [F.col(n) for n in names]


@dataclass
class Setting:
    """What a graph is lowered with: tools by name, subgraphs by name, an environment, merge strategies by variable."""

    tools: dict[str, Callable]
    subgraphs: Callable[[str], Graph] | None = None
    env: object = None
    merge: dict[str, str] = field(default_factory=dict)
    depth: int = 0
    stage: Stage | None = None
    budget: Budget = field(default_factory=Budget)
    running: Column | None = None  # whether a row runs the statement at hand: tools with side effects ask
    folds: int = 0  # loops around the statement at hand


@dataclass
class State:
    """Variables, and for rows that left the straight path: alive, broken out of the loop, returned and with what."""

    vars: dict[str, Value]
    alive: Column | None = None
    broke: Column | None = None
    returned: Column | None = None
    result: Value | None = None
    flags: int = 1  # the size of the trees of all but the variables

    def fork(self) -> State:
        return replace(self, vars=dict(self.vars))

    def heavy(self, least: int) -> bool:
        return self.flags > least or any(v.cost > least for v in self.vars.values())

    def held(self) -> dict[str, Value]:
        """What is worth a column: variables by name, flags and the result by names that no variable has."""
        out = {n: v for n, v in self.vars.items() if v.cost > WORTH and v.raw is not None}
        if self.flags > WORTH:
            out |= {f" {n}": Value(c, V.BOOL) for n in ("alive", "broke", "returned") if (c := getattr(self, n)) is not None}
            if self.result is not None and self.result.raw is not None:
                out[" result"] = self.result
        return out

    def rebased(self, cols: dict[str, Value]) -> State:
        own = {n: v for n, v in cols.items() if not n.startswith(" ")}
        flags = {n.strip(): v if n == " result" else v.raw for n, v in cols.items() if n.startswith(" ")}
        return replace(self, vars={**self.vars, **own}, **flags, flags=1)


def _both(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def _pick(cond: Column, a: Column | None, b: Column | None, otherwise: bool) -> Column | None:
    if a is None and b is None:
        return None
    return F.when(cond, F.lit(otherwise) if a is None else a).otherwise(F.lit(otherwise) if b is None else b)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), lambda e: body(e))[0]


class Lowering:
    def __init__(self, setting: Setting, folds: int = 0):
        self.s = setting
        self.folds = folds  # enclosing loops
        self.called = 0  # sizes of the trees that subgraphs gave

    # statements

    def block(self, stmts: list[ast.stmt], st: State) -> State:
        for s in stmts:
            st = self.statement(s, st)
            if not self.folds and self.s.stage is not None and st.heavy(LIMIT):
                st = self.land(st)
        return st

    def land(self, st: State) -> State:
        held = st.held()
        cost = sum(v.cost for v in held.values())
        cols = self.s.stage.land([v.col for v in held.values()], cost)
        return st.rebased({n: Value(c, v.type) for (n, v), c in zip(held.items(), cols, strict=True)})

    def bound(self, stmts: list[ast.stmt], st: State, finish: Callable[[State], Column]) -> Column:
        """A block inside a fold: `finish` of the state after it, large trees and inner loops bound on the way."""
        for i, s in enumerate(stmts):
            rest = stmts[i + 1 :]
            if isinstance(s, ast.For):
                self.count()
                end, after = self.fold(s, st)
                return _let(end, partial(self._after_fold, rest, after, finish))
            st = self.statement(s, st)
            if rest and st.heavy(LIMIT):
                held = list(st.held().items())
                packed = F.struct(*[v.col.alias(f"f{k}") for k, (_, v) in enumerate(held)])
                return _let(packed, partial(self._after_bind, rest, st, held, finish))
        return finish(st)

    def _after_fold(self, rest: list[ast.stmt], after: Callable[[Column], State], finish: Callable[[State], Column], e: Column) -> Column:
        return self.bound(rest, after(e), finish)

    def _after_bind(self, rest: list[ast.stmt], st: State, held: list[tuple[str, Value]], finish: Callable[[State], Column], e: Column) -> Column:
        return self.bound(rest, st.rebased({n: Value(e[f"f{k}"], v.type) for k, (n, v) in enumerate(held)}), finish)

    def weigh(self, st: State, *nodes: ast.AST | None) -> int:
        """The size of the trees that these make."""
        total = 0
        for node in nodes:
            for n in ast.walk(node) if node is not None else ():
                total += st.vars[n.id].cost if isinstance(n, ast.Name) and n.id in st.vars else 1
        return total

    def count(self) -> None:
        if self.s.stage is not None:
            self.s.stage.nodes += 1
            if self.s.stage.nodes > self.s.budget.nodes:
                raise BudgetError(f"a graph of more than {self.s.budget.nodes} nodes")

    def set(self, st: State, name: str, v: Value, cost: int = 1) -> None:
        cost += self.called
        self.called = 0
        if st.alive is not None:
            old = st.vars.get(name, V.NULL)
            v, cost = V.choose(st.alive, v, old), cost + st.flags + old.cost
        st.vars[name] = replace(v, cost=cost)

    def leave(self, st: State) -> None:
        st.alive = F.lit(False)

    def statement(self, s: ast.stmt, st: State) -> State:
        self.count()
        self.s.folds = self.folds
        self.s.running = st.alive if self.s.stage is None or self.s.stage.path is None else _both(st.alive, self.s.stage.path)
        match s:
            case ast.Assign(targets=[ast.Name(id=name)]):
                self.set(st, name, self.expr(s.value, st), self.weigh(st, s.value))
            case ast.AnnAssign(target=ast.Name(id=name)):
                if s.value is not None:
                    self.set(st, name, self.expr(s.value, st), self.weigh(st, s.value))
            case ast.AugAssign(target=ast.Name(id=name)):
                old = st.vars.get(name, V.NULL)
                self.set(st, name, V.binary(self.op(s.op), old, self.expr(s.value, st)), self.weigh(st, s.value) + old.cost + 1)
            case ast.If():
                return self.branch(self.decide(s.test, st), s.body, s.orelse, st, self.weigh(st, s.test))
            case ast.Match():
                return self.switch(s, st)
            case ast.For():
                return self.loop(s, st)
            case ast.With() if with_kind(s) == "parallel":
                return self.parallel(s, st)
            case ast.With():
                return self.block(s.body, st)
            case ast.Return():
                v = self.expr(s.value, st) if s.value is not None else V.NULL
                st.flags += self.weigh(st, s.value) + self.called
                self.called = 0
                if st.alive is None:
                    v, flag = (v, F.lit(True)) if st.result is None else (V.choose(F.coalesce(st.returned, F.lit(False)), st.result, v), F.lit(True))
                else:
                    v = V.choose(st.alive, v, st.result or V.NULL)
                    flag = st.alive if st.returned is None else st.returned | st.alive
                st.result, st.returned = v, flag
                self.leave(st)
            case ast.Break() | ast.Continue():
                if isinstance(s, ast.Break):
                    now = F.lit(True) if st.alive is None else st.alive
                    st.broke = now if st.broke is None else st.broke | now
                self.leave(st)
            case ast.Raise():
                st.flags += self.weigh(st, s.exc)
                self.guard(st, F.lit(True), self.message(s.exc, st))
            case ast.Assert():
                st.flags += 2 * self.weigh(st, s.test)
                self.guard(st, ~V.truthy(self.expr(s.test, st)), F.lit("assertion failed: " + ast.unparse(s.test)))
            case ast.Expr():
                if not isinstance(s.value, ast.Constant):
                    v = self.expr(s.value, st)
                    if isinstance(s.value, ast.Call) and call_target(s.value):
                        self.set(st, "_last", v, self.weigh(st, s.value))
            case ast.Pass():
                pass
            case _:
                raise TypeError(f"{type(s).__name__} has no plan")
        return st

    def message(self, e: ast.expr | None, st: State) -> Column:
        if isinstance(e, ast.Call) and e.args:
            return F.concat(F.lit("raised: "), V.text(self.expr(e.args[0], st)))
        return F.lit("raised by code")

    def guard(self, st: State, cond: Column, message: Column) -> None:
        """Rows that are alive and meet cond fail: the error is tied to the result, which every row evaluates."""
        hit = cond if st.alive is None else F.when(st.alive, cond).otherwise(F.lit(False))
        old = st.result or V.NULL
        st.result = Value(F.when(hit, F.raise_error(message).cast(old.type)).otherwise(old.col), old.type)
        st.returned = hit if st.returned is None else st.returned | hit
        st.alive = _both(st.alive, ~cond)

    def decide(self, test: ast.expr, st: State) -> Column:
        """Whether a test holds. A failure of its evaluation counts as false outside loops and fails the row inside;
        rows that have left the path don't evaluate it."""
        if self.folds:
            cond = V.truthy(self.expr(test, st))
        else:
            with V.faults() as found:
                cond = V.truthy(self.expr(test, st))
            for bad in found:
                cond = F.when(bad, F.lit(False)).otherwise(cond)
        return cond if st.alive is None else F.when(st.alive, cond).otherwise(F.lit(False))

    def branch(self, cond: Column, body: list[ast.stmt], orelse: list[ast.stmt], st: State, cost: int) -> State:
        stage, cost = self.s.stage, cost + (st.flags if st.alive is not None else 0)
        if self.folds or stage is None:
            return self.join(cond, self.block(body, st.fork()), self.block(orelse, st.fork()), cost)
        if cost > WORTH:
            (cond,), cost = stage.land([cond], cost), 1
        path = stage.path
        stage.path = _both(path, cond)
        a = self.block(body, st.fork())
        stage.path = _both(path, ~cond)
        b = self.block(orelse, st.fork())
        stage.path = path
        return self.join(cond, a, b, cost)

    def join(self, cond: Column, a: State, b: State, cost: int) -> State:
        names = dict.fromkeys([*a.vars, *b.vars])
        out = {}
        for n in names:
            x, y = a.vars.get(n, V.NULL), b.vars.get(n, V.NULL)
            out[n] = x if x is y else replace(V.choose(cond, x, y), cost=cost + x.cost + y.cost)
        result = None
        if a.result is not None or b.result is not None:
            result = a.result if a.result is b.result else V.choose(cond, a.result or V.NULL, b.result or V.NULL)
        same = lambda x, y, d: x if x is y else _pick(cond, x, y, d)
        own = [same(x, y, d) for x, y, d in ((a.alive, b.alive, True), (a.broke, b.broke, False), (a.returned, b.returned, False))]
        changed = result is not a.result or any(x is not y for x, y in zip(own, (a.alive, a.broke, a.returned), strict=True))
        return State(out, *own, result, cost + a.flags + b.flags if changed else a.flags)

    def switch(self, s: ast.Match, st: State) -> State:
        """Cases compare as text; `_` takes the rest."""
        subject, cost = self.expr(s.subject, st), self.weigh(st, s.subject)
        if cost > WORTH and not self.folds and self.s.stage is not None and subject.raw is not None:
            subject, cost = Value(self.s.stage.land([subject.col], cost)[0], subject.type), 1
        as_text = subject.col.cast("string") if subject.kind not in "AMN" else V.text(subject)

        def test(p: ast.pattern) -> Column | None:
            if isinstance(p, ast.MatchOr):
                tests = [test(x) for x in p.patterns]
                return None if any(t is None for t in tests) else self._any(tests)
            if isinstance(p, ast.MatchAs):
                return None
            value = p.value if isinstance(p, ast.MatchSingleton) else ast.literal_eval(p.value)
            if value is None:
                return subject.col.isNull()
            written = str(value).lower() if isinstance(value, bool) else str(value)
            return F.coalesce(as_text == written, F.lit(False))

        stage = None if self.folds else self.s.stage

        def rest(cases: list[ast.match_case], st: State) -> State:
            if not cases:
                return st
            cond = test(cases[0].pattern)
            if cond is None:
                return self.block(cases[0].body, st)
            path = stage.path if stage else None
            if stage:
                stage.path = _both(path, cond)
            a = self.block(cases[0].body, st.fork())
            if stage:
                stage.path = _both(path, ~cond)
            b = rest(cases[1:], st.fork())
            if stage:
                stage.path = path
            return self.join(cond, a, b, cost + 2)

        return rest(s.cases, st)

    @staticmethod
    def _any(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def items(self, e: ast.expr, st: State) -> Value:
        """What a loop goes over, as an array."""
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "range":
            args = [self.expr(a, st).col.cast("long") for a in e.args]
            start, stop, step = (F.lit(0).cast("long"), args[0], F.lit(1).cast("long")) if len(args) == 1 else (args[0], args[1], args[2] if len(args) > 2 else F.lit(1).cast("long"))
            kind = T.ArrayType(V.LONG)
            some = ((step > 0) & (stop > start)) | ((step < 0) & (stop < start))
            return Value(F.when(some, F.sequence(start, stop - F.signum(step).cast("long"), step)).otherwise(F.array().cast(kind)), kind)
        v = self.expr(e, st)
        if v.kind == "V":
            return V.elements(v)
        if v.kind != "A":
            raise TypeError(f"a loop goes over an array or range, not {v.type.simpleString()}")
        return v

    def loop(self, s: ast.For, st: State) -> State:
        end, after = self.fold(s, st)
        if not self.folds and self.s.stage is not None:
            (end,) = self.s.stage.land([end], LIMIT)
        return after(end)

    def fold(self, s: ast.For, st: State) -> tuple[Column, Callable[[Column], State]]:
        """A loop's fold, and the state after it given its value."""
        items = self.items(s.iter, st)
        carried = [n for n in assigned(s.body) if n != s.target.id]
        start = {n: st.vars.get(n, V.NULL) for n in carried}
        types = {n: v.type for n, v in start.items()}
        result_type: T.DataType = T.NullType()
        inner = Lowering(self.s, self.folds + 1)

        def enter(acc: Callable[[str], Column], x: Column) -> State:
            return State({**st.vars, **{n: Value(acc(n), t) for n, t in types.items()}, s.target.id: Value(x, items.type.elementType)})

        # variables' types settle as bodies are planned: null widens to the type that is assigned, whole numbers to doubles
        for _ in range(4):
            probe = inner.block(s.body, enter(lambda n: F.lit(None).cast(types[n]), F.lit(None).cast(items.type.elementType)))
            new = {n: V.common(types[n], probe.vars.get(n, V.NULL).type) for n in carried}
            new_result = V.common(result_type, probe.result.type) if probe.result is not None else result_type
            if new == types and new_result == result_type:
                break
            types, result_type = new, new_result
        held = {n: V.STRING if isinstance(t, T.NullType) else t for n, t in types.items()}
        types = held
        has_result = probe.result is not None
        result_type = V.STRING if isinstance(result_type, T.NullType) else result_type

        def pack(get: dict[str, Column], broke: Column, returned: Column, result: Column) -> Column:
            return F.struct(*[get[n].alias(f"v{i}") for i, n in enumerate(carried)], broke.alias("broke"), returned.alias("returned"), result.alias("result"))

        no = F.lit(False)

        def finish(out: State) -> Column:
            return pack({n: V.cast(out.vars[n], held[n]) for n in carried}, F.coalesce(out.broke, no) if out.broke is not None else no, F.coalesce(out.returned, no) if out.returned is not None else no, V.cast(out.result, result_type) if out.result is not None else F.lit(None).cast(result_type))

        def merge(acc: Column, x: Column) -> Column:
            new = inner.bound(s.body, enter(lambda n: acc[f"v{carried.index(n)}"], x), finish)
            return F.when(acc["broke"] | acc["returned"], acc).otherwise(new)

        first = pack({n: V.cast(v, held[n]) for n, v in start.items()}, F.lit(False), F.lit(False), F.lit(None).cast(result_type))
        over = items.col if st.alive is None else F.when(st.alive, items.col)
        end = F.aggregate(F.coalesce(over, F.array().cast(items.type)) if st.alive is not None else over, first, merge)

        def after(end: Column) -> State:
            out = st.fork()
            for i, n in enumerate(carried):
                self.set(out, n, Value(end[f"v{i}"], held[n]), 2)
            if has_result:
                hit = _both(st.alive, end["returned"])
                out.result = V.choose(hit, Value(end["result"], result_type), st.result or V.NULL)
                out.returned = hit if st.returned is None else st.returned | hit
                out.alive = _both(st.alive, ~end["returned"])
                out.flags += 4
            return out

        return end, after

    def parallel(self, s: ast.With, st: State) -> State:
        """Each statement of the block is a branch that sees the state before the block; branches merge at its end."""
        branches = []
        for b in s.body:
            own = self.statement(b, st.fork())
            branches.append({n: v for n, v in own.vars.items() if st.vars.get(n) is not v})
        for n, v in merge_branches(st.vars, branches, self.s.merge).items():
            self.set(st, n, v, sum(b[n].cost for b in branches if n in b) + (st.vars[n].cost if n in st.vars else 0))
        return st

    # expressions

    def expr(self, e: ast.expr, st: State) -> Value:
        match e:
            case ast.Constant():
                return V.literal(e.value)
            case ast.Name():
                return self.name(e.id, st)
            case ast.BinOp():
                return V.binary(self.op(e.op), self.expr(e.left, st), self.expr(e.right, st))
            case ast.UnaryOp():
                return self.unary(e, st)
            case ast.BoolOp():
                first, *more = e.values
                v = self.expr(first, st)
                if not more:
                    return v
                yes = V.truthy(v)
                go_on = yes if isinstance(e.op, ast.And) else ~yes
                with V.under(go_on):
                    rest = self.expr(ast.BoolOp(e.op, more), st)
                return V.choose(go_on, rest, v)  # the value that decides, as in Python
            case ast.Compare():
                left, tests = self.expr(e.left, st), []
                for op, right in zip(e.ops, e.comparators, strict=True):
                    r = self.expr(right, st)
                    tests.append(self.comparison(op, left, r))
                    left = r
                out = tests[0]
                for t in tests[1:]:
                    out = out & t
                return Value(out, V.BOOL)
            case ast.IfExp():
                test = V.truthy(self.expr(e.test, st))
                with V.under(test):
                    a = self.expr(e.body, st)
                with V.under(~test):
                    b = self.expr(e.orelse, st)
                return V.choose(test, a, b)
            case ast.List() | ast.Tuple():
                return V.array([self.expr(x, st) for x in e.elts])
            case ast.Set():
                v = V.array([self.expr(x, st) for x in e.elts])
                return Value(F.array_distinct(v.col), v.type)
            case ast.Dict():
                if any(not isinstance(k, ast.Constant) for k in e.keys):
                    raise TypeError("keys of object literals are constants")
                return V.struct({str(k.value): self.expr(v, st) for k, v in zip(e.keys, e.values, strict=True)})
            case ast.Subscript():
                return V.subscript(self.expr(e.value, st), self.expr(e.slice, st))
            case ast.Attribute():
                return V.subscript(self.expr(e.value, st), V.literal(e.attr))
            case ast.Call():
                return self.call(e, st)
        raise TypeError(f"{type(e).__name__} has no plan")

    @staticmethod
    def op(op: ast.operator) -> str:
        if type(op) not in _OPS:
            raise TypeError(f"no operator {type(op).__name__}")
        return _OPS[type(op)]

    @staticmethod
    def name(n: str, st: State) -> Value:
        if n in st.vars:
            return st.vars[n]
        if n in ("true", "false", "null"):
            return V.literal({"true": True, "false": False, "null": None}[n])
        raise NameError(f"no variable {n}")

    def unary(self, e: ast.UnaryOp, st: State) -> Value:
        v = self.expr(e.operand, st)
        match e.op:
            case ast.Not():
                return Value(~V.truthy(v), V.BOOL)
            case ast.USub() if v.const is not None and v.kind in "ID":
                return V.literal(-v.const)
            case ast.USub():
                return V.binary("-", V.literal(0), v)
            case ast.Invert():
                return Value(F.bitwise_not(v.col.cast("long")), V.LONG)
        return v

    @staticmethod
    def comparison(op: ast.cmpop, a: Value, b: Value) -> Column:
        match op:
            case ast.Eq() | ast.Is():
                return V.equal(a, b)
            case ast.NotEq() | ast.IsNot():
                return ~V.equal(a, b)
            case ast.In() | ast.NotIn():
                if b.kind == "V":
                    hit = V.contains(b, a)
                elif b.kind == "A":
                    hit = F.exists(b.col, lambda x: V.equal(a, Value(x, b.type.elementType)))
                elif b.kind == "S" and a.kind == "S":
                    hit = b.col.contains(a.col)
                elif isinstance(b.type, T.MapType):
                    hit = F.map_contains_key(b.col, a.col.cast(b.type.keyType))
                elif isinstance(b.type, T.StructType):
                    hit = F.lit(a.const in b.type.names) if a.const is not None else a.col.isin(b.type.names)
                else:
                    hit = F.lit(False)
                hit = F.coalesce(hit, F.lit(False))
                return ~hit if isinstance(op, ast.NotIn) else hit
        return V.compare(_ORDER[type(op)], a, b)

    def call(self, e: ast.Call, st: State) -> Value:
        target = call_target(e)
        if not target:
            from ..functions.builtins import BUILTINS

            name = e.func.id if isinstance(e.func, ast.Name) else ast.unparse(e.func)
            args = [self.expr(a, st) for a in e.args]
            if name in BUILTINS:
                return BUILTINS[name](*args)
            if name in self.s.tools:
                return self.s.tools[name](self.s, args, {k.arg: self.expr(k.value, st) for k in e.keywords})
            raise NameError(f"no function {name}")
        args = [self.expr(a, st) for a in e.args[1:]]
        kw = {k.arg: self.expr(k.value, st) for k in e.keywords}
        policy, fallback = kw.pop("on_error", None), kw.pop("fallback_value", V.NULL)
        if target.startswith("subgraph:"):
            return self.subgraph(target.removeprefix("subgraph:"), kw, st)
        if target not in self.s.tools:
            raise NameError(f"no tool {target}")
        tool = self.s.tools[target]
        kind = policy.const if policy is not None else "abort"
        if kind == "abort":
            return tool(self.s, args, kw)
        if kind not in ("continue_with_null", "continue_with_fallback"):
            raise ValueError(f"on_error is abort, continue_with_null or continue_with_fallback, not {kind}")
        value, ok = tool.attempt(self.s, args, kw)
        return V.choose(ok, value, fallback if kind == "continue_with_fallback" else V.NULL)

    def subgraph(self, name: str, kw: dict[str, Value], st: State) -> Value:
        """A child sees the caller's variables and its arguments; its return is the value, and its variables become the caller's."""
        if self.s.depth + 1 > self.s.budget.depth:
            raise RecursionError(f"subgraphs are nested deeper than {self.s.budget.depth}")
        if self.s.subgraphs is None:
            raise NameError(f"no subgraph {name}")
        child = self.s.subgraphs(name)
        env = self.s.env.scoped(name) if self.s.env is not None else None
        inner = Lowering(replace(self.s, depth=self.s.depth + 1, env=env), self.folds)
        own = {p: V.literal(child.defaults[p]) if p in child.defaults else V.NULL for p in child.params}
        stage = None if self.folds else self.s.stage
        path = stage.path if stage else None
        if stage:  # rows that have left the caller's path don't run the child
            stage.path = st.alive if path is None else _both(st.alive, path)
        out = inner.block(child.body, State({**own, **st.vars, **kw}))
        if stage:
            stage.path = path
        for n, v in out.vars.items():
            if n != "_last" and st.vars.get(n) is not v:
                self.set(st, n, v, v.cost)
        result = out.result or out.vars.get("_last", V.NULL)
        self.called += out.flags if out.result is not None else result.cost
        return result


def lower(graph: Graph, inputs: dict[str, Value], setting: Setting) -> State:
    missing = {p: V.literal(graph.defaults.get(p)) for p in graph.params if p not in inputs}
    return Lowering(setting).block(graph.body, State({**missing, **inputs}))


def _json_bytes(v: Value) -> Column:
    """Bytes of a value as JSON, about."""
    return F.coalesce(F.octet_length(F.to_json(v.col) if v.kind in "AMV" else v.col.cast("string")), F.lit(4))


def apply_graph(
    df: DataFrame,
    graph: Graph | str,
    output: str = "result",
    keep: list[str] | None = None,
    variables: list[str] | None = None,
    rename: dict[str, str] | None = None,
    tools: dict[str, Callable] | None = None,
    subgraphs: dict[str, Graph | str] | Callable[[str], Graph] | None = None,
    env: object = None,
    merge: dict[str, str] | None = None,
    budget: Budget | None = None,
) -> DataFrame:
    """Run a graph on every row: columns are its inputs (renamed by `rename`), its return is the column `output`.

    Without a return the last call's value stands there. `variables` adds columns with variables' final values;
    `keep` names the columns of df that stay (all of them by default).
    """
    from ..functions import outside  # noqa: F401  (registers tools)
    from ..functions.tools import TOOLS
    from .frontend import compile_graph

    graph = compile_graph(graph, merged=set(merge or ())) if isinstance(graph, str) else graph
    find = subgraphs
    if isinstance(subgraphs, dict):
        ready = {k: compile_graph(g) if isinstance(g, str) else g for k, g in subgraphs.items()}
        find = ready.__getitem__
    named = {(rename or {}).get(f.name, f.name): Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    stage, budget = Stage(df), budget or Budget()
    setting = Setting({**TOOLS, **(tools or {})}, find, env, merge or {}, stage=stage, budget=budget)
    st = lower(graph, {k: v for k, v in named.items() if k in graph.params or rename and k in rename.values()}, setting)
    result = st.result or st.vars.get("_last", V.NULL)
    if budget.size is not None:
        size = sum((_json_bytes(v) for v in st.vars.values() if v.raw is not None), F.lit(0))
        result = Value(F.when(size > budget.size, V.fail(f"variables of more than {budget.size} bytes", result.type)).otherwise(result.col), result.type)
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    extra = [st.vars[v].col.alias(v) for v in variables or []]
    return stage.df.select(*cols, *extra, result.col.alias(output))
