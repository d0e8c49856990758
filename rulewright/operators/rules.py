"""A rule as a DataFrame: scans, equi-joins, anti-joins, filters and projections, in an order that keeps joins keyed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewright.errors import ProgramError, SafetyError
from rulewright.functions.scalar import RANKS, Typed, compile_expression, matches
from rulewright.plans.analyse import Plan
from rulewright.plans.expand import variables
from rulewright.plans.syntax import Agg, Atom, Compare, Const, Not, Rule, Test, Tup, Var, Wild

_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _column(name: str) -> str:
    return f"v_{name}"


def _same_type(a: object, b: object) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(_same_type, a, b))
    return a == b or (a in RANKS and b in RANKS)


class _Scan:
    """An atom over its relation: variables as columns, constants and repeated variables as filters."""

    def __init__(self, plan: Plan, atom: Atom, df: DataFrame):
        self.plan, self.filters, self.bound, self.later = plan, [], {}, []
        for name, (_, kind), arg in zip(df.columns, plan.decls[atom.relation].columns, atom.args, strict=True):
            self.take(F.col(f"`{name}`"), kind, arg)
        for f in self.filters:
            df = df.filter(f)
        self.frame = df.select(*(c.alias(_column(v)) for v, (c, _) in self.bound.items()))

    def kind(self, name: object) -> object:
        return tuple(self.kind(t) for _, t in self.plan.types[name]) if name in self.plan.types else name

    def take(self, c: Column, kind: object, arg) -> None:
        kind = self.kind(kind)
        if isinstance(arg, Wild):
            return
        if isinstance(arg, Const):
            self.filters.append(c == F.lit(arg.value))
        elif isinstance(arg, Var):
            if arg.name in self.bound:
                self.filters.append(self.bound[arg.name][0] == c)
            else:
                self.bound[arg.name] = (c, kind)
        elif isinstance(arg, Tup):
            if not isinstance(kind, tuple) or len(kind) != len(arg.items):
                raise ProgramError("a tuple pattern doesn't fit its column")
            for i, item in enumerate(arg.items):
                self.take(c.getField(f"_{i}"), kind[i], item)
        else:
            name = f"_{len(self.later)}_{id(self)}"
            self.bound[name] = (c, kind)
            self.later.append(Compare("=", Var(name), arg))


class _Body:
    """The rows of a rule's body so far, and the types of its bound variables."""

    def __init__(self, spark: SparkSession, plan: Plan):
        self.spark, self.plan, self.frame, self.types = spark, plan, None, {}

    def env(self) -> dict[str, Typed]:
        return {v: (F.col(_column(v)), t) for v, t in self.types.items()}

    def bound(self, node) -> bool:
        return variables(node) <= self.types.keys()

    def join(self, scan: _Scan) -> None:
        shared = [v for v in scan.bound if v in self.types]
        for v in shared:
            if not _same_type(self.types[v], scan.bound[v][1]):
                raise ProgramError(f"{v} is of type {self.types[v]} and {scan.bound[v][1]}")
        if self.frame is None:
            self.frame = scan.frame if scan.bound else scan.frame.limit(1)
        elif not scan.bound:
            self.frame = self.frame.join(scan.frame.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_semi")
        elif len(shared) == len(scan.bound):  # nothing new: relations are sets, so one match is as good as many
            self.frame = self.frame.join(scan.frame, [_column(v) for v in shared], "left_semi")
        elif shared:
            self.frame = self.frame.join(scan.frame, [_column(v) for v in shared])
        else:
            self.frame = self.frame.crossJoin(scan.frame)
        self.types |= {v: t for v, (_, t) in scan.bound.items() if v not in self.types}

    def without(self, scan: _Scan) -> None:
        if scan.later:
            raise ProgramError("an expression in a negated atom needs a variable of its own")
        on = [_column(v) for v in scan.bound]
        if on:
            self.frame = self.frame.join(scan.frame, on, "left_anti")
        else:
            self.frame = self.frame.join(scan.frame.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti")

    def bind(self, name: str, node) -> None:
        c, kind = compile_expression(node, self.env())
        self.frame = self.frame.withColumn(_column(name), c) if self.frame is not None else _one_row(self.spark).select(c.alias(_column(name)))
        self.types[name] = kind

    def test(self, x) -> None:
        if isinstance(x, Test):
            (a, s), (b, t) = (compile_expression(e, self.env()) for e in x.args)
            if (s, t) != ("symbol", "symbol"):
                raise ProgramError(f"{x.name} takes symbols")
            first = x.args[0].value if x.name == "match" and isinstance(x.args[0], Const) else a
            c = matches(first, b) if x.name == "match" else F.contains(b, a)
            self.keep(~c if x.negated else c)
        else:
            (a, s), (b, t) = compile_expression(x.left, self.env()), compile_expression(x.right, self.env())
            if not _same_type(s, t):
                raise ProgramError(f"{x.op} compares {s} and {t}")
            self.keep(_OPS[x.op](a, b))

    def keep(self, c: Column) -> None:
        self.frame = (self.frame if self.frame is not None else _one_row(self.spark)).filter(c)

    def settle(self, waiting: list) -> list:
        """Applies all tests, bindings and destructurings that can be applied by now."""
        again = True
        while again:
            again = False
            for x in list(waiting):
                if self.bound(x):
                    self.test(x)
                elif isinstance(x, Compare) and x.op == "=" and self._bind_side(x, waiting):
                    pass
                else:
                    continue
                waiting.remove(x)
                again = True
        return waiting

    def _bind_side(self, x: Compare, waiting: list) -> bool:
        for a, b in ((x.left, x.right), (x.right, x.left)):
            if not self.bound(b):
                continue
            if isinstance(a, Var):
                self.bind(a.name, b)
                return True
            if isinstance(a, Tup):
                name = f"t{len(self.types)}_{len(waiting)}"
                self.bind(name, b)
                kinds = self.types[name]
                if not isinstance(kinds, tuple) or len(kinds) != len(a.items):
                    raise ProgramError("a tuple pattern doesn't fit its value")
                for i, item in enumerate(a.items):
                    if isinstance(item, Wild):
                        continue
                    self.frame = self.frame.withColumn(_column(f"{name}_{i}"), F.col(_column(name)).getField(f"_{i}"))
                    self.types[f"{name}_{i}"] = kinds[i]
                    waiting.append(Compare("=", item, Var(f"{name}_{i}")))
                return True
        return False


def _one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("v_"))


def rule_frame(spark: SparkSession, plan: Plan, rule: Rule, read: Callable[[Atom, int], DataFrame], first: int | None = None) -> DataFrame:
    """The head's rows, not yet distinct; an aggregated head has its argument in the aggregate's place.

    read gives the relation for the body atom at an index; the atom at first is joined first.
    """
    atoms = [(i, x) for i, x in enumerate(rule.body) if isinstance(x, Atom)]
    negated = [x.atom for x in rule.body if isinstance(x, Not)]
    waiting = [x for x in rule.body if isinstance(x, (Compare, Test))]
    body = _Body(spark, plan)
    todo = sorted(atoms, key=lambda p: p[0] != first)
    while todo:
        linked = lambda p: len(variables(p[1].args) & body.types.keys())
        pick = todo[0] if body.frame is None else max(todo, key=lambda p: (linked(p) > 0, -p[0]))
        todo.remove(pick)
        scan = _Scan(plan, pick[1], read(pick[1], pick[0]))
        body.join(scan)
        waiting = body.settle(waiting + scan.later)
        for n in [n for n in negated if body.bound(n.args)]:
            negated.remove(n)
            body.without(_Scan(plan, n, read(n, -1)))
    waiting = body.settle(waiting)
    for n in list(negated):
        if body.bound(n.args):
            negated.remove(n)
            if body.frame is None:
                body.frame = _one_row(spark)
            body.without(_Scan(plan, n, read(n, -1)))
    head = rule.heads[0]
    for x in [*waiting, *negated]:
        raise SafetyError(f"{head.relation}: {', '.join(sorted(variables(x) - body.types.keys()))} has no value")
    frame, env, out = body.frame if body.frame is not None else _one_row(spark), body.env(), []
    for (name, kind), arg in zip(plan.decls[head.relation].columns, head.args, strict=True):
        if isinstance(arg, Wild):
            raise SafetyError(f"{head.relation}: _ in a head has no value")
        fold = isinstance(arg, Agg)
        c, own = compile_expression(arg.arg if fold else arg, env)
        if fold:
            if arg.name != "count" and own not in RANKS:
                raise ProgramError(f"{arg.name} takes numbers")
        else:
            declared = _Scan.kind(_Kinds(plan), kind)
            if not _same_type(own, declared):
                raise ProgramError(f"{head.relation}.{name} is of type {kind}, not {own}")
            c = c.cast(plan.spark_type(kind))
        out.append(c.alias(name))
    return frame.select(*out)


def pair_frame(spark: SparkSession, plan: Plan, rule: Rule, read: Callable[[Atom, int], DataFrame]) -> DataFrame | None:
    """The distinct rows of a rule that compares two atoms' rows, made distinct before they are paired; None for other rules.

    Pairs grow with the square of the input, so they must be neither shuffled nor left to the few tasks that a small input has. Of distinct
    sides, a pair comes once if the head tells what the sides share, or if one side has no two rows that differ in this alone.
    One side's rows are dealt to slices, of which each meets the whole of the other's rows of its key in a task of its own.
    """
    head, atoms, tests = rule.heads[0], [x for x in rule.body if isinstance(x, Atom)], [x for x in rule.body if isinstance(x, Compare)]
    told = {a.name for a in head.args if isinstance(a, Var)}
    if len(atoms) != 2 or len(atoms) + len(tests) != len(rule.body) or len(told) != len(head.args):
        return None
    used = [variables(a.args) for a in atoms]
    shared, plain = used[0] & used[1], all(isinstance(x, (Var, Wild, Const)) for a in atoms for x in a.args)
    across = any(variables(x) & (used[0] - shared) and variables(x) & (used[1] - shared) for x in tests)
    if not (plain and across and shared and told <= used[0] | used[1] and all(variables(x) <= told for x in tests) and (shared <= told or not shared & told)):
        return None
    body, sides, own = _Body(spark, plan), [], []
    for i, a in enumerate(atoms):
        scan = _Scan(plan, a, read(a, rule.body.index(a)))
        if any(v in body.types and not _same_type(body.types[v], k) for v, (_, k) in scan.bound.items()):
            return None
        body.types |= {v: k for v, (_, k) in scan.bound.items() if v not in body.types}
        own.append([_column(v) for v in sorted(told & used[i] - shared)])
        sides.append(scan.frame.select(*own[i], *(_column(v) for v in sorted(shared))).distinct())
    if not own[0] or not own[1] or not (shared <= told or any(s.groupBy(*o).count().filter("count > 1").isEmpty() for s, o in zip(sides, own, strict=True))):
        return None
    slices = 2 * spark.sparkContext.defaultParallelism
    one = sides[0].withColumn("__slice", F.pmod(F.xxhash64(*own[0]), F.lit(slices)).cast("int"))
    two = sides[1].withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    on = [*(_column(v) for v in sorted(shared)), "__slice"]
    body.frame = one.repartition(2 * slices, *on).hint("shuffle_hash").join(two.repartition(2 * slices, *on), on)
    for x in tests:
        body.test(x)
    columns = zip(plan.decls[head.relation].columns, head.args, strict=True)
    if any(not _same_type(body.types[a.name], _Scan.kind(_Kinds(plan), kind)) or (kind in RANKS and kind != body.types[a.name]) for (_, kind), a in columns):
        return None
    return body.frame.select(*(F.col(_column(a.name)).alias(c) for (c, _), a in zip(plan.decls[head.relation].columns, head.args, strict=True)))


class _Kinds:
    def __init__(self, plan: Plan):
        self.plan = plan

    kind = _Scan.kind


def fold_of(rules: list[Rule]) -> tuple[int, str] | None:
    """Place and name of the aggregate that the rules of a head share, if they have one."""
    found = {next(((i, a.name) for i, a in enumerate(r.heads[0].args) if isinstance(a, Agg)), None) for r in rules}
    if len(found) > 1:
        raise ProgramError(f"the rules of {rules[0].heads[0].relation} aggregate differently")
    return found.pop() if found else None


def aggregate(plan: Plan, relation: str, frame: DataFrame, at: int, name: str) -> DataFrame:
    """The aggregate over distinct rows: of each group, or of all rows for a head of one column."""
    from rulewright.functions.scalar import wrap32

    columns = plan.decls[relation].columns
    column, kind = columns[at]
    groups = [c for i, (c, _) in enumerate(columns) if i != at]
    value = F.col(f"`{column}`")
    if name == "count":
        c = F.count(F.lit(1)).cast(plan.spark_type(kind))
    elif name == "sum":
        c = F.sum(value.cast("bigint") if kind in ("number", "long") else value)
        c = F.coalesce(c, F.lit(0)) if not groups else c
        c = wrap32(c) if kind == "number" else c
    else:
        c = (F.min if name == "min" else F.max)(value)
    out = frame.distinct().groupBy(*(F.col(f"`{g}`") for g in groups)).agg(c.cast(plan.spark_type(kind)).alias(column))
    if not groups and name in ("min", "max"):
        out = out.filter(value.isNotNull())
    return out.select(*(F.col(f"`{c}`") for c, _ in columns))
