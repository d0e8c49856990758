"""Evaluates a plan: strata in order, recursive ones by semi-naive rounds over written tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulewright.errors import LimitExceeded, MissingRelationError
from rulewright.plans.analyse import Plan, Stratum, analyse, dependencies
from rulewright.plans.syntax import Atom, Program, Rule, Var, parse
from rulewright.sources.shared import Table, read_all

from .rules import aggregate, fold_of, pair_frame, rule_frame

#: From this many known rows on, candidates are first held against the known rows that they can equal.
PREFILTER_ROWS = 1_000_000
#: Tables of rounds are joined up to one after so many.
COMPACT = 16
#: Relations of one recursive group that are made at a time.
JOBS = 8
#: Nodes of a plan that is read anew at no more cost than that of reading its table.
_SCANS = {"LogicalRelation", "Relation", "Project", "Filter", "SubqueryAlias", "View"}


def bind(plan: Plan, relation: str, df: DataFrame, nulls: str = "reject") -> DataFrame:
    """df as an input: by name if it has all declared columns, else by position; cast; nulls rejected or dropped."""
    columns = plan.decls[relation].columns
    if not all(c in df.columns for c, _ in columns):
        if len(df.columns) != len(columns):
            raise MissingRelationError(f"{relation} has {len(columns)} columns; its facts have {len(df.columns)}")
        df = df.toDF(*(c for c, _ in columns))
    df = df.select(*(F.col(f"`{c}`").cast(plan.spark_type(t)).alias(c) for c, t in columns))
    if nulls == "drop":
        return df.dropna()
    if any(f.nullable for f in df.schema):
        wrong = lambda c: F.raise_error(F.lit(f"{relation}.{c} is null")).cast(df.schema[c].dataType)
        df = df.select(*(F.coalesce(F.col(f"`{c}`"), wrong(c)).alias(c) for c in df.columns))
    return df


def _scan(df: DataFrame) -> bool:
    """True if df only filters and projects one stored table."""
    def walk(p) -> bool:
        kids = p.children()
        return p.nodeName().split(" ")[0] in _SCANS and all(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().analyzed())


def _void(df: DataFrame) -> bool:
    """True if its plan alone says that df has no rows."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


class Solver:
    """The relations of a plan over bound inputs, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, plan: Plan, facts: dict[str, DataFrame], nulls: str = "reject", doubling: bool = True, bound: bool = False):
        missing = sorted(set(plan.inputs) - set(facts))
        if missing:
            raise MissingRelationError(f"no facts for {', '.join(missing)}")
        self.spark, self.plan, self.doubling = spark, plan, doubling
        self.given = {n: facts[n] if bound else bind(plan, n, facts[n], nulls) for n in plan.inputs}
        self.known: dict[str, DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.tables: list[Table] = []
        self.rounds: dict[str, int] = {}
        self.void: set[str] = set()
        self.readers = plan.readers()
        self.looped = {d for s in plan.strata if s.recursive for n in s.relations for r in plan.rules.get(n, []) for d, _ in dependencies(r)} - {n for s in plan.strata if s.recursive for n in s.relations}
        self.stratum = {n: s for s in plan.strata for n in s.relations}

    def outputs(self) -> dict[str, DataFrame]:
        return {n: self.relation(n) for n in self.plan.outputs}

    def relation(self, name: str) -> DataFrame:
        if name not in self.stratum:
            raise MissingRelationError(f"no live relation is named {name}")
        if name not in self.known:
            for s in self.plan.strata:  # in order, so that rules are never deeper than one stratum
                if s.relations[0] not in self.known:
                    self.make(s)
                if name in self.known:
                    break
        return self.known[name]

    def make(self, s: Stratum) -> None:
        if s.recursive:
            self.known |= self.fixpoint(s)
            return
        name = s.relations[0]
        df = self.seed(name, self.plan.rules.get(name, []))
        derived = bool(self.plan.rules.get(name))
        if derived and name in self.looped and _void(df):
            self.void.add(name)
            df = self.spark.createDataFrame([], self.plan.schema(name))
        # What every round of a loop reads is made once; a plain scan is as good as a kept copy.
        if derived and (self.readers.get(name, 0) > 1 or name in self.plan.limits) or name in self.looped and not _scan(df):
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(df)
        self.check(name, df.count() if name in self.plan.limits else 0)
        self.known[name] = df

    def check(self, name: str, rows: int) -> None:
        if rows > self.plan.limits.get(name, rows):
            raise LimitExceeded(name, rows, self.plan.limits[name])

    def inline(self, name: str) -> DataFrame | None:
        rows = self.plan.facts.get(name)
        return self.spark.createDataFrame(rows, self.plan.schema(name)) if rows else None

    def seed(self, name: str, rules: list[Rule]) -> DataFrame:
        """What the input, inline facts and rules over earlier strata give, distinct where rules take part."""
        if len(rules) == 1 and name not in self.given and name not in self.plan.facts:
            pairs = pair_frame(self.spark, self.plan, rules[0], lambda atom, _: self.known[atom.relation])
            if pairs is not None:
                return pairs
        fold = fold_of(rules) if rules else None
        frames = [rule_frame(self.spark, self.plan, r, lambda atom, _: self.known[atom.relation]) for r in rules]
        if fold:
            frames = [aggregate(self.plan, name, reduce(DataFrame.unionAll, frames), *fold)]
        frames += [x for x in (self.given.get(name), self.inline(name)) if x is not None]
        if not frames:
            return self.spark.createDataFrame([], self.plan.schema(name))
        out = reduce(DataFrame.unionAll, frames)
        return out if fold and len(frames) == 1 or not rules and len(frames) == 1 else out.distinct()

    def table(self, df: DataFrame, name: str) -> tuple[Table, int]:
        t = Table(df, name.replace(".", "-"))
        self.tables.append(t)
        return t, t.rows

    def fixpoint(self, s: Stratum) -> dict[str, DataFrame]:
        group = set(s.relations)
        inner = lambda r: [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.relation in group]
        looping = {n: [r for r in self.plan.rules.get(n, []) if inner(r)] for n in s.relations}
        if self.void:  # a rule over a relation that can have no rows gives none
            looping = {n: [r for r in rules if not any(isinstance(x, Atom) and x.relation in self.void for x in r.body)] for n, rules in looping.items()}
        if self.doubling and len(group) == 1:
            looping = {n: [doubled(self.plan, n, looping[n])] if closes(self.plan, n, looping[n]) else looping[n] for n in group}
        every: dict[str, list[Table]] = {}
        size: dict[str, int] = {}
        delta: dict[str, Table | None] = {}
        for n in s.relations:
            t, size[n] = self.table(self.seed(n, [r for r in self.plan.rules.get(n, []) if not inner(r)]).distinct(), n)
            every[n], delta[n] = [t], t if size[n] else None
            self.check(n, size[n])
        rounds = 0
        before: dict[str, list[Table]] = {n: [] for n in s.relations}
        while any(delta.values()):
            rounds += 1
            fresh: dict[str, Table | None] = {}
            grown: dict[str, int] = {}
            due: dict[str, list[DataFrame]] = {}
            for n in s.relations:
                frames = []
                for r in looping[n]:
                    for at in inner(r):
                        # Pairs of two new rows are made once: atoms before this one give what was known before the round.
                        if delta[r.body[at].relation] is None or any(i < at and not before[r.body[i].relation] for i in inner(r)):
                            continue

                        def read(atom: Atom, i: int, at: int = at) -> DataFrame:
                            if atom.relation not in group:
                                return self.known[atom.relation]
                            return delta[atom.relation].read() if i == at else read_all((before if 0 <= i < at else every)[atom.relation])

                        frames.append(rule_frame(self.spark, self.plan, r, read, first=at))
                due[n] = frames
            with ThreadPoolExecutor(JOBS) as jobs:  # the relations of a round don't wait for each other
                for n, found in zip(due, jobs.map(lambda n: self.unseen(n, due[n], every[n], size[n]) if due[n] else (None, 0), due), strict=True):
                    fresh[n], grown[n] = found
            before = {n: list(every[n]) for n in s.relations}
            for n in s.relations:
                if fresh[n] is not None:
                    every[n].append(fresh[n])
                    size[n] += grown[n]
                    self.check(n, size[n])
                    if len(every[n]) > COMPACT:
                        every[n] = [self.table(read_all(every[n]), n)[0]]
            delta = fresh
        for n in s.relations:
            self.rounds[n] = rounds
        return {n: read_all(every[n]) for n in s.relations}

    def unseen(self, name: str, frames: list[DataFrame], every: list[Table], size: int) -> tuple[Table | None, int]:
        """The distinct rows of frames that aren't in every; None if there are none."""
        found, on, held = reduce(DataFrame.unionAll, frames).distinct(), [c for c, _ in self.plan.decls[name].columns], None
        if not size:
            t, n = self.table(found, name)
            return (t, n) if n else (None, 0)
        known = read_all(every)
        if size >= PREFILTER_ROWS:  # few candidates then reduce the known rows where they lie
            held, n = self.table(found, name)
            if not n:
                return None, 0
            found = held.read()
            known = known.join(found, on, "left_semi") if n < size / 8 else known
        t, n = self.table(found.join(known, on, "left_anti"), name)
        return (t, n) if n else (None, 0)

    def release(self) -> None:
        """Drops all kept and written relations; frames made from them can't be read afterwards."""
        for df in self.kept:
            df.unpersist()
        for t in self.tables:
            t.drop()
        self.kept, self.tables, self.known = [], [], {}


def closes(plan: Plan, name: str, looping: list[Rule]) -> bool:
    """True if the rules make name the plain transitive closure of one binary relation."""
    rules = plan.rules[name]
    if len(rules) != 2 or len(looping) != 1 or len(plan.decls[name].columns) != 2 or name in plan.inputs or name in plan.facts:
        return False
    base = next(r for r in rules if r is not looping[0])
    step = looping[0]
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(x, Atom) for x in (*base.body, *step.body)):
        return False
    edge = base.body[0].relation
    pair = lambda a: a.args if len(a.args) == 2 and all(isinstance(x, Var) for x in a.args) and a.args[0] != a.args[1] else None
    args = [pair(x) for x in (base.heads[0], base.body[0], step.heads[0], *step.body)]
    if None in args or args[0] != args[1] or edge == name or {step.body[0].relation, step.body[1].relation} != {edge, name}:
        return False
    head, one, two = args[2:]
    return any(head == (a[0], b[1]) and a[1] == b[0] and len({*a, *b}) == 3 for a, b in ((one, two), (two, one)))


def doubled(plan: Plan, name: str, looping: list[Rule]) -> Rule:
    """The closure's step over itself: as many rounds as the logarithm of the longest path."""
    x, y, z = Var("x"), Var("y"), Var("z")
    return Rule((Atom(name, (x, z)),), (Atom(name, (x, y)), Atom(name, (y, z))))


def solve(spark: SparkSession, program: str | Program | Plan, facts: dict[str, DataFrame], probes: list[str] = (), nulls: str = "reject", doubling: bool = True) -> dict[str, DataFrame]:
    """The program's outputs (and probes) over facts."""
    plan = program if isinstance(program, Plan) else analyse(parse(program) if isinstance(program, str) else program, probes)
    return Solver(spark, plan, facts, nulls, doubling).outputs()
