"""Relations that are kept over commits: changes of inputs move through the strata, as rows that came and rows that went.

A stratum that none of its sources' changes reach is left alone. Where rows only came, and only to atoms that the rules
read without negation or aggregate, the new rows are derived semi-naively from the new ones. Any other stratum is made anew
from the kept relations and held against what it was; if it is the same, what follows it is left alone.
A relation is one or more written tables, so what came is appended and nothing is rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rulewright.errors import LimitExceeded
from rulewright.operators.rules import rule_frame
from rulewright.operators.solve import COMPACT, Solver
from rulewright.plans.analyse import Plan, Stratum, dependencies
from rulewright.plans.syntax import Atom, Rule
from rulewright.sources.shared import Table, read_all

#: What moved in a relation: tables of rows that came, and of rows that went.
Moved = tuple[list[Table], list[Table]]


class Relations:
    """The inputs (given) and all live relations (known) of a plan, each as tables. A change works on a copy, which is adopted or dropped."""

    def __init__(self, spark: SparkSession, plan: Plan):
        self.spark, self.plan = spark, plan
        self.given: dict[str, list[Table]] = {}
        self.known: dict[str, list[Table]] = {}
        self.made: list[Table] = []

    def copy(self) -> Relations:
        out = Relations(self.spark, self.plan)
        out.given = {n: list(t) for n, t in self.given.items()}
        out.known = {n: list(t) for n, t in self.known.items()}
        return out

    def tables(self) -> dict[str, Table]:
        return {t.path: t for tables in (*self.given.values(), *self.known.values()) for t in tables}

    def table(self, df: DataFrame, tag: str) -> Table:
        t = Table(df, tag.replace(".", "-"))
        self.made.append(t)
        return t

    def read(self, name: str) -> DataFrame:
        return read_all(self.known[name])

    def size(self, name: str) -> int:
        return sum(t.rows for t in self.known.get(name, []))

    def minus(self, df: DataFrame, tables: list[Table], tag: str) -> list[Table]:
        """The rows of df that tables don't have, as one table or none."""
        if tables:
            df = df.join(read_all(tables), df.columns, "left_anti")
        t = self.table(df, tag)
        if t.rows:
            return [t]
        self.forget(t)
        return []

    def forget(self, t: Table) -> None:
        self.made.remove(t)
        t.drop()

    def replace(self, name: str, rows: DataFrame) -> Moved:
        """Distinct rows in place of an input's."""
        new, old = self.table(rows, f"input-{name}"), self.given.get(name, [])
        if not old:
            self.given[name] = [new]
            return [new] if new.rows else [], []
        came, went = self.minus(new.read(), old, f"came-{name}"), self.minus(read_all(old), [new], f"went-{name}")
        if not (came or went):
            self.forget(new)
        else:
            self.given[name] = [new]
        return came, went

    def add(self, name: str, rows: DataFrame) -> Moved:
        """Distinct rows to those of an input, which aren't written again."""
        came = self.minus(rows, self.given.get(name, []), f"came-{name}")
        self.given[name] = self._compact(name, self.given.get(name, []) + came)
        return came, []

    def remove(self, name: str, rows: DataFrame) -> Moved:
        """Distinct rows from those of an input."""
        old = self.given[name]
        went = self.table(read_all(old).join(rows, rows.columns, "left_semi"), f"went-{name}")
        if not went.rows:
            self.forget(went)
            return [], []
        self.given[name] = [self.table(read_all(old).join(went.read(), rows.columns, "left_anti"), f"input-{name}")]
        return [], [went]

    def _compact(self, name: str, tables: list[Table]) -> list[Table]:
        return [self.table(read_all(tables), name)] if len(tables) > COMPACT else tables

    def update(self, inputs: dict[str, Moved]) -> dict[str, Moved]:
        """Moves changes of inputs through all strata; what moved in each relation."""
        moved: dict[str, Moved] = {}
        for s in self.plan.strata:
            own = set(s.relations)
            rules = [r for n in s.relations for r in self.plan.rules.get(n, [])]
            needs = [(d, strict) for r in rules for d, strict in dependencies(r)]
            if all(n in self.known for n in own):
                changed = {d for d, _ in needs if d in moved} | {n for n in own if any(inputs.get(n, ([], [])))}
                if not changed:
                    continue
                grows = not any(moved[d][1] for d in changed if d in moved) and not any(inputs[n][1] for n in own if n in inputs)
                if grows and not any(strict and d in moved for d, strict in needs):
                    moved |= self._grow(s, rules, moved, inputs)
                    continue
            moved |= self._remake(s)
        return moved

    def check(self, name: str) -> None:
        rows, limit = self.size(name), self.plan.limits.get(name)
        if limit is not None and rows > limit:
            raise LimitExceeded(name, rows, limit)

    def _remake(self, s: Stratum) -> dict[str, Moved]:
        """The stratum over the kept relations, held against what it was."""
        solver = Solver(self.spark, self.plan, {n: read_all(t) for n, t in self.given.items()}, bound=True)
        solver.known = {n: read_all(t) for n, t in self.known.items() if n not in s.relations}
        moved: dict[str, Moved] = {}
        try:
            solver.make(s)
            for n in s.relations:
                old, plain = self.known.get(n, []), n in self.plan.inputs and not self.plan.rules.get(n) and n not in self.plan.facts
                new = self.given[n] if plain else [self.table(solver.known[n], n)]
                if old:
                    came, went = self.minus(read_all(new), old, f"came-{n}"), self.minus(read_all(old), new, f"went-{n}")
                else:
                    came, went = [t for t in new if t.rows], []
                if came or went or not old:
                    self.known[n] = new
                    self.check(n)
                if came or went:
                    moved[n] = came, went
        finally:
            solver.release()
        return moved

    def _grow(self, s: Stratum, rules: list[Rule], moved: dict[str, Moved], inputs: dict[str, Moved]) -> dict[str, Moved]:
        """The rows that new rows of the stratum's sources bring, round by round."""
        came: dict[str, list[Table]] = {n: [] for n in s.relations}
        delta = {d: moved[d][0] for d in moved if moved[d][0]}
        first = True
        while delta or first:
            fresh: dict[str, list[Table]] = {}
            for n in s.relations:
                frames = [read_all(inputs[n][0])] if first and n in inputs and inputs[n][0] else []
                for r in self.plan.rules.get(n, []):
                    for at, x in enumerate(r.body):
                        if isinstance(x, Atom) and x.relation in delta:

                            def read(atom: Atom, i: int, at: int = at) -> DataFrame:
                                return read_all(delta[atom.relation]) if i == at else self.read(atom.relation)

                            frames.append(rule_frame(self.spark, self.plan, r, read, first=at))
                if frames and (new := self.minus(reduce(DataFrame.unionAll, frames).distinct(), self.known[n], f"came-{n}")):
                    fresh[n] = new
            for n, new in fresh.items():
                came[n] += new
                self.known[n] = self._compact(n, self.known[n] + new)
                self.check(n)
            delta, first = {n: t for n, t in fresh.items() if any(d == n for r in rules for d, _ in dependencies(r))}, False
        return {n: (t, []) for n, t in came.items() if t}


