"""python -m rulewright.cli solve|manifest|profile|bench|describe|rows PROGRAM [FACTS] [OUT]: programs from files over folders of facts."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from rulewright.errors import BadRowError, LimitExceeded, MissingRelationError, ProgramError
from rulewright.operators.solve import Solver
from rulewright.plans.analyse import Plan, analyse, dependencies
from rulewright.plans.syntax import parse_file
from rulewright.sources.facts import read_facts_folder, read_parquet_folder, write_facts_file
from rulewright.sources.relations import page, select_rows
from rulewright.streaming.session import Session, digest


def session() -> SparkSession:
    return SparkSession.builder.appName("rulewright").getOrCreate()


def load(spark: SparkSession, plan: Plan, folder: str, form: str):
    return read_parquet_folder(spark, folder, plan) if form == "parquet" else read_facts_folder(spark, folder, plan)


def profile(solver: Solver) -> list[dict]:
    """Rows, seconds and rounds of every live relation, in the order of the strata."""
    out = []
    for s in solver.plan.strata:
        for name in s.relations:
            began = time.perf_counter()
            rows = solver.relation(name).count()
            out.append({"relation": name, "rows": rows, "seconds": round(time.perf_counter() - began, 3), "rounds": solver.rounds.get(name, 0), "rules": len(solver.plan.rules.get(name, []))})
    return out


def describe(plan: Plan, relation: str) -> dict:
    """A relation's columns, what makes it (input, inline facts, rules and what they read) and what reads it."""
    if relation not in plan.decls:
        raise MissingRelationError(f"no live relation is named {relation}")
    made = plan.rules.get(relation, [])
    return {
        "name": relation,
        "fields": [{"name": c, "type": str(t)} for c, t in plan.decls[relation].columns],
        "input": plan.inputs.get(relation),
        "output": plan.outputs.get(relation),
        "limit": plan.limits.get(relation),
        "facts": len(plan.facts.get(relation, ())),
        "rules": [{"reads": sorted({d for d, strict in dependencies(r) if not strict}), "needs_whole": sorted({d for d, strict in dependencies(r) if strict})} for r in made],
        "read_by": sorted({n for n, rules in plan.rules.items() for r in rules for d, _ in dependencies(r) if d == relation}),
    }


def rows(solver: Solver, relation: str, where: dict[str, str], limit: int, offset: int, source: str = "auto") -> dict:
    """A page of a relation's rows whose columns have the given values: solved ones, or with source facts those of the input alone."""
    if source == "facts" and relation not in solver.given:
        raise MissingRelationError(f"{relation} is no input")
    df = solver.given[relation] if source == "facts" else solver.relation(relation)
    found, more = page(select_rows(df, where), limit, offset)
    return {"fields": df.columns, "rows": [list(r) for r in found.collect()], "more": more}


def bench(spark: SparkSession, plan: Plan, facts: dict) -> dict:
    """A cold solve, then for each input a commit without its first row and one with it again; digests of all outputs."""
    timed = {}
    s = Session(spark, plan)

    def step(name: str, change: dict) -> None:
        began = time.perf_counter()
        s.commit(change)
        timed[name] = round(time.perf_counter() - began, 3)

    step("cold", facts)
    before = dict(s.output_digests)
    for n, df in facts.items():
        first = df.limit(1)
        step(f"{n} -1", {n: df.exceptAll(first)})
        step(f"{n} +1", {n: df})
    return {"seconds": timed, "outputs": {n: list(d) for n, d in s.output_digests.items()}, "restored": before == s.output_digests}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rulewright")
    p.add_argument("command", choices=["solve", "manifest", "profile", "bench", "describe", "rows"])
    p.add_argument("program")
    p.add_argument("facts", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--form", choices=["tsv", "parquet"], default="tsv")
    p.add_argument("--probe", action="append", default=[])
    p.add_argument("--relation")
    p.add_argument("--where", action="append", default=[], help="column=value")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--source", choices=["auto", "facts"], default="auto")
    a = p.parse_args(argv)
    try:
        plan = analyse(parse_file(a.program), a.probe)
        if a.command == "manifest":
            print(json.dumps(plan.manifest(), indent=2))
            return 0
        if a.command == "describe":
            print(json.dumps(describe(plan, a.relation), indent=2))
            return 0
        if not a.facts:
            p.error("a folder of facts is needed")
        spark = session()
        facts = load(spark, plan, a.facts, a.form)
        if a.command == "bench":
            print(json.dumps(bench(spark, plan, facts)))
            return 0
        solver = Solver(spark, plan, facts)
        if a.command == "rows":
            print(json.dumps(rows(solver, a.relation, dict(x.split("=", 1) for x in a.where), a.limit, a.offset, a.source), default=str))
            return 0
        if a.command == "profile":
            for row in profile(solver):
                print(json.dumps(row))
            return 0
        for name, df in solver.outputs().items():
            if a.out:
                write_facts_file(df, f"{a.out}/{plan.outputs[name]}")
            else:
                print(json.dumps({"output": name, "rows": df.count(), "digest": digest(df)}))
        return 0
    except (ProgramError, MissingRelationError, BadRowError, LimitExceeded) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
