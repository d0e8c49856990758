"""Extractors, analyses and priors: rows from modules, findings from programs, answers from a classifier.

An extractor is a table function over modules. An analysis is a program with outputs that become findings; one that
meets a row limit or lacks facts costs its own findings and is named in the record of degradations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewright.errors import LimitExceeded, MissingRelationError, ProgramError
from rulewright.plans.analyse import analyse
from rulewright.plans.expand import variables
from rulewright.plans.syntax import Agg, Atom, Const, Program, Rule, Var, Wild, parse
from rulewright.sources.catalogue import Catalogue, RelationSpec

from .findings import representatives, with_evidence
from .solve import Solver


class Extractor(Protocol):
    """What a table function over modules must have; candidate() may spare it modules that it has nothing to say of."""

    name: str

    def relations(self) -> list[RelationSpec]: ...
    def candidate(self, module: dict) -> bool: ...
    def extract(self, module: dict) -> dict[str, list[tuple]]: ...


def run_extractors(modules: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """relation, fields, extractor, error: a row for each fact, and one with an error for each module that made an extractor fail.

    Modules are read in Arrow batches, one at a time; a failure costs the facts of one extractor over one module.
    """
    known = {e.name: {s.name: len(s.columns) for s in e.relations()} for e in extractors}

    def run(batches):
        for pdf in batches:
            out = []
            for module in pdf.to_dict("records"):
                for e in extractors:
                    try:
                        if not e.candidate(module):
                            continue
                        rows = []
                        for relation, facts in e.extract(module).items():
                            for fact in facts:
                                if len(fact) != known[e.name].get(relation):
                                    raise ValueError(f"{relation} doesn't take {fact!r}")
                                rows.append((relation, [str(x) for x in fact], e.name, None))
                        out += rows
                    except Exception as why:
                        out.append((None, None, e.name, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(out, columns=["relation", "fields", "extractor", "error"])

    return modules.mapInPandas(run, "relation string, fields array<string>, extractor string, error string")


def extracted(rows: DataFrame, spec: RelationSpec) -> DataFrame:
    """One relation of what run_extractors() gives, typed."""
    own = rows.filter(F.col("relation") == spec.name)
    return Catalogue([spec]).with_meanings(spec.name, own.select(*(F.get("fields", F.lit(i)).alias(f"c{i}") for i in range(len(spec.columns)))))


@dataclass
class Output:
    """An output that becomes findings. key: columns of which equal rows are one finding. detail: text with {column} in it."""

    title: str
    severity: str
    detail: str
    anchor: str
    key: list[str] | None = None
    earliest: str | None = None
    confidence: str = "high"
    evidence: tuple[str, list[tuple[str, str]], int] | None = None


@dataclass
class Analysis:
    name: str
    description: str
    program: str
    outputs: dict[str, Output] = field(default_factory=dict)


@dataclass
class Findings:
    findings: DataFrame
    degraded: list[tuple[str, str]]


FINDING = "analysis string, relation string, title string, severity string, confidence string, anchor string, detail string, related array<string>"


def template(text: str, columns: list[str]) -> Column:
    """text with each {column} replaced by the column's value."""
    parts = re.split(r"\{(\w+)\}", text)
    missing = sorted(set(parts[1::2]) - set(columns))
    if missing:
        raise ProgramError(f"{text!r} has no column {', '.join(missing)}")
    return F.concat(*(F.col(f"`{p}`").cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def by_key(program: Program, relation: str, o: Output) -> str | None:
    """Adds the relation's rows by the key alone, where a finding tells nothing else of its row: one for each key from the start."""
    rules = [(r, h) for r in program.rules for h in r.heads if h.relation == relation]
    columns = [c for c, _ in program.decls[relation].columns] if relation in program.decls else []
    used = {o.anchor, *re.findall(r"\{(\w+)\}", o.detail), *(c for c, _ in (o.evidence[1] if o.evidence else []))}
    if o.key is None or not used <= set(o.key) < set(columns) or not rules or relation in program.inputs or relation in program.limits:
        return None
    if any(isinstance(a, Agg) for _, h in rules for a in h.args) or any(not r.body for r, _ in rules):
        return None
    name, kept = f"{relation}__key", [i for i, c in enumerate(columns) if c in o.key]
    program.decls[name] = replace(program.decls[relation], name=name, columns=type(program.decls[relation].columns)(program.decls[relation].columns[i] for i in kept), mutable=False)
    for r, h in rules:
        args = tuple(h.args[i] for i in kept)
        times = Counter(v for x in (args, *r.body) for v in variables(x))
        lone = lambda x, b=times: isinstance(x, Var) and b[x.name] == 1
        body = tuple(Atom(x.relation, tuple(Wild() if lone(v) and x.args.count(v) == 1 else v for v in x.args)) if isinstance(x, Atom) and all(isinstance(v, (Var, Wild, Const)) for v in x.args) else x for x in r.body)
        program.rules.append(Rule((Atom(name, args),), body))
    return name


def findings_of(analysis: Analysis, relation: str, made: dict[str, DataFrame], single: bool = False) -> DataFrame:
    """The rows of one output as findings, one for each key (single: they are so already), with evidence rows of another output as related text."""
    o, df = analysis.outputs[relation], made[relation]
    columns = df.columns
    if o.key is not None and not single:
        df = representatives(df, o.key, o.earliest)
    related = F.array().cast("array<string>")
    if o.evidence:
        other, on, limit = o.evidence
        df = with_evidence(df, made[other], on, limit, made[other].columns, "__related")
        related = F.transform("__related", lambda x: F.to_json(x))
    return df.select(
        F.lit(analysis.name).alias("analysis"), F.lit(relation).alias("relation"), F.lit(o.title).alias("title"), F.lit(o.severity).alias("severity"),
        F.lit(o.confidence).alias("confidence"), F.col(f"`{o.anchor}`").cast("string").alias("anchor"), template(o.detail, columns).alias("detail"), related.alias("related"),
    )


def run_analyses(spark: SparkSession, analyses: list[Analysis], facts: dict[str, DataFrame], nulls: str = "reject", jobs: int = 4) -> Findings:
    """All analyses over the same facts, some at a time."""
    from rulewright.sources.shared import Table

    def run(a: Analysis) -> tuple[list[DataFrame], str | None]:
        solver = None
        try:
            evidence = [o.evidence[0] for o in a.outputs.values() if o.evidence]
            parsed = parse(a.program, a.name)
            keyed = {n: by_key(parsed, n, o) for n, o in a.outputs.items() if n not in evidence}
            keyed = {n: k for n, k in keyed.items() if k}
            parsed.outputs = {}
            plan = analyse(parsed, [*(keyed.get(n, n) for n in a.outputs), *evidence])
            solver = Solver(spark, plan, {n: facts[n] for n in plan.inputs if n in facts}, nulls)
            made = {n: Table(solver.relation(keyed.get(n, n)), f"finding-{n}".replace(".", "-")).read() for n in [*a.outputs, *evidence]}
            return [findings_of(a, n, made, single=n in keyed) for n in a.outputs], None
        except (LimitExceeded, MissingRelationError) as why:
            return [], f"{type(why).__name__}: {why}"
        finally:
            if solver:
                solver.release()

    with ThreadPoolExecutor(jobs) as pool:
        done = list(pool.map(run, analyses))
    out = spark.createDataFrame([], FINDING)
    for frames, _ in done:
        for f in frames:
            out = out.unionByName(f)
    return Findings(out, [(a.name, why) for a, (_, why) in zip(analyses, done, strict=True) if why])


def ask(items: DataFrame, key: str, known: DataFrame, classify: Callable[[list], list] | None = None, batch: int = 10, schema: str = "answer string") -> DataFrame:
    """key and answer for the items that are known or that classify answers, in batches; items without an answer give no row.

    known: key and the answer's columns. A batch that fails gives none, so a later run asks again.
    """
    kept = items.select(key).distinct().join(known, key)
    if classify is None:
        return kept
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            values, out = pdf[key].tolist(), []
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                try:
                    out += [(v, *a) for v, a in zip(part, classify(part), strict=True) if a is not None]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=[key, *names])

    new = items.select(key).distinct().join(known.select(key), key, "left_anti")
    kind = items.schema[key].dataType.simpleString()
    return kept.unionByName(new.mapInPandas(run, f"{key} {kind}, {schema}"))
