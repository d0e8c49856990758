"""Programs in stages: outputs of one are inputs of the next, and a stage that meets its row limit has another way."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rulewright.errors import LimitExceeded
from rulewright.plans.analyse import analyse
from rulewright.plans.syntax import parse
from rulewright.sources.shared import Table

from .solve import Solver


@dataclass
class Stage:
    """A program, and programs of the same outputs that stand in for it, in order, when rows pass a limit."""

    name: str
    program: str
    fallbacks: list[str] = field(default_factory=list)


@dataclass
class Staged:
    outputs: dict[str, DataFrame]
    chosen: dict[str, int]
    degraded: list[tuple[str, str]]


def run_stages(spark: SparkSession, stages: list[Stage], facts: dict[str, DataFrame], nulls: str = "reject", wanted: list[str] | None = None) -> Staged:
    """All stages in order, with the outputs that are wanted (all, if not told). Which program of a stage runs depends on the facts alone, never on time."""
    known, chosen, degraded = dict(facts), {}, []
    for stage in stages:
        programs = [stage.program, *stage.fallbacks]
        for k, text in enumerate(programs):
            parsed = parse(text, stage.name)
            if wanted is not None:
                parsed.outputs = {n: path for n, path in parsed.outputs.items() if n in wanted}
            plan = analyse(parsed)
            solver = Solver(spark, plan, {n: known[n] for n in plan.inputs if n in known}, nulls)
            try:
                made = {n: Table(df, f"stage-{n}".replace(".", "-")).read() for n, df in solver.outputs().items()}
            except LimitExceeded as e:
                degraded.append((stage.name, str(e)))
                if k + 1 == len(programs):
                    raise
                continue
            finally:
                solver.release()
            chosen[stage.name] = k
            known |= made
            break
    return Staged(known, chosen, degraded)
