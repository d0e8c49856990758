"""Kept programs: commits of changed inputs, output deltas, cutoffs, limits that poison, a solve cache and streams.

A commit names the inputs that changed, or the rows that came and went. Inputs whose rows are what they were are dropped from it; relations that no change
reaches keep their tables, and the others take up the change. All state is tables in the shared folder; what a commit replaces is dropped by the one after it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulewright.errors import BadRowError, LimitExceeded, MissingRelationError, PoisonedSession, ProgramError, ReadFailed, StalePreviousError, UnknownRelationError, WriteFailed
from rulewright.operators.solve import Solver, bind
from rulewright.plans.analyse import Plan, analyse
from rulewright.plans.syntax import Program, parse
from rulewright.sources.shared import Table, read_all

from .maintain import Relations


def digest(df: DataFrame) -> tuple:
    """Of the multiset of rows: their number, and sums of two hashes of each."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    h = [F.xxhash64(F.lit(k), *cols) for k in (1, 2)]
    parts = [F.sum(F.pmod(x, F.lit(2**31 - 1)).cast("decimal(38,0)")) for x in h] + [F.sum(F.shiftright(x, 33).cast("decimal(38,0)")) for x in h]
    return tuple(str(x) for x in df.agg(F.count(F.lit(1)), *parts).first())


def difference(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Rows with __diff 1 for each that came and -1 for each that went, of two sets."""
    cols = [F.col(f"`{c}`") for c in new.columns]
    came = new.select(*cols, F.lit(1).alias("__diff"))
    if old is None:
        return came
    return consolidate(came.unionAll(old.select(*cols, F.lit(-1).alias("__diff"))))


def consolidate(signed: DataFrame) -> DataFrame:
    """One row for each distinct one, with the sum of its signs; rows of sum 0 vanish."""
    cols = [c for c in signed.columns if c != "__diff"]
    return signed.groupBy(*(F.col(f"`{c}`") for c in cols)).agg(F.sum("__diff").cast("int").alias("__diff")).filter("__diff <> 0")


@dataclass
class Commit:
    """What a commit changed: the epoch, and for each changed output its rows and its signed rows. They can be read until the next commit but one."""

    epoch: int
    changed: dict[str, DataFrame] = field(default_factory=dict)
    deltas: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def _reason(e: Exception, relation: str) -> Exception:
    """The typed error of an input that couldn't be written as a table."""
    text = str(e)
    first = next((x.strip() for x in text.split("\n") if "[" in x), text[:200])
    if "USER_RAISED_EXCEPTION" in text or "CAST_" in text:
        return BadRowError(f"{relation}: {first}")
    if any(x in text for x in ("FAILED_READ_FILE", "PATH_NOT_FOUND", "FileNotFound", "FILE_NOT_EXIST")):
        return ReadFailed(f"{relation}: {first}")
    return WriteFailed(f"{relation}: {first}")


class Session:
    """A program that is kept over commits, each of which costs what it changes: see Relations."""

    def __init__(self, spark: SparkSession, program: str | Program | Plan, nulls: str = "reject", probes: list[str] = ()):
        self.spark = spark
        self.plan = program if isinstance(program, Plan) else analyse(parse(program) if isinstance(program, str) else program, probes)
        self.nulls, self.epoch, self.poisoned = nulls, 0, False
        self.relations = Relations(spark, self.plan)
        self.old: list[Table] = []

    def commit(self, facts: dict[str, DataFrame], previous: int | None = None, rewrite: bool = False) -> Commit:
        """Replaces the named inputs. The first commit names them all. previous, if given, must be the session's epoch."""
        return self._commit({n: ("replace", df) for n, df in facts.items()}, previous, rewrite)

    def change(self, added: dict[str, DataFrame] | None = None, removed: dict[str, DataFrame] | None = None, previous: int | None = None) -> Commit:
        """Adds rows to inputs and removes rows from others: the rest of an input isn't read to be written again when rows are only added."""
        both = sorted(set(added or {}) & set(removed or {}))
        if both:
            raise ProgramError(f"{', '.join(both)}: rows are added and removed in commits of their own")
        return self._commit({n: ("add", df) for n, df in (added or {}).items()} | {n: ("remove", df) for n, df in (removed or {}).items()}, previous)

    def _commit(self, changes: dict[str, tuple[str, DataFrame]], previous: int | None, rewrite: bool = False) -> Commit:
        if self.poisoned:
            raise PoisonedSession("an earlier commit met a limit")
        if previous is not None and previous != self.epoch:
            raise StalePreviousError(f"the session is at {self.epoch}, not {previous}")
        unknown = sorted(set(changes) - set(self.plan.inputs))
        if unknown:
            raise UnknownRelationError(f"no input is named {', '.join(unknown)}")
        if not self.epoch and set(self.plan.inputs) - set(changes):
            raise MissingRelationError(f"the first commit lacks {', '.join(sorted(set(self.plan.inputs) - set(changes)))}")
        now, inputs = self.relations.copy(), {}
        try:
            for n, (how, df) in changes.items():
                try:
                    if n not in now.given and how != "replace":
                        now.given[n] = [now.table(self.spark.createDataFrame([], self.plan.schema(n)), f"input-{n}")]
                    inputs[n] = getattr(now, how)(n, bind(self.plan, n, df, self.nulls).distinct())
                except (PySparkException, Py4JJavaError) as e:
                    raise _reason(e, n) from e
            moved = now.update(inputs) if not self.epoch or any(came or went for came, went in inputs.values()) else {}
        except Exception as e:
            self.poisoned = isinstance(e, LimitExceeded)
            for t in now.made:
                t.drop()
            raise
        self.epoch += 1
        out = Commit(self.epoch)
        for n in sorted(self.plan.outputs):
            if n in moved or rewrite or self.epoch == 1:
                came, went = moved.get(n, ([], []))
                signed = [read_all(t).select("*", F.lit(sign).alias("__diff")) for t, sign in ((came, 1), (went, -1)) if t]
                empty = now.read(n).limit(0).select("*", F.lit(1).alias("__diff"))
                out.changed[n], out.deltas[n] = now.read(n), reduce(DataFrame.unionAll, signed) if signed else empty
            else:
                out.skipped.append(n)
        # What this commit replaced may be read by what it returns; what the one before it left goes now.
        kept = now.tables()
        for t in self.old:
            if t.path not in kept:
                t.drop()
        self.old = [t for t in (*self.relations.tables().values(), *now.made) if t.path not in kept]
        now.made = []
        self.relations = now
        return out

    @property
    def output_digests(self) -> dict[str, tuple]:
        return {n: digest(self.result(n)) for n in sorted(self.plan.outputs)}

    def result(self, output: str) -> DataFrame:
        if output not in self.plan.outputs:
            raise UnknownRelationError(f"no output is named {output}")
        if not self.epoch:
            raise MissingRelationError("nothing was committed")
        return self.relations.read(output)

    def close(self) -> None:
        """Drops all tables; nothing that came from the session can be read afterwards."""
        for t in {**self.relations.tables(), **{t.path: t for t in self.old}}.values():
            t.drop()
        self.relations, self.old, self.epoch = Relations(self.spark, self.plan), [], 0


class SolveCache:
    """Outputs by the program's text and the digests of its inputs."""

    def __init__(self, spark: SparkSession, most: int = 32):
        self.spark, self.most = spark, most
        self.known: dict[tuple, dict[str, Table]] = {}
        self.hits = 0

    def solve(self, text: str, facts: dict[str, DataFrame], nulls: str = "reject") -> dict[str, DataFrame]:
        plan = analyse(parse(text))
        bound = {n: bind(plan, n, df, nulls).distinct() for n, df in facts.items() if n in plan.inputs}
        key = (text, *sorted((n, digest(df)) for n, df in bound.items()))
        if key in self.known:
            self.hits += 1
            self.known[key] = self.known.pop(key)
        else:
            solver = Solver(self.spark, plan, bound, nulls)
            self.known[key] = {n: Table(df, f"cached-{n}".replace(".", "-")) for n, df in solver.outputs().items()}
            solver.release()
            while len(self.known) > self.most:
                for t in self.known.pop(next(iter(self.known))).values():
                    t.drop()
        return {n: t.read() for n, t in self.known[key].items()}


def drive(stream: DataFrame, session: Session, relation: str, checkpoint: str, sink=None):
    """Starts a streaming query whose batches are added to one input of a session and committed; sink(commit) gets the changes. Earlier batches aren't written again.

    A batch that is run again after a failure adds no row twice, as relations are sets.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        commit = session.change({relation: batch})
        if sink:
            sink(commit)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
