"""From result rows to findings: representatives, evidence, severities, places, thresholds, baselines and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulewright.functions.ids import function_of, index_of, module_of

SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]


def representatives(df: DataFrame, keys: list[str], earliest: str | None = None, variants: tuple[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """One row for each key: the least one by column order, or first by the index of the instruction in earliest.

    variants: a column, and for some of its values other key columns than keys.
    """
    rank = ([F.coalesce(index_of(F.col(earliest)), F.lit(2**31 - 1)).alias("__at")] if earliest else []) + [F.col(f"`{c}`") for c in df.columns]
    if variants is None:
        group = [F.col(f"`{k}`") for k in keys]
    else:
        column, own = variants
        names = list(dict.fromkeys([*keys, *(k for ks in own.values() for k in ks)]))
        used = lambda k: F.lit(k in keys) if not own else F.coalesce(*(F.when(F.col(f"`{column}`") == v, F.lit(k in ks)) for v, ks in own.items()), F.lit(k in keys))
        group = [F.when(used(k), F.col(f"`{k}`").cast("string")).alias(f"__k{i}") for i, k in enumerate(names)]
        group.append(F.when(F.col(f"`{column}`").isin(*own), F.col(f"`{column}`")).alias("__variant"))
    return df.groupBy(*group).agg(F.min(F.struct(*rank)).alias("__row")).select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def with_evidence(findings: DataFrame, evidence: DataFrame, on: list[tuple[str, str]], limit: int, order: list[str], name: str = "related") -> DataFrame:
    """findings with an array of at most limit evidence rows that agree on the column pairs, least first."""
    keys = [b for _, b in on]
    first = Window.partitionBy(*keys).orderBy(*(F.col(f"`{c}`") for c in order))
    kept = evidence.distinct().withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= limit)
    frames = kept.groupBy(*(F.col(f"`{k}`").alias(f"__e{i}") for i, k in enumerate(keys))).agg(F.array_sort(F.collect_list(F.struct("__n", *(F.col(f"`{c}`") for c in evidence.columns)))).alias("__all"))
    rows = F.transform("__all", lambda x: F.struct(*(x[c].alias(c) for c in evidence.columns)))
    frames = frames.select(*(c for c in frames.columns if c != "__all"), rows.alias(name))
    both = findings.join(frames, [F.col(f"`{a}`") == F.col(f"__e{i}") for i, (a, _) in enumerate(on)], "left")
    return both.select(*(F.col(f"`{c}`") for c in findings.columns), F.coalesce(name, F.array().cast(frames.schema[name].dataType)).alias(name))


def _scale(names: list[str], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c).cast("int")


def step_down(severity: Column, steps: Column | int, floor: str = "info") -> Column:
    """A severity so many steps lower, not under the floor, and never higher than before."""
    at = _scale(SEVERITIES, severity)
    low = F.least(F.lit(SEVERITIES.index(floor) + 1), at)
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(at - steps, low))


def least_confident(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.least(_scale(CONFIDENCES, a), _scale(CONFIDENCES, b)))


def retier(findings: DataFrame, tooling: DataFrame, steps: int = 1, floor: str = "info") -> DataFrame:
    """Findings in modules of tooling(module, basis, confidence) one tier lower; a structural basis goes before a prior one."""
    rank = F.struct(F.when(F.col("basis") == "structural", 0).otherwise(1).alias("r"), F.col("basis").alias("b"), F.col("confidence").alias("c"))
    best = tooling.groupBy("module").agg(F.min(rank).alias("best")).select(F.col("module").alias("__module"), F.col("best.b").alias("basis"), F.col("best.c").alias("__c"))
    both = findings.join(best, findings["module"] == F.col("__module"), "left")
    found = F.col("__module").isNotNull()
    changed = {"severity": F.when(found, step_down(F.col("severity"), steps, floor)).otherwise(F.col("severity")), "confidence": F.when(found, least_confident(F.col("confidence"), F.col("__c"))).otherwise(F.col("confidence"))}
    return both.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in findings.columns), "basis")


def override(findings: DataFrame, ignore: DataFrame | None = None, severities: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Without ignored (analysis, title) pairs, and with other severities for some."""
    if ignore is not None:
        findings = findings.join(ignore.select("analysis", "title").distinct(), ["analysis", "title"], "left_anti")
    c = F.col("severity")
    for (analysis, title), severity in (severities or {}).items():
        c = F.when((F.col("analysis") == analysis) & (F.col("title") == title), severity).otherwise(c)
    return findings.withColumn("severity", c)


def locate(findings: DataFrame, lines: DataFrame, declared: DataFrame) -> DataFrame:
    """findings with file and line of their anchor: the instruction's own line, else its function's first, else its declaration's.

    lines: instruction, file, line. declared: module, file, line.
    """
    own = lines.groupBy("instruction").agg(F.min(F.struct("line", "file")).alias("p")).select(F.col("instruction").alias("anchor"), F.col("p").alias("__own"))
    first = lines.groupBy(function_of(F.col("instruction")).alias("__f")).agg(F.min(F.struct("line", "file")).alias("__first"))
    start = declared.groupBy(F.col("module").alias("__m")).agg(F.min(F.struct("line", "file")).alias("__start"))
    out = findings.withColumns({"__f": function_of(F.col("anchor")), "__m": module_of(F.col("anchor"))}).join(own, "anchor", "left").join(first, "__f", "left").join(start, "__m", "left")
    at = F.coalesce("__own", "__first", "__start")
    return out.select(*(F.col(f"`{c}`") for c in findings.columns), at["file"].alias("file"), at["line"].alias("line"))


def fails(findings: DataFrame, above: int | None = None, on: str | None = None) -> bool:
    """Whether there are more findings than above, or any of a severity of at least on."""
    if above is not None and findings.limit(above + 1).count() > above:
        return True
    return on is not None and not findings.filter(_scale(SEVERITIES, F.col("severity")) > SEVERITIES.index(on)).isEmpty()


def multiset_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that new has more often (__diff > 0) or less often (__diff < 0) than old, by one aggregation."""
    cols = [F.col(f"`{c}`") for c in new.columns]
    signed = new.select(*cols, F.lit(1).alias("__diff")).unionAll(old.select(*cols, F.lit(-1).alias("__diff")))
    return signed.groupBy(*cols).agg(F.sum("__diff").alias("__diff")).filter("__diff <> 0")


def summary(difference: DataFrame) -> DataFrame:
    """added and removed of each (analysis, title), those with the most changes first."""
    plus = F.sum(F.greatest("__diff", F.lit(0))).alias("added")
    minus = F.sum(F.greatest(-F.col("__diff"), F.lit(0))).alias("removed")
    out = difference.groupBy("analysis", "title").agg(plus, minus)
    return out.orderBy((F.col("added") + F.col("removed")).desc(), "analysis", "title")


def build(rows: DataFrame, builder: Callable[[dict], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """builder over every row on the executors, and the rows that made it fail (row, error): a crash costs one row."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({n: builder(row).get(n) for n in names} | {"__row": None, "__error": None})
                except Exception as e:
                    out.append(dict.fromkeys(names) | {"__row": json.dumps(row, default=str, sort_keys=True), "__error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "__row", "__error"])

    made = rows.mapInPandas(run, f"{schema}, __row string, __error string")
    return made.filter("__error is null").select(*names), made.filter("__error is not null").select(F.col("__row").alias("row"), F.col("__error").alias("error"))


# The keys of a finding in a report, in order.
REPORT_KEYS = {"analysis": "string", "severity": "string", "file": "string", "line": "int", "end_line": "int", "title": "string", "at_label": "string", "detail": "string", "help": "string", "provenance": "string", "confidence": "int", "related": "array<struct<label:string,file:string,line:int,end_line:int>>"}


def to_json(findings: DataFrame) -> DataFrame:
    """A line of JSON for each finding, with the report's keys in order; what a finding doesn't tell is null, provenance is structural and related is empty.

    Confidence is a prior's probability in thousandths; a structural finding has none.
    """
    usual = {"provenance": F.lit("structural"), "related": F.array()}
    have = dict(findings.dtypes)

    def column(name: str, kind: str):
        c = F.col(f"`{name}`") if name in have and not (name == "confidence" and have[name] == "string") else F.lit(None)
        if name == "related" and have.get(name) == "array<string>":
            c = F.transform(F.col("related"), lambda x: F.struct(x.alias("label"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line")))
        return (F.coalesce(c.cast(kind), usual[name].cast(kind)) if name in usual else c.cast(kind)).alias(name)

    return findings.select(F.to_json(F.struct(*(column(n, k) for n, k in REPORT_KEYS.items())), {"ignoreNullFields": "false"}).alias("value"))


def to_text(findings: DataFrame) -> DataFrame:
    """A line for each finding: place, severity, title; then a line for each related row."""
    place = F.when(F.col("file").isNull(), "?").otherwise(F.concat_ws(":", F.col("file"), F.col("line").cast("string")))
    head = F.concat(place, F.lit(": "), F.col("severity"), F.lit(": "), F.col("title"))
    if "related" in findings.columns:
        related = F.array_join(F.transform("related", lambda x: F.concat(F.lit("\n    "), F.to_json(x))), "")
        head = F.concat(head, related)
    return findings.select(head.alias("value"))
