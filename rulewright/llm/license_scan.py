"""License scans: ordered signature rules behind a keyword prefilter, with priorities and suppression of contained finds.

A text without any rule's keyword costs one split. In the others, the rules whose keyword occurs are matched over
the words joined by spaces; a find that lies within another of no lower priority is dropped, and of equal spans the
first rule of the highest priority stays. All of it is one projection: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, word_count, words
from .license_rules import KINDS, rules

_FIND = "struct<start:int,end:int,priority:int,rule:int,label:string,score:double,base:boolean>"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rule_table() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.base).alias("base")) for i, r in enumerate(rules())))


def _finds(text: Column, r: Column) -> Column:
    """Where the rule matches: first and last word of each match."""
    found, gaps = F.regexp_extract_all(text, r["pattern"], F.lit(0)), F.split(text, r["pattern"])
    both = F.arrays_zip(found.alias("found"), gaps.alias("gaps"))
    at = lambda acc, x: acc["at"] + _spaces(x["gaps"])

    def step(acc: Column, x: Column) -> Column:
        start, more = at(acc, x) - 1, _spaces(x["found"])
        find = F.struct(start.cast("int").alias("start"), (start + more).cast("int").alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base"))
        return F.struct((at(acc, x) + more).cast("int").alias("at"), F.concat(acc["out"], F.array(find)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FIND}>").alias("out"))
    return F.aggregate(F.filter(both, lambda x: x["found"].isNotNull()), start, step, lambda acc: acc["out"])


def _suppressed(finds: Column) -> Column:
    """Sorted finds without those that lie within one of no lower priority."""
    sort_key = F.transform(finds, lambda f: F.struct(f["start"].alias("start"), (-f["end"]).alias("back"), (-f["priority"]).alias("weak"), f["rule"].alias("rule"), f.alias("find")))
    ordered = F.transform(F.array_sort(sort_key), lambda x: x["find"])
    levels = sorted({p for p, _ in KINDS.values()})
    start = F.struct(*(F.lit(-1).alias(f"m{p}") for p in levels), F.array().cast(f"array<{_FIND}>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        above = F.greatest(*(F.when(f["priority"] <= p, acc[f"m{p}"]).otherwise(-1) for p in levels))
        return F.struct(
            *(F.when(f["priority"] == p, F.greatest(acc[f"m{p}"], f["end"])).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in levels),
            F.when(above >= f["end"], acc["out"]).otherwise(F.concat(acc["out"], F.array(f))).alias("out"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs' columns with n_words, base_finds and finds (arrays of start, end, priority, rule, label, score, base).

    Null and empty texts have no words and no finds. Rows are scanned one by one, so ties and repeated rows
    give equal results; a column of docs named like one of these is replaced.
    """
    table = _rule_table()
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in rules()})))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "base_finds", "finds")]
    w = docs.select(*own, words(F.col("text")).alias("__rw_words"))
    text = F.concat(F.lit(" "), F.array_join(F.filter("__rw_words", lambda x: x != ""), " "), F.lit(" "))
    has = F.array_intersect("__rw_words", keywords)
    tried = F.filter(table, lambda r: F.array_contains(F.col("__rw_has"), r["keyword"]))
    none = F.array().cast(f"array<{_FIND}>")
    gate = F.arrays_overlap("__rw_words", keywords)
    staged = w.withColumns({"n_words": word_count(F.col("__rw_words")), "__rw_has": F.when(gate, has), "__rw_text": F.when(gate, text)})
    finds = F.flatten(F.transform(tried, lambda r: _finds(F.col("__rw_text"), r)))
    staged = staged.withColumn("__rw_all", F.when(F.col("__rw_has").isNotNull(), finds).otherwise(none))
    return staged.select(*own, "n_words", F.filter("__rw_all", lambda f: f["base"]).alias("base_finds"), F.when(F.size("__rw_all") > 0, _suppressed(F.filter("__rw_all", lambda f: ~f["base"]))).otherwise(none).alias("finds"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda finds: F.array_distinct(F.transform(finds, lambda f: f["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    starts = F.transform("base_finds", lambda f: f["start"])
    best = lambda finds: F.aggregate(finds, F.lit(0.0), lambda a, f: F.greatest(a, f["score"]))
    base, all_finds = F.col("base_finds"), F.concat("base_finds", "finds")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(label(base)).alias("base_labels"),
        joined(label(all_finds)).alias("labels"),
        best(all_finds).alias("score"),
    )
