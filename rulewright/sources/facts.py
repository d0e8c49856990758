"""Facts as tab-separated text: one relation a file, escapes without quoting, no nulls. Also Parquet folders."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewright.errors import BadRowError, MissingRelationError
from rulewright.plans.analyse import Plan

from .shared import delete

_UNESCAPE = re.compile(r"\\(\\|t|n|r|x[0-9A-Fa-f]{2})")
_PLAIN = {"\\": "\\", "t": "\t", "n": "\n", "r": "\r"}


def encode_field(value: str | bytes | int) -> str:
    """A field of a line: backslash, tab, line feed, carriage return and bytes that aren't UTF-8 are escaped."""
    if isinstance(value, bytes):
        value = value.decode("utf-8", "surrogateescape")
    text = str(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "".join(f"\\x{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text)


def decode_field(text: str) -> str | bytes:
    """The value of a field; an unknown escape stays as it is. Bytes where it isn't UTF-8."""
    out, at = bytearray(), 0
    for m in _UNESCAPE.finditer(text):
        out += text[at : m.start()].encode()
        out += bytes([int(m[1][1:], 16)]) if m[1][0] == "x" else _PLAIN[m[1]].encode()
        at = m.end()
    out += text[at:].encode()
    try:
        return out.decode()
    except UnicodeDecodeError:
        return bytes(out)


def encode_rows(rows: Iterable[Iterable]) -> str:
    return "".join("\t".join(map(encode_field, row)) + "\n" for row in rows)


def decode_rows(text: str) -> list[list]:
    """Rows of a file's text: only a last line feed is dropped, so an empty line is a row of one empty field."""
    if not text:
        return []
    return [list(map(decode_field, line.split("\t"))) for line in (text[:-1] if text.endswith("\n") else text).split("\n")]


def escaped(c: Column) -> Column:
    """A column's text with escapes. In a value whose bytes aren't UTF-8 every byte that is no plain character is escaped."""
    plain = c
    for raw, to in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        plain = F.replace(plain, F.lit(raw), F.lit(to))
    byte = lambda h: F.when(h.between("20", "7E") & (h != "5C"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("\\x"), h))
    bytewise = F.array_join(F.transform(F.regexp_extract_all(F.hex(c.cast("binary")), F.lit(".."), F.lit(0)), byte), "")
    return F.when(F.is_valid_utf8(c), plain).otherwise(bytewise)


def unescaped(c: Column) -> Column:
    """The value of an escaped column. Escaped bytes are put back as bytes, which need not be UTF-8 together: Spark's strings hold them as they are."""
    held = F.replace(c, F.lit("\\\\"), F.lit("\\\x00"))  # a doubled backslash must not start an escape
    for to, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        held = F.replace(held, F.lit(to), F.lit(raw))
    plain = F.replace(held, F.lit("\\\x00"), F.lit("\\"))
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)\\x[0-9A-Fa-f]{2}|\\.|[^\\]+|\\$"), F.lit(0))
    special = F.create_map(*(F.lit(x) for pair in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")) for x in pair))
    one = lambda t: F.when(t.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.unhex(F.substr(t, F.lit(3), F.lit(2)))).otherwise(F.coalesce(special[t], t).cast("binary"))
    bytewise = F.aggregate(F.transform(tokens, one), F.lit(b""), lambda acc, x: F.concat(acc, x)).cast("string")
    return F.when(c.rlike(r"\\x[0-9A-Fa-f]{2}"), bytewise).otherwise(plain)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_facts(spark: SparkSession, path: str, plan: Plan, relation: str, raw: bool = False) -> DataFrame:
    """A facts file as the relation's typed rows; a line of another width or a number that is none fails the job.

    raw keeps escapes as they stand, as rules that only pass values on may.
    """
    if not path_exists(spark, path):
        raise MissingRelationError(f"{relation} has no facts at {path}")
    columns = plan.decls[relation].columns
    fields = F.split(F.col("value"), "\t", -1)
    message = F.concat(F.lit(f"{relation}: not {len(columns)} fields: "), F.col("value"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.when(F.size(fields) == len(columns), fields).otherwise(F.raise_error(message).cast("array<string>")).alias("f"))
    out = []
    for i, (name, kind) in enumerate(columns):
        c = F.get("f", F.lit(i))
        if kind == "symbol":
            c = c if raw else unescaped(c)
        else:
            sound = c.rlike(r"\A[+-]?[0-9]+\z") if kind in ("number", "long") else F.lit(True)
            c = F.when(sound, c.try_cast(plan.spark_type(kind)))
            c = F.coalesce(c, F.raise_error(F.concat(F.lit(f"{relation}.{name} isn't a {kind}: "), F.get("f", F.lit(i)))).cast(plan.spark_type(kind)))
        out.append(c.alias(name))
    return lines.select(*out)


def read_facts_folder(spark: SparkSession, folder: str, plan: Plan, raw: bool = False) -> dict[str, DataFrame]:
    """All inputs of a plan from files of their declared names; a missing file is an error, never an empty relation."""
    return {n: read_facts(spark, f"{folder}/{file}", plan, n, raw) for n, file in plan.inputs.items()}


def read_parquet_folder(spark: SparkSession, folder: str, plan: Plan, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All inputs of a plan from Parquet tables named like them, or as names says."""
    out = {}
    for n in plan.inputs:
        path = f"{folder}/{(names or {}).get(n, n)}.parquet"
        if not path_exists(spark, path):
            raise MissingRelationError(f"{n} has no table at {path}")
        out[n] = spark.read.parquet(path)
    return out


def write_facts(df: DataFrame, path: str, ordered: bool = True) -> None:
    """A folder of tab-separated text; ordered by all columns over the whole table, bytes for strings, file after file."""
    rows = df.orderBy(*(F.col(f"`{c}`") for c in df.columns)) if ordered else df
    fields = [escaped(F.col(f"`{c}`").cast("string")) for c in df.columns]
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_facts_file(df: DataFrame, path: str) -> None:
    """One sorted file at path, for outputs that another tool reads whole."""
    spark, folder = df.sparkSession, f"{path}.parts"
    rows = df.select(F.concat_ws("\t", *(escaped(F.col(f"`{c}`").cast("string")) for c in df.columns)).alias("value"))
    rows.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").option("lineSep", "\n").text(folder)
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-")]
    fs.delete(to, True)
    fs.rename(found[0], to) if found else fs.create(to).close()
    delete(spark, folder)


def parse_rows(plan: Plan, relation: str, text: str) -> list[tuple]:
    """Rows of a small facts text on the driver, typed; BadRowError names the first bad line."""
    out = []
    for k, fields in enumerate(decode_rows(text), 1):
        columns = plan.decls[relation].columns
        if len(fields) != len(columns):
            raise BadRowError(f"{relation}:{k}: {len(fields)} fields, not {len(columns)}")
        row = []
        for (name, kind), x in zip(columns, fields, strict=True):
            if kind in ("number", "long"):
                if not (isinstance(x, str) and re.fullmatch(r"[+-]?[0-9]+", x, re.A)):
                    raise BadRowError(f"{relation}:{k}: {name} isn't a number: {x!r}")
                x = int(x)
                if kind == "number" and not -(2**31) <= x < 2**31:
                    raise BadRowError(f"{relation}:{k}: {name} isn't a 32-bit number: {x}")
            row.append(x)
        out.append(tuple(row))
    return out
