"""Relations as stored things: rows selected by name, pages, facts written by relation, digests over chunks, published tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewright.errors import ProgramError
from rulewright.plans.analyse import Plan

from .facts import escaped, path_exists, read_facts
from .shared import Table, delete


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def select_rows(df: DataFrame, where: dict[str, object] | None = None, drop: list[str] = ()) -> DataFrame:
    """Rows whose columns have the given value, or one of a list of them, without the columns in drop. A column that isn't there fails."""
    unknown = sorted({*(where or {}), *drop} - set(df.columns))
    if unknown:
        raise ProgramError(f"no column is named {', '.join(unknown)}")
    for c, v in (where or {}).items():
        df = df.filter(F.col(f"`{c}`").isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(f"`{c}`") == v)
    return df.drop(*drop)


#: A page that starts further on is read from a sorted table, of which only the files that hold it are read.
DEEP = 100_000


def page(df: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, bool]:
    """The limit rows from offset on in the order of all columns, and whether more follow.

    Top-k on the executors up to DEEP rows. Beyond that the rows are sorted by ranges into files; their counts tell which files hold the
    page, so no task meets more than a few of them.
    """
    ordered, skip = df.orderBy(*_columns(df)), offset
    if offset > DEEP:
        sorted_ = Table(ordered, "sorted").read()
        counts = sorted_.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
        held, at = [], 0
        for r in counts:
            if at + r.n > offset and at < offset + limit + 1:
                skip = skip if held else offset - at
                held.append(r.file)
            at += r.n
        own = sorted_.filter(F.col("_metadata.file_path").isin(held))
        ordered, skip = own.orderBy(*_columns(df)), skip if held else 0
    more = ordered.offset(skip).limit(limit + 1).count() > limit
    return ordered.offset(skip).limit(limit), more


def write_by_relation(rows: DataFrame, path: str) -> None:
    """rows: relation, fields (array of strings). Appends to a folder of facts text for each relation; no relation is ever gathered."""
    lines = rows.select("relation", F.array_join(F.transform("fields", escaped), "\t").alias("value"))
    lines.write.mode("append").partitionBy("relation").option("lineSep", "\n").text(path)


def read_relation(spark: SparkSession, path: str, plan: Plan, relation: str) -> DataFrame:
    """A relation of what write_by_relation() wrote, typed as declared; all its chunks are one scan."""
    return read_facts(spark, f"{path}/relation={relation}", plan, relation)


def _sums(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """Hash columns of a row, and sums of them that tell multisets of rows apart."""
    h = [F.xxhash64(F.lit(k), *_columns(df)).alias(f"h{k}") for k in (1, 2)]
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return h, [F.count(F.lit(1)), *(total(F.pmod(f"h{k}", F.lit(2**31 - 1))) for k in (1, 2)), *(total(F.shiftright(f"h{k}", 33)) for k in (1, 2))]


def _joined(parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *(c.cast("string") for c in parts)), 256)


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """file, digest of a relation that is read from many files."""
    h, sums = _sums(chunks)
    named = chunks.select(F.col("_metadata.file_path").alias("file"), *h).groupBy("file").agg(*(c.alias(f"s{i}") for i, c in enumerate(sums)))
    return named.select("file", _joined([F.col(f"s{i}") for i in range(len(sums))]).alias("digest"))


def relation_digest(chunks: DataFrame) -> str:
    """A tree of hashes over the sorted digests of a relation's files: files may be renamed and come in any order."""
    sealed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    leaves = chunk_digests(chunks).groupBy(F.substring("digest", 1, 3).alias("bucket")).agg(sealed("digest").alias("digest"))
    return leaves.agg(sealed("digest")).first()[0]


def rows_digest(df: DataFrame) -> str:
    """Of the multiset of rows and the columns' names and types, wherever the rows are stored."""
    h, sums = _sums(df)
    row = df.select(*h).agg(*sums).first()
    return hashlib.sha256("|".join([df.schema.simpleString(), *map(str, row)]).encode()).hexdigest()


def publish(df: DataFrame, root: str) -> str:
    """Writes df as Parquet in a folder named by its rows' digest and returns the path; a folder that is there already is adopted.

    The folder gets its name when it is whole. Of two writers of one table the later one adopts the first one's.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{rows_digest(df)}"
    if path_exists(spark, path):
        return path
    mine = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(mine)
    to, at = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, mine))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if path_exists(spark, path) or not fs.rename(at, to):
        delete(spark, mine)
    return path
