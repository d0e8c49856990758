"""What the text operators share: row locators, shared tables, text normalisation."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Runs of what is no word character: ASCII without digits and lower-case letters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Locator columns: a hash of the file's path, and the row's index in that file.
FILE, ROW = "__rw_file", "__rw_row"
LOCATOR = [FILE, ROW]
_PLAIN = {"LogicalRelation", "Relation", "Project", "Filter", "SubqueryAlias", "View"}


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column) -> Column:
    """The words between runs of NON_WORD, with an empty first or last one where the text starts or ends in such a run."""
    return F.split(lower_ascii(or_empty(c)), NON_WORD)


def word_count(w: Column) -> Column:
    """The number of words in what words() gives."""
    n = F.size(w)
    return (n - (F.element_at(w, 1) == "").cast("int") - ((n > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a local master without it gets one in /tmp/checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MARKED: set[str] = set()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the driver's JVM ends."""
    own = f"{checkpoint_root(spark)}/rulewright/{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        _MARKED.add(own)
        fs, at = _file_system(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """The rows from a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rw_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what materialise() wrote; nothing that reads it may run afterwards."""
    delete_path(df.sparkSession, df._rw_path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The full paths in a folder; none where there is no such folder."""
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []


def _plain_scan(df: DataFrame) -> bool:
    def walk(p) -> bool:
        kids = p.children()
        return p.nodeName().split(" ")[0] in _PLAIN and kids.size() <= 1 and all(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().analyzed())


def with_locator(docs: DataFrame) -> DataFrame:
    """docs with FILE and ROW, which name each row for good: repeated and null ids don't matter.

    A plain Parquet scan has them already; the rows of any other plan are written to the shared folder first.
    """
    for again in (False, True):
        if again:
            docs = materialise(docs, "located")
        try:
            if again or _plain_scan(docs):
                meta = docs.metadataColumn("_metadata")
                return docs.select("*", F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(ROW))
        except AnalysisException:
            if again:
                raise
    raise AssertionError


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
