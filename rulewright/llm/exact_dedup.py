"""Exact dedup: a stream with disk-backed keyed state that never expires, and a check of full bytes on hits.

Arrivals (digest, id, length, locator) run through Structured Streaming. Its RocksDB state keeps for every digest
the best row seen so far, with its stable identifier and content locator, and a count. Then all rows whose digest
has company are read again by locator and their whole texts are grouped: a digest that stands for several texts is
split by text. A hot text is folded in each task before any exchange. dedup_crawl() keeps the state in a folder of the caller's, so
that a later crawl goes on from it.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import FILE, LOCATOR, ROW, WHITE, exists, list_folder, materialise, or_empty, read_table, sha256_hex, shared_path, with_locator

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore"
#: Keyed state on disk; all stores of an executor share one bounded cache, a commit writes a change log, and files take no space ahead of use.
STATE = {
    f"{_STORE}.providerClass": ROCKSDB,
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(or_empty(text), WHITE, "")


def _rank() -> Column:
    """Orders rows so that the one that stays is the smallest: most code points, then smallest id (null last), then place."""
    return F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def _state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with spark's settings and those of STATE: what runs beside it in other threads keeps its own."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.get(k, None) != v and own.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in STATE.items():
        own.conf.set(k, v)
    return own


def stream_state(spark: SparkSession, schema: StructType, path: str, state: str, bytes_per_trigger: int = 2 << 30, files_per_trigger: int | None = None) -> DataFrame:
    """digest, best (a rank), n of all arrivals at path (and below), through keyed state without expiry that stays in the folder state.

    Called again with the same folders, the stream goes on where it stopped, after a failure too: only new files are read.
    """
    out, own = f"{state}/batches", _state_session(spark)
    stream = own.readStream.schema(schema).option("recursiveFileLookup", "true")
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream.option("maxBytesPerTrigger", bytes_per_trigger)
    kept = stream.parquet(path).groupBy("digest").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))

    def sink(updated: DataFrame, batch: int) -> None:
        updated.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    kept.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    fields = "digest string, best " + kept.schema["best"].dataType.simpleString() + ", n long"
    batches = [p for p in list_folder(spark, out) if p.rsplit("/", 1)[1].startswith("batch=")]
    if not batches:
        return spark.createDataFrame([], fields)
    if len(batches) == 1:
        return spark.read.schema(fields).parquet(batches[0])
    rows = spark.read.schema(f"{fields}, batch long").option("basePath", out).parquet(*batches)
    return rows.groupBy("digest").agg(F.max(F.struct("batch", "best", "n")).alias("last")).select("digest", "last.best", "last.n")


def dedup_exact(spark: SparkSession, docs: DataFrame, digest=sha256_hex, **trigger) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and its locator.

    Null text is empty; all rows of equal normalised text, null ids and repeated rows too, form one group, of which
    exactly one row is kept. Null ids come after all others. An empty table gives no rows.
    digest may be any function of the normalised text: wrong hits are found and split.
    """
    return _decide(spark, with_locator(docs), digest, **trigger)


def _arrivals(located: DataFrame, digest) -> DataFrame:
    norm = normalised(F.col("text"))
    return located.select(F.col("doc_id").cast("long").alias("doc_id"), digest(norm).cast("string").alias("digest"), sha256_hex(norm).alias("sha"), F.length(or_empty(F.col("text"))).alias("n_points"), *LOCATOR)


def _decide(spark: SparkSession, located: DataFrame, digest=sha256_hex, **trigger) -> DataFrame:
    arrivals = materialise(_arrivals(located, digest), "dedup-arrivals")
    state = stream_state(spark, arrivals.schema, arrivals._rw_path, shared_path(spark, "dedup-state"), **trigger)
    return _verify(arrivals, arrivals.join(state, "digest"), located)


def _verify(arrivals: DataFrame, members: DataFrame, located: DataFrame) -> DataFrame:
    """The decision on every row of members (arrivals with their digest's best and n); located has the texts of all of them."""
    company = members.filter("n > 1").select(*LOCATOR, "digest")
    texts = located.select(*LOCATOR, normalised(F.col("text")).alias("norm")).join(company, LOCATOR)
    clash = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("c")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    clash = materialise(clash, "dedup-clash")
    if not clash.isEmpty():
        own = texts.join(clash, "digest", "left_semi").join(arrivals.select(*LOCATOR, "doc_id", "n_points"), LOCATOR)
        right = own.groupBy("digest", "norm").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
        split = own.select(*LOCATOR, "digest", "norm").join(right, ["digest", "norm"]).select(*LOCATOR, "digest", "best", "n")
        fixed = arrivals.drop("digest").join(split, LOCATOR)
        members = members.join(clash, "digest", "left_anti").unionByName(fixed)
    best = F.col("best")
    return members.select("doc_id", best["id"].alias("keep_id"), F.col("n").alias("group_size"), ((best["file"] == F.col(FILE)) & (best["row"] == F.col(ROW))).alias("kept"), F.col("sha").alias("text_sha256"), *LOCATOR)


def dedup_crawl(spark: SparkSession, path: str, state: str, digest=sha256_hex, **trigger) -> DataFrame:
    """Deduplicates the Parquet table at path against all crawls that the folder state knows, and adds it to them.

    One row, as those of dedup_exact(), for every row whose digest the crawl has: all its own rows, and those of
    earlier crawls that are equal to some of them, as a longer new copy takes over from an older one. The folder keeps the stream's
    state, the arrivals and the crawls' paths, whose files must stay where they are: hits are checked against their texts.
    A crawl is added once, by its path: a call after a failure goes on, and a repeated one gives the same rows.
    """
    name = hashlib.sha256(path.encode()).hexdigest()
    crawl, docs = f"{state}/arrivals/crawl={name}", spark.read.parquet(path)
    located = with_locator(docs)
    if not exists(spark, f"{crawl}/_SUCCESS"):
        at = docs.metadataColumn("_metadata")["file_path"]
        docs.select(F.xxhash64(at).alias("file"), at.alias("name")).distinct().write.mode("overwrite").parquet(f"{state}/files/crawl={name}")
        _arrivals(located, digest).write.mode("overwrite").parquet(crawl)
    schema = spark.read.parquet(crawl).schema
    now = stream_state(spark, schema, f"{state}/arrivals", f"{state}/keyed", **trigger)
    own = spark.read.schema(schema).parquet(crawl)
    arrivals = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state}/arrivals")
    touched = materialise(own.select("digest").distinct().join(now, "digest"), "dedup-touched")
    members = materialise(arrivals.join(touched, "digest"), "dedup-members")
    # Of earlier crawls only the files that hold members of groups are read.
    held = members.filter("n > 1").select(F.col(FILE).alias("file")).distinct()
    older = spark.read.parquet(f"{state}/files").filter(F.col("crawl") != name).join(held, "file").select("name").distinct().collect()
    texts = located.select("text", *LOCATOR)
    if older:
        texts = texts.unionByName(with_locator(spark.read.schema("text string").parquet(*(unquote(r.name) for r in older))))
    return _verify(members.drop("best", "n"), members, texts)


def keep_first_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that dedup_exact() doesn't keep; its columns stay."""
    located = with_locator(docs)
    dropped = _decide(spark, located).filter("not kept").select(*LOCATOR)
    return located.join(dropped, LOCATOR, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
"""
