"""Line dedup: a sharded minimal perfect hash over the hashes of repeated lines, probed by the documents.

Lines are folded to (128-bit hash, smallest and largest document, count) with partial aggregation in every task. The hashes
of lines that occur in several documents are dealt to shards; each shard holds a minimal perfect hash (levels of
collision-free bits) that indexes a fingerprint array, a count array and an array of the document that keeps the
line. Documents send line hashes to the shards and get back the places to drop: lines themselves are never joined. A shard whose
lines are many for its size, by their counts, is copied so that one very common line spreads over many tasks; the others are
sent once. A probe streams through a shard, so memory is that of one shard's arrays.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import FILE, LOCATOR, ROW, WHITE, lower_ascii, materialise, or_empty, read_table, sha256_hex, with_locator

MIN_POINTS, MIN_COPIES, PER_SHARD = 10, 2, 250_000
#: A copy of a shard is for at least so many lines, and so many for each line that it holds.
PER_COPY, PER_KEY = 16_384, 4
MAX_BROADCAST_SHARDS = 500_000
LAST = (1 << 63) - 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt % 2**64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal and perfect over distinct uint64 keys: a key's index is the rank of its bit in the first level where it collides with no other key."""

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            bits = 64 * (len(keys) * cls.GAMMA // 64 + 1)
            at = _mix(keys, len(levels) + 1) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key, -1 for some that aren't in; others that aren't in get any index."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, words in enumerate(self.levels):
            at = (_mix(keys[todo], k + 1) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            out[todo[hit]] = self.ranks[k][at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            todo = todo[~hit]
        return out


class LineIndex:
    """A shard: which document keeps a line, and how often the line occurs."""

    def __init__(self, seed: int, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.seed, self.hash, self.prints, self.counts, self.keepers = seed, PerfectHash(levels), prints, counts, keepers

    @staticmethod
    def key(seed: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return _mix(h1 ^ _mix(h2, seed), seed)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineIndex:
        seed = 0
        while len(np.unique(key := cls.key(seed, h1, h2))) < len(key):
            seed += 1
        own = PerfectHash.build(key)
        order = np.argsort(own(key))
        return cls(seed, own.levels, h2[order], counts[order], keepers[order])

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), seed=self.seed, prints=self.prints, counts=self.counts, keepers=self.keepers, **{f"l{i}": x for i, x in enumerate(self.hash.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        z = np.load(io.BytesIO(data))
        return cls(int(z["seed"]), [z[f"l{i}"] for i in range(sum(k[0] == "l" for k in z.files))], z["prints"], z["counts"], z["keepers"])

    def elsewhere(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, min_copies: int = MIN_COPIES) -> np.ndarray:
        """True for each line that is in, occurs so often, and that another document keeps."""
        if not len(self.prints):
            return np.zeros(len(h1), bool)
        at = self.hash(self.key(self.seed, h1, h2))
        return (at >= 0) & (self.prints[at] == h2) & (self.counts[at] >= min_copies) & (self.keepers[at] != doc)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _lines(located: DataFrame, min_points: int) -> DataFrame:
    """h1, h2, doc (id, null last), locator and pos of every line whose key is long enough."""
    lines = located.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), *LOCATOR, F.posexplode(F.split(or_empty(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.select("doc", *LOCATOR, "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_points)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", *LOCATOR, "pos")


def build_index(lines: DataFrame, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """shard, copies (how many of it its lines' counts ask for), index (bytes of a LineIndex); and the number of shards."""
    repeated = lines.groupBy("h1", "h2").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("keeper < last").drop("last")
    repeated = materialise(repeated, "repeated-lines")
    shards = max(16, -(-repeated.count() // per_shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = LineIndex.build(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["n"].to_numpy(), pdf["keeper"].to_numpy())
        copies = -(-int(pdf["n"].sum()) // max(PER_COPY, PER_KEY * len(pdf)))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "copies": [copies], "index": [index.to_bytes()]})

    shard = F.pmod("h1", F.lit(shards)).cast("int")
    return materialise(repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, copies int, index binary"), "line-index"), shards


def probe(lines: DataFrame, index: DataFrame, shards: int, min_copies: int = MIN_COPIES) -> DataFrame:
    """Locator and pos of every line that occurs so often and that a smaller document keeps."""
    none = lambda kind: F.lit(None).cast(kind)
    copies = index.select("shard", "copies")
    salt = F.pmod(F.xxhash64(*LOCATOR, "pos"), F.col("copies")).cast("int").alias("salt")
    asked = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(F.broadcast(copies) if shards <= MAX_BROADCAST_SHARDS else copies, "shard")
    ask = asked.select("shard", salt, "h1", "h2", "doc", *LOCATOR, "pos", none("binary").alias("index"))
    give = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), *(none(k).alias(c) for c, k in (("h1", "long"), ("h2", "long"), ("doc", "long"), (FILE, "long"), (ROW, "long"), ("pos", "int"))), "index")

    def run(batches):
        at, own = None, None
        for batch in batches:
            shard, salt = (batch.column(c).to_numpy() for c in ("shard", "salt"))
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (shard[a], salt[a]) != at:
                    at, own = (shard[a], salt[a]), None
                    if part.column("index")[0].is_valid:
                        own, part = LineIndex.from_bytes(part.column("index")[0].as_py()), part.slice(1)
                if own is None or not part.num_rows:
                    continue
                h1, h2, doc = (part.column(c).to_numpy() for c in ("h1", "h2", "doc"))
                drop = pa.array(own.elsewhere(h1.view(np.uint64), h2.view(np.uint64), doc, min_copies))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(drop) for c in (*LOCATOR, "pos")], [*LOCATOR, "pos"])

    dealt = ask.unionByName(give).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("index").isNull())
    return dealt.mapInArrow(run, f"{FILE} long, {ROW} long, pos int")


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_copies: int = MIN_COPIES) -> DataFrame:
    """doc_id, locator, n_lines, n_dropped and kept (the text that stays) of every row.

    Lines of fewer occurrences than min_copies stay everywhere.

    Null and empty texts have one empty line, which stays. Rows that share an id are one document, and so are
    those without an id, which come last: repeated lines within one document stay. An empty table gives no rows.
    """
    located = with_locator(docs)
    lines = _lines(located, min_points)
    index, shards = build_index(lines)
    drops = probe(lines, index, shards, min_copies).groupBy(*LOCATOR).agg(F.collect_list("pos").alias("drops"))
    own = F.split(or_empty(F.col("text")), "\n")
    rows = located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, "text").join(drops, LOCATOR, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), or_empty(F.col("text"))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    rows = rows.withColumn("lines", own)
    return rows.select("doc_id", *LOCATOR, F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), kept.alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept")).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, lower_line AS key FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
  LATERAL (SELECT translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_line)),
k AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
