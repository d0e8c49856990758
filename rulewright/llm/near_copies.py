"""Near copies by shingle similarity: wide SimHash fingerprints, a vantage point for each bucket, exact pairs in it.

Texts whose five-word shingles have a Jaccard similarity of 0.8 lie about 10 of 64 bits apart, where a vantage-point
tree over all fingerprints prunes nothing: random ones lie 32 bits apart, give or take 4. So fingerprints here have
256 bits, and min-hash bands deal them to buckets first: two such texts miss each other in all 16 bands of 5 in 0.2 % of cases.
In a bucket one fingerprint is the vantage point. What lies within the radius of it is a star, however many they are, and needs no pairs.
The others are compared with one another and, where the triangle bound lets a link pass, with members of the
star; buckets of many such rows are cut into chunks, and every pair of chunks is a task of its own. So no link within a bucket is lost and
none is capped; links between texts without a bucket in common are. near_tree finds those too, and is what the pipeline takes. A link is 48 of 256 bits or fewer, the value for a similarity of 0.8 being 39, give or take 6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import FILE, LOCATOR, ROW, drop_table, materialise, with_locator
from .components import components
from .simhash_vptree import SEED, _LOWER, _Clusters

SHINGLE, RADIUS, WORDS = 5, 48, 4
BANDS, BAND = 16, 5
CHUNK = 4096
_BITS = [f"f{k}" for k in range(WORDS)]
_ODD = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND), dtype=np.uint64) | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's word shingles; fewer words are one shingle, and so is no word at all."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], np.array([len(joined)])
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def wide_bits(h: np.ndarray) -> np.ndarray:
    """The fingerprint of shingle hashes, WORDS longs."""
    ones = np.zeros((WORDS, 64), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            for k in range(WORDS):
                x = _stir(h[at : at + 4096] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
                ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint (WORDS longs) and the keys of the bands."""
    h = shingle_hashes(text, shingle)
    least = np.full(BANDS * BAND, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            np.minimum(least, (h[at : at + 4096, None] * _ODD[0] + _ODD[1]).min(axis=0), out=least)
        rows = _stir(least + np.arange(BANDS * BAND, dtype=np.uint64)).reshape(BANDS, BAND)
        return wide_bits(h), _stir(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketches(located: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, locator, f0 to f3 and bands (keys) of every row."""
    names = ["doc_id", *LOCATOR]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = [sketch(t, shingle) for t in part.column("text").to_pylist()]
                bits = np.array([b for b, _ in both], np.uint64).reshape(-1, WORDS).view(np.int64)
                bands = pa.array([k.view(np.int64) for _, k in both], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(bits[:, k].copy()) for k in range(WORDS)), bands], [*names, *_BITS, "bands"])

    rows = located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, {', '.join(f'{c} long' for c in _BITS)}, bands array<long>")


def _apart(pivot: str) -> Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{pivot}.{c}"))) for c in _BITS), F.lit(0))


def _runs(batches):
    """The rows of each (key, i, j), which follow one another, as (i, j, columns)."""
    names, held = ["key", "i", "j"], None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]).combine_chunks() if held is not None and held.num_rows else now
        at = np.column_stack([held.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(at[a, 1]), int(at[a, 2]), held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield int(held.column("i")[0].as_py()), int(held.column("j")[0].as_py()), held


def _linked(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of x and y within the radius."""
    d = np.zeros((len(x), len(y)), np.int16)
    for k in range(WORDS):
        d += np.bitwise_count(x[:, k][:, None] ^ y[:, k][None, :])
    return np.nonzero(d <= radius)


def bucket_links(radius: int = RADIUS, block: int = 512):
    """A map over sorted (key, i, j): u > v, stars whose components are those of all links between home rows, or a home row and a guest."""

    def run(batches):
        for i, j, rows in _runs(batches):
            ids, home, chunk = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("fid", "home", "chunk"))
            fp = np.column_stack([rows.column(c).to_numpy() for c in _BITS]).view(np.uint64)
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            found = _Clusters(len(ids))
            for p in range(0, len(left), block):
                a = left[p : p + block]
                for q in range(p if i == j else 0, len(right), block):
                    b = right[q : q + block]
                    x, y = _linked(fp[a], fp[b], radius)
                    ok = home[a[x]] | home[b[y]]
                    found.join(a[x[ok]], b[y[ok]])
            least = ids.copy()
            np.minimum.at(least, found.label, ids)
            to = least[found.label]
            if (to < ids).any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[to < ids]), pa.array(to[to < ids])], ["u", "v"])

    return run


def near_links(own: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """own: fid, f0 to f3, bands of distinct fingerprints. Returns u > v (fids): stars with the components of all links between rows of one bucket."""
    rows = own.select("fid", *_BITS, F.explode("bands").alias("key"))
    pivots = rows.groupBy("key").agg(F.min(F.struct("fid", *_BITS)).alias("pivot"), F.max("fid").alias("last")).filter("pivot.fid < last").drop("last")
    near = materialise(rows.join(pivots, "key").select("key", "fid", *_BITS, F.col("pivot.fid").alias("pid"), _apart("pivot").cast("int").alias("d")), "near-buckets")
    stars = near.filter((F.col("d") <= radius) & (F.col("fid") > F.col("pid"))).select(F.col("fid").alias("u"), F.col("pid").alias("v"))
    outside = near.filter(F.col("d") > radius).groupBy("key").agg(F.min("d").alias("nearest"))
    members = materialise(near.join(outside, "key").filter((F.col("d") > radius) | (F.col("d") >= F.col("nearest") - radius)).select("key", "fid", *_BITS, (F.col("d") > radius).alias("home")), "near-members")
    chunks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("m"))
    dealt = members.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("fid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fid", *_BITS, "home", "chunk")
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(bucket_links(radius), "u long, v long")
    out = materialise(stars.unionByName(pairs).distinct(), "near-links")
    drop_table(near)
    drop_table(members)
    return out


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, locator and rep (the same long for all rows of a group of near copies) of every row of docs.

    Null and empty texts are copies of one another; texts of fewer than shingle words link where their words are
    the same. Null ids and repeated rows are grouped like any others. An empty table gives no rows. Fingerprints go by
    a 64-bit hash of their 256 bits.
    """
    return _groups(with_locator(docs), shingle, radius)


def _groups(located: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    rows = sketches(located, shingle).withColumn("fid", F.xxhash64(*_BITS))
    rows = materialise(rows, "sketches")
    own = rows.groupBy("fid", *_BITS).agg(F.array_distinct(F.flatten(F.collect_set("bands"))).alias("bands"))
    stars = components(near_links(materialise(own, "distinct-sketches"), radius))
    return rows.join(stars.select(F.col("u").alias("fid"), "v"), "fid", "left").select("doc_id", *LOCATOR, F.coalesce("v", "fid").alias("rep"))


def keep_one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, groups=_groups) -> DataFrame:
    """docs with the row of smallest id (null last) of each group of near copies; its columns stay."""
    located = with_locator(docs)
    rows = materialise(groups(located, shingle, radius), "near-groups")
    best = rows.groupBy("rep").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)).alias("b")).select(*(F.col(f"b.{c}").alias(c) for c in LOCATOR))
    dropped = rows.select(*LOCATOR).join(best, LOCATOR, "left_anti")
    return located.join(dropped, LOCATOR, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
