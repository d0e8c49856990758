"""Near copies by shingle similarity: wide SimHash fingerprints in a vantage-point tree, exact pairs.

Texts whose five-word shingles have a Jaccard similarity of 0.8 lie about 10 of 64 bits apart, and among millions of texts
many unrelated ones lie as near. So fingerprints here have 256 bits, of which unrelated ones differ in 128, give or take 8.
All distinct fingerprints go through op4's tree: home is the near or the far side of each vantage point's median ball, and
where the triangle bound lets a partner lie across the boundary the fingerprint is sent there too, as a guest. Shards
are cut into chunks, and every pair of chunks is a task of its own, which runs a tree over its rows and compares leaves.
No link is lost and none is capped. A link is 48 of 256 bits or fewer, the value for a similarity of 0.8 being 39, give or take 6.

At this radius the bounds prune little among unrelated texts: the work grows with the square of the number of different
ones. So the tree at the top grows only while a row has few copies, and a node is split only where that saves pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import near_copies
from .common import FILE, LOCATOR, ROW, drop_table, materialise, with_locator
from .components import components
from .near_copies import RADIUS, SHINGLE, WORDS, _BITS, _runs, shingle_hashes, wide_bits
from .simhash_vptree import _Clusters, _split, route, top_tree

#: Rows of the sample for the top of the tree, rows that a shard is made for, and the most places a row has on average; they affect balance only.
SAMPLE, PER_SHARD, COPIES = 16384, 8192, 16
#: Rows of a chunk, and how many chunks of all rows there are at most before chunks grow.
CHUNK, MAX_CHUNKS = 32768, 64


def fingerprints(located: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, locator and f0 to f3 of every row."""
    names = ["doc_id", *LOCATOR]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bits = np.array([wide_bits(shingle_hashes(t, shingle)) for t in part.column("text").to_pylist()], np.uint64).reshape(-1, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(bits[:, k].copy()) for k in range(WORDS))], [*names, *_BITS])

    rows = located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, {', '.join(f'{c} long' for c in _BITS)}")


def _linked(words: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a and b within the radius: half of the words tell nearly all others off."""
    x, y, half = words[:, a], words[:, b], WORDS // 2
    d = np.bitwise_count(x[0][:, None] ^ y[0][None, :])
    for k in range(1, half):
        d += np.bitwise_count(x[k][:, None] ^ y[k][None, :])
    at = np.flatnonzero(d <= radius)
    i, j = np.divmod(at, len(b))
    rest = np.bitwise_count(x[half:, i] ^ y[half:, j]).sum(axis=0, dtype=np.int64)
    ok = d.reshape(-1)[at] + rest <= radius
    return a[i[ok]], b[j[ok]]


def tree_links(words: np.ndarray, home: np.ndarray, guest: np.ndarray, within: bool, found: _Clusters, radius: int = RADIUS, leaf: int = 512) -> None:
    """Joins all links between home and guest and, if within, those inside home (indices of words' columns). Exact."""
    far = lambda ix, v: np.bitwise_count(words[:, ix] ^ v[:, None]).sum(axis=0, dtype=np.int16)
    pairs = lambda h, g: len(h) * (len(g) + (len(h) / 2 if within else 0))
    todo = [(home, guest)]
    while todo:
        h, g = todo.pop()
        if len(h) > leaf:
            v = words[:, h[len(h) // 2]]
            d, e = far(h, v), far(g, v)
            if (mu := _split(d)) is not None:
                near = d <= mu
                across = h[near & (d > mu - radius)] if within else h[:0]
                parts = [(h[near], g[e <= mu + radius]), (h[~near], np.concatenate([g[e > mu - radius], across]))]
                if sum(pairs(*p) for p in parts) < 0.9 * pairs(h, g):
                    todo += parts
                    continue
        for p in range(0, len(h), 64):
            a = h[p : p + 64]
            for other in ((h[p:], g) if within else (g,)):
                for q in range(0, len(other), 4096):
                    found.join(*_linked(words, a, other[q : q + 4096], radius))


def chunk_links(radius: int = RADIUS):
    """A map over sorted (key, i, j): u > v, stars whose components are those of all links in a chunk of home rows (i = j), or between one and another chunk."""

    def run(batches):
        for i, j, rows in _runs(batches):
            ids, chunk = (rows.column(c).to_numpy() for c in ("fid", "chunk"))
            words = np.stack([rows.column(c).to_numpy() for c in _BITS]).view(np.uint64)
            found = _Clusters(len(ids))
            tree_links(words, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j) if i != j else np.zeros(0, np.int64), i == j, found, radius)
            least = ids.copy()
            np.minimum.at(least, found.label, ids)
            to = least[found.label]
            if (to < ids).any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[to < ids]), pa.array(to[to < ids])], ["u", "v"])

    return run


def top_nodes(sample: np.ndarray, rows: int, radius: int = RADIUS) -> list:
    """The top of the tree: as deep as shards of PER_SHARD rows ask for, while the bounds send a row to at most COPIES shards on average."""
    depth = max(0, min(int(np.ceil(np.log2(max(1, rows) / PER_SHARD))), int(np.log2(SAMPLE)) - 3))
    nodes, kept = top_tree(sample, depth), 0
    while kept < depth and len(route(sample, nodes[: 2 ** (kept + 1) - 1], radius)[0]) <= COPIES * len(sample):
        kept += 1
    return nodes[: 2**kept - 1]


def near_links(own: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """own: fid, f0 to f3 of distinct fingerprints. Returns u > v (fids): stars whose components are those of all pairs within the radius."""
    n = own.count()
    drawn = own.orderBy(F.xxhash64("fid"), "fid").limit(SAMPLE if n > PER_SHARD else 1).select(*_BITS).collect()
    nodes = top_nodes(np.array([tuple(r) for r in drawn], np.int64).reshape(-1, WORDS).view(np.uint64), n, radius)

    def deal(batches):
        for batch in batches:
            fps = np.column_stack([batch.column(c).to_numpy() for c in _BITS]).view(np.uint64)
            shard, ix, home = route(fps, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c).take(pa.array(ix)) for c in ("fid", *_BITS)), pa.array(home)], ["key", "fid", *_BITS, "home"])

    longs = ", ".join(f"{c} long" for c in _BITS)
    places = materialise(own.select("fid", *_BITS).mapInArrow(deal, f"key long, fid long, {longs}, home boolean"), "near-shards")
    # Chunks of home rows come first, those of guests after them; guests are not compared with one another.
    room = max(chunk, -(-n // MAX_CHUNKS))
    held = places.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).collect()
    cuts = [(r.key, -(-r.homes // room), -(-r.guests // room)) for r in held]
    tasks = sum(m * (m + 1) // 2 + m * g for _, m, g in cuts)
    dealt = places.join(F.broadcast(own.sparkSession.createDataFrame(cuts, "key long, m int, g int")), "key").filter("m > 0")
    dealt = dealt.withColumn("chunk", F.when(F.col("home"), F.expr("pmod(xxhash64(fid), m)")).otherwise(F.expr("m + pmod(xxhash64(fid), greatest(g, 1))")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("m") + F.col("g")).otherwise(F.col("m")) - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fid", *_BITS, "chunk")
    pairs = dealt.repartition(max(1, min(2 * tasks, 4096)), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(chunk_links(radius), "u long, v long")
    out = materialise(pairs.distinct(), "near-links")
    drop_table(places)
    return out


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, locator and rep (the same long for all rows of a group of near copies) of every row of docs.

    Null and empty texts are copies of one another; texts of fewer than shingle words link where their words are
    the same. Null ids and repeated rows are grouped like any others. An empty table gives no rows. Fingerprints go by
    a 64-bit hash of their 256 bits.
    """
    return _groups(with_locator(docs), shingle, radius)


def _groups(located: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    rows = materialise(fingerprints(located, shingle).withColumn("fid", F.xxhash64(*_BITS)), "wide-fingerprints")
    own = materialise(rows.select("fid", *_BITS).distinct(), "distinct-wide")
    stars = components(near_links(own, radius))
    return rows.join(stars.select(F.col("u").alias("fid"), "v"), "fid", "left").select("doc_id", *LOCATOR, F.coalesce("v", "fid").alias("rep"))


def keep_one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with the row of smallest id (null last) of each group of near copies; its columns stay."""
    return near_copies.keep_one_of_each_group(docs, shingle, radius, _groups)
