"""SimHash near-dedup with vantage-point trees.

Fingerprints come from whole texts. Distinct ones are dealt to the leaves of a vantage-point tree over Hamming
distance: at each node a fingerprint's home is the near or the far side of the median ball, and where the triangle
bound lets a partner lie across the boundary it is sent there too, as a guest. Each shard then runs a tree of its
own over its rows and compares only leaves, home against home and home against guest, so all pairs within
the radius are found. A shard reports a star per local cluster, never all its pairs; the stars are joined up by
distributed connected components. The tree at the top comes from a bounded sample, which affects balance only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import FILE, LOCATOR, ROW, materialise, read_table, with_locator
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 for null and for no words. Memory doesn't grow with the number of shingles but for the words themselves."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(located: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, locator and fp (the fingerprint's bits as a long) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.fromiter((fingerprint(t, shingle) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *LOCATOR)), pa.array(fps.view(np.int64))], ["doc_id", *LOCATOR, "fp"])

    rows = located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, fp long")


def _far(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to one; wide ones have a row of words each."""
    d = np.bitwise_count(a ^ v)
    return (d if d.ndim == 1 else d.sum(axis=1)).astype(np.int16)


def _split(d: np.ndarray) -> int | None:
    """A bound that leaves points on both sides, near the median."""
    mu = int(np.median(d))
    if (d > mu).any():
        return mu
    below = d[d < mu]
    return int(below.max()) if len(below) else None


def top_tree(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, int]]:
    """Vantage points and bounds of a complete tree, in heap order; a node without enough sample points keeps its parent's bound on another vantage point."""
    nodes: list = [None] * (2**depth - 1)
    sets, middle = [sample], 32 * int(np.prod(sample.shape[1:]))
    for k in range(len(nodes)):
        s = sets[k]
        rng = np.random.default_rng(k + 1)
        v, mu = rng.integers(0, 2**64, sample.shape[1:], dtype=np.uint64), middle
        if len(s) > 1:
            for v in rng.choice(s, min(8, len(s)), replace=False):
                if (mu := _split(_far(s, v))) is not None:
                    break
            else:
                mu = middle
        nodes[k] = (v, mu)
        d = _far(s, v)
        sets += [s[d <= mu], s[d > mu]] if 2 * k + 2 < len(nodes) else []
    return nodes


def route(fps: np.ndarray, nodes: list, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index into fps, home) of every place a fingerprint must be at."""
    out, todo = [], [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        k, ix, home = todo.pop()
        if not len(ix):
            continue
        if k >= len(nodes):
            out.append((np.full(len(ix), k - len(nodes), np.int64), ix, home))
            continue
        v, mu = nodes[k]
        d = _far(fps[ix], v)
        near, far = d <= mu, d > mu
        left = np.where(home, near, d <= mu + radius)
        right = d > mu - radius
        todo += [(2 * k + 1, ix[left], home[left]), (2 * k + 2, ix[right], (home & far)[right])]
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(list(zip(*out, strict=True)) or [[], [], []], (np.int64, np.int64, bool), strict=True))


class _Clusters:
    """Union by smallest index, over arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def shard_clusters(home: np.ndarray, guest: np.ndarray, radius: int = RADIUS, leaf: int = 512, block: int = 1024) -> np.ndarray:
    """Labels over home + guest: equal for what links within the radius join, where one end at least of each link is in home. Exact."""
    both = np.concatenate([home, guest])
    found = _Clusters(len(both))

    def compare(h: np.ndarray, g: np.ndarray) -> None:
        for i in range(0, len(h), block):
            a = h[i : i + block]
            for other in (h[i:], g):
                for j in range(0, len(other), block):
                    b = other[j : j + block]
                    x, y = np.nonzero(np.bitwise_count(both[a][:, None] ^ both[b][None, :]) <= radius)
                    found.join(a[x], b[y])

    todo = [(np.arange(len(home)), np.arange(len(home), len(both)))]
    while todo:
        h, g = todo.pop()
        if not len(h):
            continue
        mu = None
        if len(h) > leaf:
            v = both[h[len(h) // 2]]
            d = _far(both[h], v)
            mu = _split(d)
        if mu is None:
            compare(h, g)
            continue
        e, near = _far(both[g], v), d <= mu
        todo += [(h[near], g[e <= mu + radius]), (h[~near], np.concatenate([g[e > mu - radius], h[near & (d > mu - radius)]]))]
    return found.label


def near_links(fps: DataFrame, radius: int = RADIUS, sample: int = 16384, per_shard: int = 8192) -> DataFrame:
    """fps: fp, distinct. Returns u > v: stars whose components are those of all pairs within the radius."""
    n = fps.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, n) / per_shard))), int(np.log2(sample)) - 3))
    drawn = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample if depth else 1)
    nodes = top_tree(np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64), depth)

    def deal(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 65536):
                part = own[at : at + 65536]
                shard, ix, home = route(part.view(np.uint64), nodes, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part[ix]), pa.array(home)], ["shard", "fp", "home"])

    def link(pdf):
        fp, home = pdf["fp"].to_numpy(), pdf["home"].to_numpy(dtype=bool)
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        fp, n_home = np.ascontiguousarray(fp[order]), int(home.sum())
        label = shard_clusters(fp[:n_home].view(np.uint64), fp[n_home:].view(np.uint64), radius)
        least = fp.copy()
        np.minimum.at(least, label, fp)
        to = least[label]
        return pdf.__class__({"u": fp[to < fp], "v": to[to < fp]})

    return fps.select("fp").mapInArrow(deal, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(link, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, locator, fp, rep (the group's smallest fp as a long) and component_id of every row of docs.

    Null and empty texts have fingerprint 0 and link like any others; null ids never become a component_id
    unless a whole group has none. Repeated rows share their fingerprint. An empty table gives no rows.
    """
    return _groups(with_locator(docs), shingle, radius)


def _groups(located: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    rows = materialise(fingerprints(located, shingle), "fingerprints")
    own = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    stars = components(near_links(own, radius))
    linked = own.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("rep")), "fp", "left").select("fp", "least", F.coalesce("rep", "fp").alias("rep"))
    group = linked.groupBy("rep").agg(F.min("least").alias("component_id"))
    named = linked.join(group, "rep").select("fp", "rep", "component_id")
    return rows.join(named, "fp")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with the row of smallest id (null last) of each group of near copies; its columns stay."""
    located = with_locator(docs)
    rows = _groups(located)
    best = rows.groupBy("rep").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)).alias("b")).select(*(F.col(f"b.{c}").alias(c) for c in LOCATOR))
    dropped = rows.select(*LOCATOR).join(best, LOCATOR, "left_anti")
    return located.join(dropped, LOCATOR, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
