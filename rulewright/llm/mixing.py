"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Every source's rows fall into permuted blocks. Its target, a share by weight of all words that is levelled off
at a cap, says how many whole passes over its blocks are drawn; the last pass takes, in permuted order, the blocks that still
fit, swaps single blocks to come nearer, and takes of one more block the rows that make up the rest. The draws of all sources are the balls of an urn that is split between the output shards by a
binary tree of multivariate hypergeometric draws, so each shard has an exact quota of each source's blocks. The shards take
their quotas as disjoint runs of each source's permuted draws, and order their rows by a keyed hash.
The driver sees a row for each source and block, at most MAX_BLOCKS of them; rows never leave the executors. With
very many sources a source has blocks by its share of all rows, so that one block of a large source stays small.
Rows are known by id and text, and equal ones by a number among them, so two copies of a table give one mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import LOCATOR, materialise, or_empty, read_table, with_locator

SEED, CAP, SHARDS = 17, 3, 64
BLOCKS_PER_SOURCE, MAX_BLOCKS, EXACT_BLOCKS, PER_PART = 2048, 500_000, 14, 100_000
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    """The number of words in the text, 0 for null."""
    return F.regexp_count(or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Shares by weight of all sizes; a share above cap times its source's size stops there, and the excess is shared out by weight again until none is above."""
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    rest = float(sizes.sum())
    while open_.any():
        share = np.where(open_, rest * weights / weights[open_].sum(), 0)
        over = open_ & (share > cap * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * sizes[over]
        rest -= out[over].sum()
        open_ &= ~over
    return out


def split_quotas(draws: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many of each source's draws each shard gets, by a binary splitting tree."""
    out = np.zeros((shards, len(draws)), np.int64)
    todo = [(0, shards, np.asarray(draws, np.int64))]
    while todo:
        lo, hi, balls = todo.pop()
        if hi - lo == 1:
            out[lo] = balls
            continue
        mid = (lo + hi) // 2
        want = int(balls.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng((seed, lo, hi)).multivariate_hypergeometric(balls, want, method="marginals") if want else np.zeros_like(balls)
        todo += [(lo, mid, left), (mid, hi, balls - left)]
    return out


def _closest(blocks: list, goal: float) -> tuple[list, list, float]:
    """Of a source of few blocks, the set of them that comes nearest to goal: all sets are tried."""
    sums = np.zeros(1)
    for words, _ in blocks:
        sums = np.concatenate([sums, sums + words])
    pick = int(np.abs(sums - goal).argmin())
    fits = [x for i, x in enumerate(blocks) if pick >> i & 1]
    return fits, [x for i, x in enumerate(blocks) if not pick >> i & 1], goal - sums[pick]


def _closer(fits: list, over: list, left: float, rounds: int = 32) -> tuple[list, list, float]:
    """Adds, takes back or swaps single blocks while that brings what is left to draw nearer to 0."""
    for _ in range(rounds):
        if abs(left) <= 0.5:
            break
        ins, outs = [(0, None), *sorted(over)], [(0, None), *sorted(fits)]
        a, b = (np.array([w for w, _ in x], float) for x in (ins, outs))
        at = np.clip(np.searchsorted(b, a - left), 1, len(b) - 1) if len(b) > 1 else np.zeros(len(a), int)
        near = np.where(np.abs(a - b[at - 1] - left) <= np.abs(a - b[at] - left), at - 1, at) if len(b) > 1 else at
        miss = np.abs(a - b[near] - left)
        k = int(miss.argmin())
        if miss[k] >= abs(left):
            break
        come, go = ins[k], outs[near[k]]
        left -= come[0] - go[0]
        if come[1] is not None:
            over.remove(come)
            fits.append(come)
        if go[1] is not None:
            fits.remove(go)
            over.append(go)
    return fits, over, left


def _plan(blocks: list, shards: int, seed: int, cap: int, weights: tuple[int, ...]) -> tuple[list, list]:
    """(source, block, passes drawn whole, words of one more pass or 0) and (source, block, pass, shard) rows; blocks: source, block, words."""
    by: dict[str | None, list] = {}
    for r in blocks:
        by.setdefault(r.source, []).append((r.block, r.words))
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    sizes = np.array([sum(w for _, w in by[s]) for s in names], float)
    goal = targets(sizes, np.array([weights[i % len(weights)] for i in range(len(names))], float), cap)
    takes, drawn = [], []
    for i, s in enumerate(names):
        rng = np.random.default_rng((seed, i))
        own = sorted(by[s])
        left, mine = goal[i], []
        total = sum(w for _, w in own)
        for p in range(cap):
            full = left >= total
            fits, over = [], []
            for k in rng.permutation(len(own)):
                block, words = own[k]
                (fits if full or words <= left else over).append((words, block))
                left -= words if full or words <= left else 0
            if not full:
                fits, over, left = _closer(fits, over, left) if len(own) > EXACT_BLOCKS else _closest(sorted((w, b) for b, w in own), left + sum(w for w, _ in fits))
            mine += [(block, p, words, True) for words, block in fits]
            if not full:
                if over and left > 0.5:
                    mine.append((min(over)[1], p, left, False))
                break
        whole: dict[int, int] = {}
        part: dict[int, float] = {}
        for block, _, words, full in mine:
            if full:
                whole[block] = whole.get(block, 0) + 1
            else:
                part[block] = words
        takes += [(s, total, float(goal[i]), b, whole.get(b, 0), float(part.get(b, 0.0))) for b, _ in own]
        drawn.append(mine)
    quotas = split_quotas(np.array([len(x) for x in drawn], np.int64), shards, seed)
    dealt = []
    for i, s in enumerate(names):
        order = np.random.default_rng((seed, i, 1)).permutation(len(drawn[i]))
        shard = np.repeat(np.arange(shards), quotas[:, i])
        dealt += [(s, drawn[i][k][0], drawn[i][k][1], int(to)) for k, to in zip(order, shard, strict=True)]
    return takes, dealt


def _sized(located: DataFrame, seed: int) -> DataFrame:
    """doc_id, locator, source, size and h, a hash of id, source and text."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("source").cast("string"), or_empty(F.col("text")))
    return located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), h.alias("h"))


def _numbered(rows: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """rows with nth, from 0 among rows of one h; only such rows are shuffled, and a large group of them in parts."""
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    part = F.pmod(F.xxhash64(*LOCATOR), F.ceil(F.col("n") / per_part)).cast("int")
    same = rows.select("h", *LOCATOR).join(many, "h").select("h", *LOCATOR, part.alias("part"))
    before = F.sum("c").over(Window.partitionBy("h").orderBy("part")) - F.col("c")
    base = same.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c")).select("h", "part", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("h", "part").orderBy(*LOCATOR))
    nth = same.withColumn("own", own).join(base, ["h", "part"]).select(*LOCATOR, (F.col("base") + F.col("own") - 1).alias("nth"))
    return rows.join(nth, LOCATOR, "left").select(*rows.columns, F.coalesce("nth", F.lit(0).cast("long")).alias("nth"))


def blocks_of(counts: list, most: int = MAX_BLOCKS, per_source: int = BLOCKS_PER_SOURCE) -> list[tuple]:
    """(source, blocks) for (source, rows): as many for each as there is room for in half of most, the rest by rows."""
    base = max(1, min(per_source, most // (2 * max(1, len(counts)))))
    spare, total = most - base * len(counts), max(1, sum(n for _, n in counts))
    return [(s, min(per_source * 32, base + spare * n // total) if base < per_source else base) for s, n in counts]


def _mix(located: DataFrame, shards: int, seed: int, cap: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with source_size, target and times (how often the mix takes the row), and the draws (source, block, pass, shard)."""
    spark = located.sparkSession
    rows = materialise(_numbered(materialise(_sized(located, seed), "mix-sized")), "mix-rows")
    counts = [(r.source, r.n) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_BLOCKS + 1).collect()]
    if len(counts) > MAX_BLOCKS:
        raise ValueError(f"over {MAX_BLOCKS} sources")
    many = spark.createDataFrame(blocks_of(counts), "s string, blocks long")
    dealt_to = F.pmod("h", F.col("blocks")).cast("int").alias("block")
    rows = rows.join(many, rows["source"].eqNullSafe(many["s"])).select(*[rows[c] for c in rows.columns], dealt_to)
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()
    takes, dealt = _plan(blocks, shards, seed, cap, weights)
    quota = spark.createDataFrame(takes, "source string, source_size long, target double, block int, whole int, part double")
    # Only rows of the one partly drawn block of a source are put in order; a block holds a bounded share of its source.
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["block"] == b["block"])
    partly = quota.filter("part > 0").select("source", "block", "part")
    inside = rows.join(partly, same(rows, partly), "inner").select(rows["source"], rows["block"], "h", "nth", "doc_id", *LOCATOR, "size", "part")
    upto = Window.partitionBy("source", "block").orderBy("h", "nth", "doc_id", "size", *LOCATOR).rowsBetween(Window.unboundedPreceding, 0)
    extra = inside.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") - F.col("size") / 2 <= F.col("part")).select(*LOCATOR, F.lit(1).alias("extra"))
    out = rows.join(quota, same(rows, quota), "inner").select(*[rows[c] for c in rows.columns], "source_size", "target", "whole")
    out = out.join(extra, LOCATOR, "left").select(*rows.columns, "source_size", "target", "whole", F.coalesce("extra", F.lit(0)).alias("extra"))
    deals = spark.createDataFrame(dealt, "source string, block int, pass int, shard int")
    return out, deals


def mix_report(docs: DataFrame, seed: int = SEED, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, block and shards of every row, as mix() with as many shards draws it.

    shards are those that the splitting tree dealt the row's draws to, by pass, and taken is the size as often as there are draws.
    Sources by code point, null last, have the weights in turn. Null text has no words; a row without words takes
    none. Equal rows are drawn together with their block and may be taken apart only in the block where a source's quota ends.
    An empty table gives no rows. Reruns agree, on a copy of the table in other files too. The plan for each source is made on the driver: over MAX_BLOCKS sources are refused.
    """
    rows, deals = _mix(with_locator(docs), shards, seed, cap, weights)
    d = deals.groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    both = rows.join(d, rows["source"].eqNullSafe(d["d_source"]) & (rows["block"] == d["d_block"]), "left")
    mine = F.filter(F.coalesce("dealt", F.array()), lambda x: (x["pass"] < F.col("whole")) | (F.col("extra") == 1))
    out = both.withColumn("shards", F.transform(mine, lambda x: x["shard"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "block", "shards")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: docs' columns with shard, pass and rank_key (in place of columns so named); a row appears once for each time that it is drawn.

    Ordered by rank_key a shard is shuffled; write it with repartition("shard").sortWithinPartitions("shard", "rank_key").
    """
    located = with_locator(docs)
    rows, deals = _mix(located, shards, seed, cap, weights)
    d = deals.select(F.col("source").alias("d_source"), F.col("block").alias("d_block"), "pass", "shard")
    # The pass after the whole ones is the partly drawn one: only its extra rows are taken.
    drawn = rows.join(d, rows["source"].eqNullSafe(d["d_source"]) & (rows["block"] == d["d_block"]), "inner").filter((F.col("pass") < F.col("whole")) | (F.col("extra") == 1))
    drawn = drawn.select(*LOCATOR, "shard", "pass", F.xxhash64(F.lit(seed), F.col("h"), F.col("nth"), F.col("pass")).alias("rank_key"))
    own = ["shard", "pass", "rank_key"]
    return located.drop(*own).join(drawn, LOCATOR).select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], *own)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))
