"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned against every token window.

Each window of a benchmark item is keyed by a hash of its first words. Documents' positions are hashed the same way
and probe the set in one generated pass; a hit is verified word by word. Only hits are shuffled. The set is
broadcast while its measured size is within MAX_BROADCAST_WINDOWS. Beyond that windows are keyed by all of their
words, positions are shuffled as key and place alone, and what meets is verified against the texts afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOCATOR, NON_WORD, materialise, or_empty, read_table, sha256_hex, with_locator, word_count, words

WINDOW, GATE = 13, 4
MAX_BROADCAST_WINDOWS = 1_000_000


def _key(word, gate: int) -> Column:
    """Of the gate words that word(0), word(1) and so on give."""
    return F.xxhash64(F.lit(gate), *(word(k) for k in range(gate)))


def benchmark_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """gram (its words), size, item_ids: distinct windows; null text and items without words have none. Items without an id go by the empty name."""
    w = F.filter(words(F.col("text")), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    rows = items.select(or_empty(F.col("item_id")).alias("item_id"), w.alias("w")).filter(F.size("w") > 0)
    grams = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("size", F.size("gram"))


def find_hits(located: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of located that has any: its locator, hits (sorted struct at, size: word positions), item_ids and n_words."""
    windows = materialise(benchmark_windows(items, n), "windows")
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(sizes.values()) <= MAX_BROADCAST_WINDOWS
    most = GATE if small else n
    gates = sorted({min(k, most) for k in sizes})
    cases = [(F.least("size", F.lit(most)) == g, _key(lambda k: F.get("gram", F.lit(k)), g)) for g in gates]
    keyed = windows.withColumn("key", reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])) if cases else F.lit(0).cast("long"))
    w = words(F.col("text"))
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    at = F.col("at")
    keys = [F.when(at + g <= F.size("w"), _key(lambda k: F.get("w", at + k), g)) for g in gates] or [F.lit(None).cast("long")]
    shortest = gates[0] if gates else n
    places = located.select(*LOCATOR, w.alias("w")).filter(F.size("w") >= shortest).select(*LOCATOR, "w", F.explode(F.sequence(F.lit(0), F.size("w") - shortest)).alias("at"))
    places = places.select(*LOCATOR, "w", "at", keys[0].alias("key")) if len(keys) == 1 else places.select(*LOCATOR, "w", "at", F.explode(F.array(*keys)).alias("key"))
    same = F.slice("w", at + 1, F.col("size")) == F.col("gram")
    if small:
        hits = places.join(F.broadcast(keyed), "key").filter(same)
    else:
        met = places.select(*LOCATOR, "at", "key").filter("key is not null").join(keyed, "key").select(*LOCATOR, "at", "size", "gram", "item_ids")
        hits = met.join(located.select(*LOCATOR, w.alias("w")), LOCATOR).filter(same)
    hits = hits.select(*LOCATOR, (at - lead).alias("at"), "size", "item_ids", word_count(F.col("w")).alias("n_words"))
    return hits.groupBy(*LOCATOR).agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("n_words").alias("n_words"))


def covered(hits: Column) -> Column:
    """The number of positions inside any of the sorted hits."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(h["at"] + h["size"] - F.greatest(acc["end"], h["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], h["at"] + h["size"]).alias("end"))
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated for every row of docs, with doc_id and locator.

    Null and empty texts have no words and are clean; rows of equal id or text are judged one by one; an empty
    benchmark leaves every row clean.
    """
    return _judge(with_locator(docs), items, n)


def _judge(located: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    counts = located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, word_count(words(F.col("text"))).alias("n_words"))
    rows = counts.join(find_hits(located, items, n).drop("n_words"), LOCATOR, "left")
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    rows = rows.withColumns({"n_hit": n_hit, "ids": ids})
    return rows.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), sha256_hex(F.array_join("ids", ",")).alias("items_sha256"), _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "hits", *LOCATOR)


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs of which no window of items is left; its columns stay.

    A row goes if it holds a whole window of n words, however long it is, or if a twentieth of its words are hit.
    The windows of items of fewer words are cut out of the other rows; a row in which the cuts have joined up another
    window goes too. Rows without hits stay as they are, null and empty texts and every row where items is empty or without
    texts among them. Items without an id count like any others.
    """
    located = with_locator(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    found = materialise(find_hits(located, items, n), "hits")
    bad = F.exists("hits", lambda h: h["size"] >= n) | _contaminated(covered(F.col("hits")), F.col("n_words"))
    clean = located.join(found.select(*LOCATOR), LOCATOR, "left_anti").select(*own)
    few = found.filter(~bad)
    if few.isEmpty():
        return clean
    rest = materialise(_cut(located.join(few.select(*LOCATOR, F.col("hits").alias("__rw_hits")), LOCATOR), docs.columns), "cut")
    again = with_locator(rest)
    return clean.unionByName(again.join(find_hits(again, items, n).select(*LOCATOR), LOCATOR, "left_anti").select(*own))


def _cut(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns of rows, text without the words inside __rw_hits (null: no hits)."""
    token = rf"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)|(?:{NON_WORD}$)"
    tokens = F.regexp_extract_all(or_empty(F.col("text")), F.lit(token), F.lit(0))
    inside = lambda i: F.exists("__rw_hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["size"]))
    cut = F.array_join(F.filter(tokens, lambda t, i: ~inside(i)), "")
    return rows.select(*[F.when(F.col("__rw_hits").isNotNull(), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the hit words, and what stands before each of them since the last word, cut out of text; other columns stay."""
    located = with_locator(docs)
    hits = find_hits(located, items, n).select(*LOCATOR, F.col("hits").alias("__rw_hits"))
    return _cut(located.join(hits, LOCATOR, "left"), docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hits", *LOCATOR)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM g),
p AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM d, sizes, unnest(generate_series(1, len(w) - size + 1)) AS u(i)),
hit AS (SELECT p.doc_id, p.i, p.size, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.size = g.size),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(generate_series(i, i + size - 1)) AS u(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
