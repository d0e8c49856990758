"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents, without the rows they reject:
rows without a language (null texts and those without a letter), copies of a text, all but one row of each group of near copies
(five-word shingles, a similarity of 0.8), and rows that hold a window of 13 words of the benchmark, of which items without an id are part. The
windows of shorter items are cut out of rows of which they are less than a twentieth. The last gives the mix: the documents' columns with shard, pass and rank_key, a row for each time
that it is drawn. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm import decontaminate, exact_dedup, language_id, mixing, near_tree
from rulewright.llm.common import read_table, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_tree.keep_one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express language ID and mixing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
