"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local master without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set; a cluster needs a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """Rows that were written once, and their number, counted as they are written: reading them again needs no lineage."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_root(self.spark)}/rulewright/{tag}-{uuid.uuid4().hex}"
        seen = Observation()
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.path)
        except Exception:
            delete(self.spark, self.path)
            raise
        self.rows: int = seen.get["n"]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def read_all(tables: list[Table]) -> DataFrame:
    """The rows of tables of one schema, as one scan."""
    return tables[0].spark.read.schema(tables[0].schema).parquet(*(t.path for t in tables))
