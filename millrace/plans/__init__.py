"""Registered queries: each module pairs DataFrame plans with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # texts in fewer splits than there are cores are dealt out, as the work on each row is what costs; larger tables are never shuffled
        if name in ("documents", "pages") and df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism:
            df = df.repartition(self.spark.sparkContext.defaultParallelism)
        return df


class Catalog:
    """Queries and their SQL, filled by decorators."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(plan):
            self.queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return plan

        return add
