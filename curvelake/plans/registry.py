"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL with the same result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submissions: a user rates a day's task in a dimension (the event type)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("submission_id"),
        F.col("user_id").alias("annotator_id"),
        F.dayofmonth("ts").alias("task_id"),
        F.col("event_type").alias("dimension"),
        F.col("ts").alias("submitted_at"),
        "value",
    )


#: The same in SQL.
SUBMISSIONS = """submissions AS (SELECT event_id AS submission_id, user_id AS annotator_id, CAST(day(ts) AS INTEGER) AS task_id,
  event_type AS dimension, ts AS submitted_at, value FROM events)"""
