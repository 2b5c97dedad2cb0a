"""Completion of tasks: by the server's rule and by the client's, and progress tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.operators import chains


def complete_tasks(submitted: DataFrame, dimensions: list[str]) -> DataFrame:
    """(annotator_id, task_id) with every dimension submitted; one submitted again doesn't stand for another."""
    own = submitted.where(F.col("dimension").isin(dimensions))
    return own.groupBy("annotator_id", "task_id").agg(F.count_distinct("dimension").alias("d")).where(F.col("d") == len(dimensions)).drop("d")


def client_complete(attempts: DataFrame, submitted: DataFrame, dimensions: list[str]) -> DataFrame:
    """The client's rule: the latest attempt of each dimension must be the submitted one, so an unsubmitted redo undoes."""
    last = chains.latest(attempts, ["annotator_id", "task_id", "dimension"], ["started_at", "attempt_id"])
    return complete_tasks(last.join(submitted.select("attempt_id").distinct(), "attempt_id", "left_semi"), dimensions)


def completion_times(submitted: DataFrame, dimensions: list[str]) -> DataFrame:
    """When each task was complete first: the latest of the first submissions of its dimensions. A redo doesn't move it."""
    firsts = submitted.where(F.col("dimension").isin(dimensions)).groupBy("annotator_id", "task_id", "dimension").agg(F.min("submitted_at").alias("first_at"))
    done = firsts.groupBy("annotator_id", "task_id").agg(F.count("*").alias("n"), F.max("first_at").alias("completed_at"))
    return done.where(F.col("n") == len(dimensions)).drop("n")


def progress(queue: DataFrame, touched: DataFrame, done: DataFrame) -> DataFrame:
    """For each annotator: assigned, anchors, started, submitted, in progress (of active queue rows) and submitted_all (of
    all tasks ever done). ``queue``: annotator_id, task_id, is_anchor, status; ``touched``, ``done``: annotator_id, task_id."""
    key = ["annotator_id", "task_id"]
    own = queue.where("status = 'active'").select(*key, "is_anchor")
    seen = touched.select(*key).distinct().withColumn("t", F.lit(1))
    finished = done.select(*key).distinct().withColumn("d", F.lit(1))
    rows = own.join(seen, key, "left").join(finished, key, "left")
    table = rows.groupBy("annotator_id").agg(
        F.count("*").alias("assigned"),
        F.count_if("is_anchor").alias("anchors"),
        F.count("t").alias("started"),
        F.count("d").alias("submitted"),
        F.count_if(F.col("t").isNotNull() & F.col("d").isNull()).alias("in_progress"),
    )
    ever = finished.groupBy("annotator_id").agg(F.count("*").alias("submitted_all"))
    return table.join(ever, "annotator_id", "left").withColumn("submitted_all", F.coalesce("submitted_all", F.lit(0)))
