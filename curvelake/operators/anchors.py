"""Hidden anchors: tasks of a stage's queue that reference accounts have rated, and who is compared with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Account names: stage, language, number; and reference accounts (fixed formats).
STAGE_ACCOUNT, REFERENCE = r"^P(\d+)-(ZH|EN)-\d+$", r"^REF-\d+$"


def stage_queue(queue: DataFrame, stage: int) -> DataFrame:
    """task_id, account: the active main assignments of the stage's accounts, each once."""
    own = queue.where("phase = 'main' and status = 'active'")
    return own.where(F.regexp_extract("account", STAGE_ACCOUNT, 1) == str(stage)).select("task_id", "account").distinct()


def sides(latest: DataFrame, owners: DataFrame, training: DataFrame) -> DataFrame:
    """``latest`` submissions in the stage's queue with ``side``: of a reference account, or of an owner of the task. Those
    of others go, and so do tasks that anyone trains on (their reference curve is shown there)."""
    staged = latest.join(owners.select("task_id").distinct(), "task_id", "left_semi").join(training, "task_id", "left_anti")
    own = owners.withColumn("o_", F.lit(True))
    side = F.when(F.col("account").rlike(REFERENCE), "reference").when(F.col("o_"), "owner")
    return staged.join(own, ["task_id", "account"], "left").withColumn("side", side).where("side is not null").drop("o_")


def ready(sides_: DataFrame, dimensions: list[str]) -> DataFrame:
    """task_id of those with a reference in every dimension."""
    rated = sides_.where("side = 'reference'").groupBy("task_id").agg(F.count_distinct("dimension").alias("d"))
    return rated.where(F.col("d") == len(dimensions)).select("task_id")


def reference_progress(queued: DataFrame, owners: DataFrame, done: DataFrame) -> DataFrame:
    """One row: anchors queued for the reference in this stage, tasks done, and those of them that were queued."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    staged = queued.join(owners.select("task_id").distinct(), "task_id", "left_semi")
    return count(staged, "queued").crossJoin(count(done, "done")).crossJoin(count(done.join(queued, "task_id", "left_semi"), "done_from_queue"))


def with_reference(owners: DataFrame, dimensions: list[str], reference: DataFrame, notes: DataFrame) -> DataFrame:
    """Each owner's task in each dimension with the reference attempt and its note, null where there is none."""
    rows = owners.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    return rows.join(reference, ["task_id", "dimension"], "left").join(notes, ["task_id", "dimension"], "left").select("account", "task_id", "dimension", "attempt_id", "note")


def hide_training(rows: DataFrame, training: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` null for training tasks."""
    marked = rows.join(training.withColumn("t_", F.lit(True)), "task_id", "left")
    return marked.withColumn(column, F.when(F.col("t_").isNull(), F.col(column))).drop("t_")


def import_reference(new: DataFrame, stored: DataFrame) -> DataFrame:
    """task_id, dimension, attempt_id, note: the new curves; a stored note stays where no new one comes."""
    old = stored.select("task_id", "dimension", F.col("note").alias("old_"))
    return new.join(old, ["task_id", "dimension"], "left").select("task_id", "dimension", "attempt_id", F.coalesce("note", "old_").alias("note"))
