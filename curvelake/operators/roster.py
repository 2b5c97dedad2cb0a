"""Accounts, what they have begun, and the maps between samples, numbers and tasks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.operators.allocation import numbered

#: An account of a stage: number of the stage, language, number of the person.
ACCOUNT = r"^P\d+-(ZH|EN)-\d+$"


def begun(people: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``people`` and ``begun``: is there a row of theirs? A person's rows are one before they meet."""
    there = rows.select(key).distinct().withColumn("there_", F.lit(True))
    return people.join(there, key, "left").withColumn("begun", F.coalesce("there_", F.lit(False))).drop("there_")


def last_of_any(people: DataFrame, rows: DataFrame, key: str, value: str, kinds: list[Column]) -> DataFrame:
    """``people`` and ``last``: the largest ``value`` among the rows of any of the kinds, each of which may be absent; null without any."""
    own = rows.groupBy(key).agg(F.max(F.when(functools.reduce(Column.__or__, kinds), F.col(value))).alias("last"))
    return people.join(own, key, "left")


def skip_set(key: str, *sets: DataFrame) -> DataFrame:
    """The ids that any of the sets holds, each once."""
    return functools.reduce(DataFrame.union, (s.select(key) for s in sets)).distinct()


def account_violation(account: Column, language: Column) -> Column:
    """name: it isn't an account of a stage; language: it says another one than the person's; null: neither."""
    said = F.lower(F.regexp_extract(account, ACCOUNT, 1))
    return F.when(said == "", "name").when(said != language, "language")


def new_accounts(people: DataFrame, having: DataFrame, key: str, prefix: str, last: int) -> DataFrame:
    """key, account: the next numbers after ``last`` for those who have no account, by key; who has one is passed over."""
    new = people.select(key).join(having.select(key), key, "left_anti").distinct()
    return numbered(new, [F.col(key)], "k_").select(key, F.format_string(f"{prefix}%02d", F.col("k_") + last + 1).alias("account"))


def index_maps(numbers: DataFrame, modalities: list[str] | tuple[str, ...]) -> DataFrame:
    """source_id, number, modality, task_id: each sample's number and its task in each modality. ``numbers``: source_id, number."""
    rows = numbers.select("source_id", "number", F.explode(F.array(*map(F.lit, modalities))).alias("modality"))
    return rows.withColumn("task_id", F.concat_ws("::", "number", "modality"))


def task_state(latest: DataFrame, dimensions: int) -> DataFrame:
    """annotator_id, task_id, dimension, submitted, complete (all ``dimensions`` are submitted). ``latest``: the latest attempt of each."""
    w = Window.partitionBy("annotator_id", "task_id")
    whole = F.bool_and("submitted").over(w) & (F.count("*").over(w) == dimensions)
    return latest.select("annotator_id", "task_id", "dimension", "submitted", whole.alias("complete"))
