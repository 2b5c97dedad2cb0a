"""Version chains: append-only records of which the latest counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake import scratch


def latest(rows: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """The last row of each chain. Aggregates before the shuffle, so a long chain costs its tasks one row each."""
    rest = [c for c in rows.columns if c not in chain]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*chain).agg(last.alias("last_")).select(*chain, *(F.col(f"last_.{c}").alias(c) for c in rest)).select(*rows.columns)


def superseded(rows: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """All rows but the last of each chain."""
    place = Window.partitionBy(*chain).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("place_", F.row_number().over(place)).where("place_ > 1").drop("place_")


def rounds(rows: DataFrame, chain: list[str], order: list[str], counts: Column) -> DataFrame:
    """``round`` k of ``round_count`` n among the rows of a chain for which ``counts`` holds; all others are 1 of 1."""
    key = [*chain, "counts_"]
    marked = rows.withColumn("counts_", F.coalesce(counts, F.lit(False)))
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*key))
    one = F.lit(1).cast("long")
    out = marked.withColumns({"round": F.when(F.col("counts_"), k.cast("long")).otherwise(one), "round_count": F.when(F.col("counts_"), n).otherwise(one)})
    return out.withColumn("is_current", F.col("round") == F.col("round_count")).drop("counts_")


def rechain(rows: DataFrame, chain: list[str], order: list[str], key: str) -> DataFrame:
    """``revision`` from 1 by order, and ``previous_id``, the key of the row before."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return rows.withColumns({"revision": F.row_number().over(w), "previous_id": F.lag(key).over(w)})


def next_revision(rows: DataFrame, chain: list[str], order: list[str], key: str) -> DataFrame:
    """For each chain, the revision that a new row gets and the row that it follows."""
    return rows.groupBy(*chain).agg((F.count("*") + 1).alias("next_revision"), F.max_by(key, F.struct(*order)).alias("previous_id"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Idempotent write: of rows with one key the first stays."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_")).select(*key, *(F.col(f"first_.{c}").alias(c) for c in rest)).select(*rows.columns)


def local_wins(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Union by key in which the local row counts."""
    return local.unionByName(remote.join(local.select(*key).distinct(), key, "left_anti"))


def prune(rows: DataFrame, chain: list[str], order: list[str], keep: int) -> DataFrame:
    """Rows that an upkeep of ``keep`` versions (1 at least) lets go."""
    if keep < 1:
        raise ValueError("the newest version always stays")
    place = Window.partitionBy(*chain).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("place_", F.row_number().over(place)).where(F.col("place_") > keep).drop("place_")


def follow(rows: DataFrame, key: str, link: str) -> DataFrame:
    """key, root, depth and cyclic, by links alone: ``link`` names the row that a row replaces (null: none, it is a root).

    Pointers are doubled: in each round a row takes over the pointer of the row that it points at, so a chain of n rows is settled in log n
    rounds, whatever order or key they lie in. The nearest rows to a root are settled first; a round that settles none has only
    cycles left, and what leads into them: they have no root and no depth. A link to a row that isn't there makes a root. ``key`` is unique.
    """
    spark = rows.sparkSession
    there = rows.select(F.col(key).alias("to"), F.lit(True).alias("there_"))
    found = rows.select(F.col(key).alias("id"), F.col(link).alias("to")).join(there, "to", "left")
    is_root = F.col("there_").isNull()
    table = found.select("id", F.when(is_root, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(is_root, 0).otherwise(1).cast("long").alias("d"), is_root.alias("done"))
    folder, turn, before = scratch.folder(spark, "chains"), 0, None
    table = scratch.write(table, f"{folder}/0")
    while (left := table.where("not done").count()) and left != before:
        aim = table.select(F.col("id").alias("to"), F.col("to").alias("to_"), F.col("d").alias("d_"), F.col("done").alias("done_"))
        moved = table.where("not done").join(aim, "to").select("id", F.col("to_").alias("to"), (F.col("d") + F.col("d_")).alias("d"), F.col("done_").alias("done"))
        turn, before = turn + 1, left
        table = scratch.write(table.where("done").union(moved), f"{folder}/{turn}")
        scratch.discard(spark, f"{folder}/{turn - 1}")
    return table.select(F.col("id").alias(key), F.when(F.col("done"), F.col("to")).alias("root"), F.when(F.col("done"), F.col("d")).alias("depth"), (~F.col("done")).alias("cyclic"))
