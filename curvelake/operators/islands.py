"""Runs, gaps and smoothing over ordered frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each maximal run of equal values: first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("c_", changed).withColumn("run", F.sum("c_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def close_open(rows: DataFrame, key: str, order: str, value: str, hold: int | Column, keep: int | Column) -> DataFrame:
    """Fill inner gaps of at most ``hold`` frames, then drop visible runs of fewer than ``keep``. Gaps at either end stay."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = F.row_number().over(w)
    shown = rows.withColumn("n_", n).withColumn("p_", F.last(F.when(F.col(value), F.col("n_")), ignorenulls=True).over(before)).withColumn("q_", F.first(F.when(F.col(value), F.col("n_")), ignorenulls=True).over(after))
    closed = shown.withColumn("closed_", F.col(value) | F.coalesce(F.col("q_") - F.col("p_") - 1 <= hold, F.lit(False)))
    flag = (F.col("closed_") != F.coalesce(F.lag("closed_").over(w), ~F.col("closed_"))).cast("int")
    run = closed.withColumn("f_", flag).withColumn("run_", F.sum("f_").over(before))
    size = F.count("*").over(Window.partitionBy(key, "run_"))
    return run.withColumn("smooth", F.col("closed_") & (size >= keep)).drop("n_", "p_", "q_", "closed_", "f_", "run_")


def interpolate(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``full``: linear between known values, held at both ends."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    out = rows.withColumn("a_", F.last(known, ignorenulls=True).over(before)).withColumn("b_", F.first(known, ignorenulls=True).over(after))
    share = (F.col(order) - F.col("a_.x")) / (F.col("b_.x") - F.col("a_.x"))
    mid = F.col("a_.y") + (F.col("b_.y") - F.col("a_.y")) * share
    full = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("a_").isNull(), F.col("b_.y")).when(F.col("b_").isNull(), F.col("a_.y")).otherwise(mid)
    return out.withColumn("full", full).drop("a_", "b_")


def rolling_median(rows: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """``median`` of the rows from ``half`` before to ``half`` after, cut off at the ends."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    return rows.withColumn("median", F.percentile(value, 0.5).over(w))


def exponential(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.15) -> DataFrame:
    """``place`` (from 0) and ``ema``, the exponential moving average that begins with the first value.

    Rows are weighed in blocks by running sums; a block is so long that what its predecessor passes on is that one's last
    value alone (older ones weigh less than 1e-18)."""
    keep = 1 - alpha
    block = max(1, math.ceil(math.log(1e-18) / math.log(keep)))
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("place", F.row_number().over(w) - 1).withColumns({"b_": F.floor(F.col("place") / block), "i_": F.col("place") % block})
    share = F.when(F.col("place") == 0, 1.0).otherwise(alpha) * F.col(value)
    inside = F.sum(share * F.pow(F.lit(1 / keep), "i_")).over(Window.partitionBy(key, "b_").orderBy("place"))
    out = out.withColumn("own_", inside * F.pow(F.lit(keep), "i_"))
    before = F.last(F.when(F.col("i_") == block - 1, F.col("own_")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("ema", F.col("own_") + F.coalesce(before * F.pow(F.lit(keep), F.col("i_") + 1), F.lit(0.0))).drop("b_", "i_", "own_")
