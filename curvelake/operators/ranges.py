"""Interval and as-of joins as running aggregates over one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_spans(points: DataFrame, spans: DataFrame, width: float, slack: float = 0.0) -> DataFrame:
    """``in_span``: lies a point within ``slack`` of a span of its key? It does if, of all spans that begin by then, the one that ends
    last hasn't ended: a running maximum over points and spans in one order. It runs inside stretches of ``width``, so that a key's rows may
    lie in many tasks, and what the stretches before have reached is added. ``points``: key, at, ...; ``spans``: key, start, stop."""
    none = F.lit(None).cast("double")
    begun = spans.select(F.col("key"), (F.col("start") - slack).alias("at"), F.lit(0).alias("side_"), (F.col("stop") + slack).cast("double").alias("end_"))
    both = points.withColumns({"side_": F.lit(1), "end_": none}).unionByName(begun, allowMissingColumns=True).withColumn("b_", F.floor(F.col("at") / width))
    inside = Window.partitionBy("key", "b_").orderBy("at", "side_").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    reached = both.groupBy("key", "b_").agg(F.max("end_").alias("last_")).select("key", "b_", F.max("last_").over(before).alias("last_"))
    rows = both.withColumn("end_", F.max("end_").over(inside)).where("side_ = 1").join(reached.where("last_ is not null"), ["key", "b_"], "left")
    found = F.coalesce(F.greatest("end_", "last_") >= F.col("at"), F.lit(False)) & F.col("key").isNotNull()
    return rows.select(*points.columns, found.alias("in_span"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one shuffle, one sort, a running last."""
    held = F.struct(*values)
    rows = left.withColumn("side_", F.lit(1)).withColumn("v_", F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType))
    other = right.select(key, at, F.lit(0).alias("side_"), held.alias("v_"))
    w = Window.partitionBy(key).orderBy(at, "side_").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True).withColumn("v_", F.last("v_", ignorenulls=True).over(w))
    return both.where("side_ = 1").select(*left.columns, *(F.col(f"v_.{v}").alias(v) for v in values))
