"""Calls, tokens and what they cost at prices for a million."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def by_key(calls: DataFrame, key: str, price_in: float, price_out: float) -> DataFrame:
    """key, calls, tokens_in, tokens_out, cost. ``calls``: key, tokens_in, tokens_out."""
    rows = calls.groupBy(key).agg(*totals())
    return rows.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def totals() -> list[Column]:
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [F.count(F.lit(1)).alias("calls"), count("tokens_in"), count("tokens_out")]


def metered(calls: DataFrame, price_in: float, price_out: float) -> tuple[DataFrame, Callable[[], dict]]:
    """The same rows, and a meter: once an action has run over them, it tells the totals that this one action saw. A stream's totals
    come with its progress: ``calls.observe(name, *totals())``."""
    seen = Observation()

    def meter() -> dict:
        own = dict(seen.get)
        return own | {"cost": own["tokens_in"] / 1e6 * price_in + own["tokens_out"] / 1e6 * price_out}

    return calls.observe(seen, *totals()), meter
