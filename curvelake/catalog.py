"""Every query of the library by name, with its SQL for the comparison in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvelake.plans import chains, curves, delivery, ingest, media, panel, plan, queues, review, upkeep

MODULES = (chains, curves, queues, media, ingest, delivery, panel, plan, review, upkeep)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
