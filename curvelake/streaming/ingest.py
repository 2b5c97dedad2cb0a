"""Streams of sample chunks: idempotent ingest, and the sampler as a stateful operator."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curvelake.operators.curves import MOST_FILLED

CELLS = "curve string, cell long, v double, filled boolean"


def once(chunks: DataFrame, key: list[str], at: str = "created_at", within: str = "1 hour") -> DataFrame:
    """Each chunk once, whatever is sent again; the state of a key is kept as long as the watermark allows."""
    return chunks.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, at: str, gap: str = "10 minutes") -> DataFrame:
    """key, start, end, n of each session of events less than ``gap`` apart."""
    s = F.session_window(F.col(at), gap)
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def sample(points: DataFrame, hz: int = 10, idle_s: int = 86_400) -> DataFrame:
    """The client's sampler over a stream: a cell for each new floor(t * hz) of a curve, and, while playback runs on, the
    cells that it skipped (MOST_FILLED at most) by linear interpolation. A point with ``playing`` false breaks it off.

    A curve's state is its last cell and value, dropped once events are ``idle_s`` seconds past its last. ``points``: curve, seq, t, v,
    playing, at (when the event happened).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, value, running = state.get if state.exists else (-1, 0.0, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for t, v, playing in rows[["t", "v", "playing"]].itertuples(index=False):
            if not playing:
                running = False
                continue
            cell = math.floor(t * hz)
            if cell > last:
                skipped = cell - last - 1
                if running and last >= 0 and 0 < skipped <= MOST_FILLED:
                    out += [(key[0], c, value + (v - value) * (c - last) / (cell - last), True) for c in range(last + 1, cell)]
                out.append((key[0], cell, v, False))
                last, value = cell, v
            running = True
        state.update((last, value, running))
        latest = max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(latest + 1000 * idle_s)
        yield pd.DataFrame(out, columns=["curve", "cell", "v", "filled"])

    return points.withWatermark("at", f"{idle_s} seconds").groupBy("curve").applyInPandasWithState(run, CELLS, "last long, value double, running boolean", "append", GroupStateTimeout.EventTimeTimeout)
