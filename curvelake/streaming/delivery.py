"""Delivery of chunks: in order, once, and with what a new snapshot changes."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from curvelake import scratch
from curvelake.operators import monitor
from curvelake.sources import files

RELEASED = "attempt string, index long, size long, payload string, place long, skipped long, late boolean"
RELEASE = Row(*(c.split()[0] for c in RELEASED.split(", ")))
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state where maps and timers are supported."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Release(StatefulProcessor):
    """The queue of one attempt. ``at``: the index that has to leave next, how many have left, and the timer that is set while anything waits;
    ``held``: chunks behind a gap; ``lost``: ranges that were given up, first to last index, both as JSON, a line for what a batch brought. Each is
    read and written once at most for all the rows of a batch, as every call and every line goes through the JVM, and only where it has to be."""

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, place long, timer long")
        self.held = handle.getListState("held", "chunks string")
        self.lost = handle.getListState("lost", "ranges string")

    def close(self) -> None:
        pass

    @staticmethod
    def late(lost: dict, index: int, size: int) -> bool:
        """Takes an index that was given up off those."""
        for first, last in lost.items():
            if first <= index <= last:
                del lost[first]
                if first < index:
                    lost[first] = index - 1
                if index + size <= last:
                    lost[index + size] = last
                return True
        return False

    def move(self, attempt: str, arrived: list, until_ms: int) -> Iterator[Row]:
        """Takes what has arrived and lets go what is next in line, and behind gaps whose chunk has waited long enough by ``until_ms``; sets
        the timer for the first gap that is left."""
        begun = self.at.get() or (0, 0, None)
        start, place, timer = begun
        before = {} if timer is None else {index: rest for index, *rest in self.lines(self.held)}
        held, lost, gone, out = dict(before), None, [], []
        for _, index, size, payload, at_ms in arrived:
            if index < start:
                if lost is None:
                    known = dict(self.lines(self.lost))
                    lost = dict(known)
                if self.late(lost, index, size):
                    out.append(RELEASE(attempt, index, size, payload, place, 0, True))
                    place += 1
            elif index not in held:
                held[index] = [size, payload, at_ms]
        for index in sorted(held):
            size, payload, at_ms = held[index]
            skipped = index - start
            if skipped > 0:
                if at_ms + self.patience > until_ms:
                    break
                gone.append((start, index - 1))
            out.append(RELEASE(attempt, index, size, payload, place, max(skipped, 0), False))
            del held[index]
            start, place = index + size, place + 1
        due = held[min(held)][2] + self.patience if held else None
        self.settle(before, held)
        if lost is not None and lost != known:
            self.replace(self.lost, [*lost.items(), *gone])
        elif gone:
            self.lost.appendValue((json.dumps(gone),))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if (start, place, due) != tuple(begun):
            self.at.update((start, place, due))
        return iter(out)

    def settle(self, before: dict, held: dict) -> None:
        if before.keys() - held.keys():
            self.replace(self.held, [(k, *x) for k, x in held.items()])
        elif new := [(k, *x) for k, x in held.items() if k not in before]:
            self.held.appendValue((json.dumps(new),))

    @staticmethod
    def lines(state: ListState) -> Iterator[list]:
        return itertools.chain.from_iterable(json.loads(line) for (line,) in state.get())

    @staticmethod
    def replace(state: ListState, rows: list) -> None:
        state.put([(json.dumps(rows),)]) if rows else state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = [(r["at_us"], r["index"], r["size"], r["payload"], r["at_us"] // 1000) for r in rows]
        arrived.sort(key=lambda r: (*r[:3], r[3] or ""))
        return self.move(key[0], arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.move(key[0], [], timerValues.getCurrentWatermarkInMs())


def in_order(chunks: DataFrame, patience_s: int = 600, behind_s: int = 3600, at: str = "at") -> DataFrame:
    """Chunks of an attempt in the order of their index, each once, however they arrive: a gap holds back what follows. Once the watermark is
    ``patience_s`` past the first chunk behind a gap, the gap is given up (``skipped`` indexes before that chunk). A chunk that was given up and
    comes after all leaves at once and is marked ``late``. ``place``: 0, 1, ... as they leave.

    ``chunks``: attempt string, index long (0 at first), size long (the next chunk has index + size), payload string, ``at`` timestamp (when it
    was received). The watermark stays ``behind_s`` behind the newest chunk; what is older than that doesn't get in.
    The state of an attempt is its place, what waits behind a gap, and the ranges given up. Start the stream inside ``map_state``.
    """
    rows = chunks.select("attempt", "index", "size", "payload", F.col(at).alias("at"), F.unix_micros(at).alias("at_us")).withWatermark("at", f"{behind_s} seconds")
    return rows.groupBy("attempt").transformWithState(statefulProcessor=Release(patience_s * 1000), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")


def assembled(chunks: DataFrame) -> DataFrame:
    """The same of a finished batch: the first of each (attempt, index) by arrival, ``place`` by index."""
    from pyspark.sql import Window

    first = chunks.groupBy("attempt", "index").agg(F.min_by(F.struct("size", "payload"), "at").alias("c"))
    w = Window.partitionBy("attempt").orderBy("index")
    ends = F.col("index") + F.col("c.size")
    skipped = F.col("index") - F.coalesce(F.lag(ends).over(w), F.lit(0))
    return first.select("attempt", "index", "c.size", "c.payload", (F.row_number().over(w) - 1).cast("long").alias("place"), skipped.alias("skipped"))


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """A writer that appends each batch to JSON lines once, also if it is run again."""
    return stream.writeStream.foreachBatch(lambda rows, batch: files.append_once(rows, path, f"batch-{batch}")).option("checkpointLocation", checkpoint)


def buffered(samples: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """A writer that gathers samples for ``every`` and flushes them as chunks (attempt_id, chunk_index: first sample's index, samples), each flush
    once. ``samples``: attempt_id, sample_index, and what a sample consists of. A chunk holds what an attempt brought in one interval."""
    rest = [c for c in samples.columns if c != "attempt_id"]

    def flush(rows: DataFrame, batch: int) -> None:
        own = rows.groupBy("attempt_id").agg(F.min("sample_index").alias("chunk_index"), F.array_sort(F.collect_list(F.struct(*rest))).alias("samples"))
        files.append_once(own, path, f"flush-{batch}")

    return samples.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=every)


class Watch:
    """Alerts about snapshots as they arrive. Each batch is compared with the snapshot stored by the batch before it, and leaves its own;
    a batch that is run again finds the same predecessor and replaces what it wrote, so nothing is told twice.

    Rows: ``key``, ``order`` (number of the snapshot), state, trained, idle, on_track, percent, active. What a batch stores is
    one row for each key. Keys that aren't ``active`` are stored, but nothing is said about them.
    """

    def __init__(self, key: str, order: str, base: str) -> None:
        self.key, self.order, self.base = key, order, base.rstrip("/")

    def stored(self, spark: SparkSession, batch: int) -> int | None:
        return max((n for n in (int(name) for name in scratch.names(spark, f"{self.base}/snapshots")) if n < batch), default=None)

    def told(self, rows: DataFrame) -> DataFrame:
        """key, order, alert of rows and what came before them."""
        said = monitor.alerts(rows, self.key, self.order)
        passed = monitor.milestones(rows, self.key, self.order).select(self.key, self.order, F.format_string("%d%%", "mark").alias("alert"))
        first = rows.groupBy(self.key).agg(F.min(self.order).alias(self.order))
        known = passed.join(first, [self.key, self.order], "left_anti")  # of a first snapshot nothing is told
        return said.union(known).join(rows.where("active").select(self.key, self.order), [self.key, self.order], "left_semi")

    def take(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = self.stored(spark, batch)
        new = rows.select(self.key, self.order, "state", "trained", "idle", "on_track", "percent", "active")
        held = new
        if before is not None:
            held = spark.read.schema(new.schema).parquet(f"{self.base}/snapshots/{before}").union(new)
        last = held.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in new.columns if c != self.key)), self.order).alias("s_"))
        alerts = self.told(held).join(new.select(self.key, self.order), [self.key, self.order], "left_semi")
        alerts.write.mode("overwrite").parquet(f"{self.base}/alerts/batch={batch}")
        last.select(self.key, "s_.*").write.mode("overwrite").parquet(f"{self.base}/snapshots/{batch}")
        for n in scratch.names(spark, f"{self.base}/snapshots"):
            if before is not None and int(n) < before:  # the one before stays, in case this batch is run again
                scratch.discard(spark, f"{self.base}/snapshots/{n}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)

    def alerts(self, spark: SparkSession, kinds: str) -> DataFrame:
        """All that was told; ``kinds``: types of key and order."""
        k, o = kinds.split(", ")
        return spark.read.schema(f"{self.key} {k}, {self.order} {o}, alert string").parquet(f"{self.base}/alerts/*")
