"""Turns of conversations in order, and digests over ordered rows, however many rows one key has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm import common

#: Positions in a segment of a scan; a key's rows are scanned segment by segment, and the segments' totals after that.
SEGMENT = 1024
#: Bytes that a task joins before it hands them on to a digest.
PIECE = 1 << 20


def digest_of(role: Column, text: Column) -> Column:
    """MD5 of a turn; the role's length keeps it from running into the text."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: empty), digest."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("digest", digest_of(F.col("role"), F.col("text")))


def ordered(rows: DataFrame, size: str | None = None) -> DataFrame:
    """``pos`` (0, 1, ... in the conversation by turn, null first, then digest) and ``start`` (``size`` of the turns before
    it) for rows with conv_id, turn and digest, instead of ``turn``. A conversation may run over many ranges of the order: each range
    is numbered by itself, and what came before is added to the one conversation that it continues."""
    kept = [f for f in rows.schema if f.name != "turn"]
    order = ["conv_id", "turn", "digest", "tie_"]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", part_ int, pos long, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, s = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, none = b.column("conv_id").fill_null(0).to_numpy(), b.column("conv_id").is_null().to_numpy(zero_copy_only=False)
            sizes = b.column(size).to_numpy() if size else np.zeros(b.num_rows, np.int64)
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
            of = np.repeat(np.arange(len(first)), np.diff([*first, b.num_rows]))
            before = np.cumsum(sizes) - sizes
            pos, start = np.arange(b.num_rows) - first[of], before - before[first][of]
            if last == (ids[0], none[0]):
                pos[of == 0] += n
                start[of == 0] += s
            last, n, s = (ids[-1], none[-1]), int(pos[-1]) + 1, int(start[-1] + sizes[-1])
            made = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(pos.astype(np.int64)), pa.array(start.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], [*(f.name for f in kept), "part_", "pos", "start"])

    made = common.materialize(spread.mapInArrow(run, schema), "turns")
    spans = made.groupBy("conv_id", "part_").agg(F.count("*").alias("n_"), F.sum(size or F.lit(0)).alias("s_"))
    before = Window.partitionBy("conv_id").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("conv_id").alias("id_"), F.col("part_").alias("at_"), F.sum("n_").over(before).alias("n_"), F.sum("s_").over(before).alias("s_"))
    carried = F.broadcast(carried.where("n_ is not null"))  # the one conversation that a range continues: a row for each range at most
    rows = made.join(carried, F.col("conv_id").eqNullSafe(F.col("id_")) & (F.col("part_") == F.col("at_")), "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return rows.withColumn("pos", plus("pos", "n_")).withColumn("start", plus("start", "s_")).drop("part_", "id_", "at_", "n_", "s_")


def scanned(rows: DataFrame, key: str, at: str, size: str, columns: dict[str, str], kind: str, order: list[Column], down: bool = False) -> DataFrame:
    """Running aggregates (``kind``: sum or bit_xor) of the rows of each ``key`` in ``order``, ascending in ``at`` or, if ``down``,
    descending: {new column: column}. Keys whose ``size`` is beyond a segment get the totals of their other segments added."""
    total, join = (F.sum, lambda a, b: a + b) if kind == "sum" else (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    rows = rows.withColumn("segment_", F.floor(F.col(at) / SEGMENT))
    here = Window.partitionBy(key, "segment_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.where(F.col(size) > SEGMENT - 1).groupBy(key, "segment_").agg(*(total(c).alias(n) for n, c in columns.items()))
    others = Window.partitionBy(key).orderBy(F.col("segment_").desc() if down else F.col("segment_")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "segment_", *(total(n).over(others).alias(f"{n}_before") for n in columns))
    inside = rows.select("*", *(total(c).over(here).alias(n) for n, c in columns.items()))
    out = inside.join(carried, [key, "segment_"], "left")
    return out.withColumns({n: join(F.col(n), F.coalesce(F.col(f"{n}_before"), F.lit(0).cast("long"))) for n in columns}).drop("segment_", *(f"{n}_before" for n in columns))


def sha256_by(rows: DataFrame, key: list[str], order: list[str], text: str, between: str = "") -> DataFrame:
    """``key`` and sha256: hex digest of each key's texts in order. Ranges of the order are joined to pieces first, wherever a
    key's rows lie; a digest then goes through a key's pieces one after the other and holds one piece at a time."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema, glue = ", ".join(f"{c} {fields[c]}" for c in key), between.encode()
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        made = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-3]), pa.array(cols[-3], pa.int32()), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.binary())], [*key, "part_", "n_", "body_"])

        for b in batches:
            for *k, t in zip(*(b.column(c).to_pylist() for c in [*key, text]), strict=True):
                if held and (k != last or size > PIECE):
                    made.append((*last, part, n, glue.join(held)))
                    n, held, size = n + 1, [], 0
                    if len(made) > 1000 or sum(len(x[-1]) for x in made[-1:]) > PIECE // 2:
                        yield out()
                last = k
                held.append(t.encode())
                size += len(held[-1])
        if held:
            made.append((*last, part, n, glue.join(held)))
        if made:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, made = None, None, []
        for b in batches:
            for *k, body in zip(*(b.column(c).to_pylist() for c in [*key, "body_"]), strict=True):
                if state is not None and k == last:
                    state.update(glue)
                else:
                    if state is not None:
                        made.append((*last, state.hexdigest()))
                    last, state = k, hashlib.sha256()
                state.update(body)
            if len(made) > 1000:
                cols = list(zip(*made, strict=True))
                made = []
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1])], [*key, "sha256"])
        if state is not None:
            cols = list(zip(*made, (*last, state.hexdigest()), strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1])], [*key, "sha256"])

    spread = rows.select(*key, *order, text).repartitionByRange(ranges, *key, *order).sortWithinPartitions(*key, *order)
    joined = spread.mapInArrow(pieces, f"{schema}, part_ int, n_ long, body_ binary")
    return joined.repartition(ranges, *key).sortWithinPartitions(*key, "part_", "n_").mapInArrow(digests, f"{schema}, sha256 string")
