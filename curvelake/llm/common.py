"""Shared pieces of the training-data operators: text columns and the learning split, and the library's scratch tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from curvelake.scratch import collect_garbage, discard, materialize, passing, write  # noqa: F401
from curvelake.scratch import folder as scratch  # noqa: F401

#: Bytes of text that one vectorised step handles at a time.
BATCH_BYTES = 4 << 20
_held: dict[Hashable, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4


def quoted(name: str) -> str:
    """A column name as Spark's expressions and schema strings take it."""
    return "`" + name.replace("`", "``") + "`"


def with_struct(docs: DataFrame, run: Callable, out: str, kind: str, drop: str = "") -> DataFrame:
    """All columns of ``docs`` but ``drop``, and ``out`` of type ``kind``: ``run`` adds it to batches whose columns are
    numbered. Types are handed on as they are, so names may hold any characters, also inside structs."""
    kept = [f for f in docs.schema if f.name != drop]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [StructField("made", DataType.fromDDL(kind))])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema).toDF(*(f.name for f in kept), out)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a process builds once and holds for the batches and tasks that follow: one thing at a time, as Spark hands its
    Python workers on from operator to operator."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what other operators' tasks have left in this process, and gives freed memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text starts in them; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str | int, most: int = BATCH_BYTES):
    """Cuts a batch into runs of rows with about ``most`` bytes of text, one row at least."""
    _, at = flat(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
