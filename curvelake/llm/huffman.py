"""Token-id output: canonical, length-limited Huffman codes of ids from global counts, in files of independent blocks.

A file set is a folder with two tables. ``codebook``: ``id``, ``bits`` (canonical code lengths; the codes follow from
them). ``segments``: runs of whole documents in ascending id order, each with its documents' ids and token counts, the
packed bits, and the bit offset of every BLOCK-th token, from which any block decodes by itself.

Nulls: a null text is the empty text (its end id alone); null ids sort first. Repeated rows are documents of their own;
rows with one id lie in the order of their texts' hashes. An empty table gives empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.llm import common, tokens

#: Tokens between bit-offset checkpoints, and tokens after which a segment is closed.
BLOCK, SEGMENT = 256, 1 << 16
SEGMENTS = "shard int, segment int, start_in_shard long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; raised where the symbols need more bits."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    merged, kinds = weight, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(by >= n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for packages in [*kinds[::-1], np.zeros(n, bool)]:
        took = int(np.count_nonzero(packages[:take]))
        lengths[: take - took] += 1
        take = 2 * took
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The code of each id, in order of (length, id)."""
    codes, code, last = np.zeros(len(ids), np.int64), 0, 0
    for i in np.lexsort((ids, bits)):
        code <<= int(bits[i]) - last
        codes[i], last = code, int(bits[i])
        code += 1
    return codes


def pack(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes one after the other, most significant bit first, and the bit offset of each."""
    at = np.concatenate([[0], np.cumsum(bits)])
    word, shift = at[:-1] >> 6, at[:-1] & 63
    over = shift + bits - 64
    u = codes.astype(np.uint64)
    head = np.where(over <= 0, u << np.maximum(-over, 0).astype(np.uint64), u >> np.maximum(over, 0).astype(np.uint64))
    out = np.zeros(int(at[-1] >> 6) + 1, np.uint64)
    if len(codes):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(head, first)
        spill = over > 0
        out[word[spill] + 1] += u[spill] << (64 - over[spill]).astype(np.uint64)
    return np.frombuffer(out.astype(">u8").tobytes(), np.uint8)[: (int(at[-1]) + 7) // 8], at[:-1]


class Decoder:
    """Decodes many blocks at once: one table look-up of ``width`` bits for each block and step."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray) -> None:
        self.width = int(bits.max(initial=1))
        order = np.lexsort((ids, bits))
        reach = 1 << (self.width - bits[order])
        pad = (1 << self.width) - int(reach.sum())
        self.id = np.concatenate([np.repeat(ids[order], reach), np.zeros(pad, np.int64)]).astype(np.uint32)
        self.bits = np.concatenate([np.repeat(bits[order], reach), np.ones(pad, np.int64)])

    def decode(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``counts[i]`` ids (at most BLOCK) from bit ``offsets[i]`` on, for each block; ``counts`` descends only at the end of a segment."""
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        window = sum(wide[j : len(wide) - 4 + j] << np.uint64(8 * (4 - j)) for j in range(5))
        out = np.zeros((len(offsets), int(counts.max(initial=0))), np.uint32)
        at, live, mask = offsets.astype(np.int64).copy(), np.arange(len(offsets)), (1 << self.width) - 1
        for step in range(out.shape[1]):
            if step and (short := counts[live] <= step).any():
                live, at = live[~short], at[~short]
            look = (window[at >> 3] >> (40 - self.width - (at & 7)).astype(np.uint64)).astype(np.int64) & mask
            out[live, step] = self.id[look]
            at += self.bits[look]
        return out[np.arange(out.shape[1]) < counts[:, None]]


def encode(docs: DataFrame, path: str, end: int, joined: bool = True) -> DataFrame:
    """doc_id, tie (hash of the text), n_tokens, ids (little-endian binary, 2 bytes each where the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, "text", tokens.SLICE):
                ids, n, _ = tokens.encode_rows(b, "text", path, joined, end)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(n), ids], ["doc_id", "tie", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def id_counts(encoded: DataFrame, size: int) -> DataFrame:
    """id, n: how often each id occurs, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{size}")
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, tokenizer: str, end: int, out: str, limit: int = 16) -> None:
    """Encode ``docs`` and write their file set to ``out``."""
    with common.passing(docs.sparkSession):  # the encoded rows aren't needed after it
        write_files(docs, tokenizer, end, out, limit)


def write_files(docs: DataFrame, tokenizer: str, end: int, out: str, limit: int) -> None:
    spark = docs.sparkSession
    encoded = common.materialize(encode(docs, tokenizer, end), "ids")
    size = tokens.id_bytes(tokenizer, True)
    counts = id_counts(encoded, size).toPandas().sort_values("id")  # one row for each id of the vocabulary at most
    ids, n = counts.id.to_numpy(np.int64), counts.n.to_numpy(np.int64)
    bits = code_lengths(n, limit)
    book = pa.Table.from_arrays([pa.array(ids), pa.array(bits.astype(np.int32))], ["id", "bits"]).to_pandas()
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{out}/codebook")
    codes = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    widths = np.zeros_like(codes)
    codes[ids], widths[ids] = canonical(ids, bits), bits
    shared = spark.sparkContext.broadcast((codes, widths))  # two numbers for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, widths = shared.value
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, start, held
            own = np.frombuffer(b"".join(x[2] for x in held), f"<u{size}")
            data, at = pack(codes[own], widths[own])
            row = [shard, segment, start, len(own), [x[0] for x in held], [x[1] for x in held], at[::BLOCK].astype("<u8").tobytes(), data.tobytes()]
            segment, start, held = segment + 1, start + len(own), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])

        total = 0
        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held.append(row)
                total += row[1]
                if total >= SEGMENT:
                    yield close()
                    total = 0
        if held:
            yield close()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(f"{out}/segments")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` the ids as little-endian unsigned 32-bit integers."""
    book = spark.read.schema("id long, bits int").parquet(f"{path}/codebook").toPandas()  # bounded by the vocabulary
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sums = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each shard
    shared = spark.sparkContext.broadcast((book.id.to_numpy(np.int64), book.bits.to_numpy(np.int64)))
    made: list[Decoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Decoder(*shared.value))
        for whole in batches:
            for i in range(0, whole.num_rows, 32):
                yield block(whole.slice(i, 32))

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        datas = [np.frombuffer(x, np.uint8) for x in b.column("bits").to_pylist()]
        n = np.array(b.column("n_tokens").to_pylist(), np.int64)
        offsets, counts, lead = [], [], 0
        for data, at, k in zip(datas, b.column("offsets").to_pylist(), n, strict=True):
            offsets.append(np.frombuffer(at, "<u8").astype(np.int64) + 8 * lead)
            counts.append(np.minimum(BLOCK, k - BLOCK * np.arange(len(offsets[-1]))))
            lead += len(data)
        ids = made[0].decode(np.concatenate(datas), np.concatenate(offsets), np.concatenate(counts)).astype("<u4")
        sizes = np.array([x for d in b.column("doc_tokens").to_pylist() for x in d], np.int64)
        ends = np.cumsum(sizes)
        base = np.array(b.column("base").to_pylist(), np.int64) + np.array(b.column("start_in_shard").to_pylist(), np.int64)
        docs = b.column("doc_ids").to_pylist()
        raw = ids.tobytes()
        parts = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes, ends, strict=True)]
        start = ends - sizes + np.repeat(base - (np.cumsum(n) - n), [len(d) for d in docs])
        cols = [pa.array([x for d in docs for x in d], pa.int64()), pa.array(start), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(parts, pa.binary())] if keep_ids else cols, [*names, "ids"] if keep_ids else names)

    rows = segments.join(F.broadcast(bases), "shard")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
