"""Mixture-controlled packing by deficit round-robin over the sources' queues.

Every source's documents form a queue of tokens, cut in units of ``quantum`` tokens. Each round gives every queue a
credit in proportion to its target and serves the units that the credit pays for; what is left over is carried to the
next round. What round w has served is a closed form of w (a phase ends when a queue runs dry and the others take over
its share), so every task places its own documents, and the deficits pass windows and partitions without any task
waiting for another. With more than QUEUES sources, the schedule is nested: sources dealt by hash share a queue, which
has the sum of their targets and is itself filled by deficit round-robin over its sources; what a source leaves when it
runs dry goes to the others of its shared queue first. Sources without a target share queues among themselves only, so
they still come last. The stream is cut into sequences of ``width`` tokens; the rest at its end becomes sequences whose
lengths are powers of two, so nothing is padded.

Nulls: a null text is the empty text (its end id alone), a null source a queue of its own. Repeated rows and ids are
documents of their own. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm import common, tokens

#: Hash values by which sources share a queue once there are more sources than that.
QUEUES = 512
ONE = 20  # fixed-point bits of a credit
ROWS = 1024  # documents that one step cuts
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Schedule:
    """Where each unit of each queue lies in the stream."""

    def __init__(self, lengths: np.ndarray, targets: np.ndarray, width: int = 2048, quantum: int = 128, last: np.ndarray | None = None) -> None:
        """``last``: shares once only queues without a target are left (default: equal)."""
        self.lengths, self.quantum, self.width = np.asarray(lengths, np.int64), quantum, width
        units = -(-self.lengths // quantum)
        served, credit = np.zeros_like(units), np.zeros_like(units)
        self.phases = []  # served before, credit before, rate, left, position before
        position = 0
        while (left := units - served).any():
            share = np.where(left > 0, targets, 0.0)
            share = share if share.sum() > 0 else np.where(left > 0, 1.0 if last is None else last, 0.0)
            rate = np.where(left > 0, np.maximum(1, np.round(share / share.sum() * (width // quantum) * (1 << ONE))), 0).astype(np.int64)
            full = np.where(left > 0, ((left << ONE) - credit) // np.maximum(rate, 1), np.iinfo(np.int64).max)
            rounds = max(1, int(full.min()))
            self.phases.append((served, credit, rate, left, position))
            paid = credit + rate * rounds
            done = np.minimum(left, paid >> ONE)
            served, credit = served + done, np.where(left > done, paid - (done << ONE), 0)
            position += int(done.sum())
        self.starts = np.array([p[0] for p in self.phases], np.int64).reshape(len(self.phases), len(units))
        short = np.flatnonzero(self.lengths % quantum)
        self.short_at = np.array([self.position(s, units[s : s + 1] - 1)[0] for s in short], np.int64)
        by = np.argsort(self.short_at)
        self.short_at = self.short_at[by]
        self.missing = np.concatenate([[0], np.cumsum(quantum - self.lengths[short][by] % quantum)])
        total = int(self.lengths.sum())
        rest, tail = total % width, [total - total % width]
        for bit in range(width.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        self.tail = np.array(tail, np.int64)  # where the last, shorter sequences begin, and the end

    def position(self, queue: int, unit: np.ndarray) -> np.ndarray:
        """The place, in units, of a queue's units."""
        out = np.empty(len(unit), np.int64)
        phase = np.searchsorted(self.starts[:, queue], unit, "right") - 1
        for p in np.unique(phase):
            served, credit, rate, left, base = self.phases[p]
            k = unit[phase == p] - served[queue]
            turn = np.maximum(1, -((credit[queue] - ((k + 1) << ONE)) // rate[queue]))  # the first round that pays for unit k
            after = np.minimum(left, (credit + rate * turn[:, None]) >> ONE)
            before = np.where(turn[:, None] > 1, np.minimum(left, (credit + rate * (turn[:, None] - 1)) >> ONE), 0)
            out[phase == p] = base + before.sum(axis=1) + (after - before)[:, :queue].sum(axis=1) + k - before[:, queue]
        return out

    def place(self, unit_position: np.ndarray) -> np.ndarray:
        """The token at which a unit begins: units before it, less what the queues' short last units lack."""
        return unit_position * self.quantum - self.missing[np.searchsorted(self.short_at, unit_position)]

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence id, its first token, and the token after its last."""
        full = int(self.tail[0]) // self.width
        k = np.searchsorted(self.tail, at, "right") - 1
        late = at >= self.tail[0]
        begin = np.where(late, self.tail[np.maximum(k, 0)], at // self.width * self.width)
        end = np.where(late, self.tail[np.minimum(k + 1, len(self.tail) - 1)], begin + self.width)
        return np.where(late, full + k, at // self.width), begin, end

    def at(self, queue: int, token: np.ndarray) -> np.ndarray:
        """Where tokens of a queue lie in the stream."""
        unit = token // self.quantum
        return self.place(self.position(queue, unit)) + token - unit * self.quantum

    def cut(self, queue: int, start: int, n: int, inner: Schedule | None = None, source: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of a document that begins at ``start`` of its queue, or of its source's queue in the ``inner``
        schedule of a shared one: start in it, length, sequence id, offset."""
        q = self.quantum
        unit = np.arange(start // q, (start + n - 1) // q + 1)
        lo, hi = np.maximum(unit * q, start), np.minimum((unit + 1) * q, start + n)
        token = lo
        if inner is not None:  # a unit of the source may end in the shared queue's next unit
            token = inner.at(source, lo)
            split = lo + (token // q + 1) * q - token
            over = split < hi
            lo, hi, token = np.concatenate([lo, split[over]]), np.concatenate([np.minimum(hi, split), hi[over]]), np.concatenate([token, (token // q + 1)[over] * q])
        at = self.at(queue, token)
        rows = []
        while len(lo):  # a run is cut where its sequence ends
            seq, begin, end = self.sequence(at)
            stop = np.minimum(hi, lo + end - at)
            rows.append((lo - start, stop - lo, seq, at - begin))
            more = stop < hi
            lo, hi, at = stop[more], hi[more], (at + stop - lo)[more]
        first, length, seq, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
        if len(rows) > 1 or inner is not None:
            by = np.argsort(first)
            first, length, seq, offset = first[by], length[by], seq[by], offset[by]
        new = np.ones(len(first), bool)
        new[1:] = (seq[1:] != seq[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
        heads = np.flatnonzero(new)
        return first[heads], np.add.reduceat(length, heads), seq[heads], offset[heads]


def queues(docs: DataFrame, path: str, end: int) -> DataFrame:
    """source, part (the task that wrote it), at (tokens of the source before it in that task), doc_id, n, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for b in common.pieces(whole, "text"):
                ids, n, _ = tokens.encode_rows(b, "text", path, False, end)
                at = []
                for s, k in zip(b.column("source").to_pylist(), n.tolist(), strict=True):
                    at.append(held[s])
                    held[s] += k
                cols = [b.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), b.column("doc_id"), pa.array(n), ids]
                yield pa.RecordBatch.from_arrays(cols, ["source", "part", "at", "doc_id", "n", "ids"])

    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return common.materialize(rows.mapInArrow(run, "source string, part int, at long, doc_id long, n long, ids binary"), "queues")


def mixture_pack(docs: DataFrame, path: str, end: int = 1, width: int = 2048, quantum: int = 128, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents. ``targets``: share of each source (default: its share of all tokens); sources that it
    doesn't name come when the others have run dry. ``width`` and ``quantum``: powers of two."""
    encoded = queues(docs, path, end)
    size = tokens.id_bytes(path, False)
    sums = common.materialize(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")), "queue-sums")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    hashed = F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("int")
    bases = sums.select(F.col("source").alias("source_"), F.col("part").alias("part_"), hashed.alias("hash"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = sums.groupBy("source", hashed.alias("hash")).agg(F.sum("n").alias("n")).collect()  # a row for each source
    totals.sort(key=lambda r: (r.source is not None, r.source or ""))
    many = len(totals) > QUEUES
    target = {r.source: float(r.n) if targets is None else targets.get(r.source, 0.0) for r in totals}
    members = defaultdict(list)  # of each queue, in the order of sources
    for i, r in enumerate(totals):
        members[r.hash if many else i, target[r.source] > 0].append(r)
    lengths, wanted = (np.array([sum(f(r) for r in m) for m in members.values()], k) for f, k in ((lambda r: r.n, np.int64), (lambda r: target[r.source], float)))
    outer = Schedule(lengths, wanted, width, quantum, np.array([len(m) for m in members.values()], float))
    shared = [(np.array([r.n for r in m], np.int64), np.array([target[r.source] for r in m])) if len(m) > 1 else None for m in members.values()]
    schedule = docs.sparkSession.sparkContext.broadcast((outer, shared, {r.source: (g, k) for g, m in enumerate(members.values()) for k, r in enumerate(m)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, shared, number = schedule.value
        inner, held = {}, None  # the schedules of the shared queues of one hash
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            columns = [b.column(c).to_pylist() for c in ("doc_id", "source", "hash", "base", "at", "n", "ids")]
            rows = []
            for doc, source, h, base, at, n, ids in zip(*columns, strict=True):
                wide = np.frombuffer(ids, f"<u{size}").astype("<u4").tobytes()
                g, k = number[source]
                if h != held:
                    inner, held = {}, h
                if shared[g] and g not in inner:
                    inner[g] = Schedule(*shared[g], width, quantum)
                for first, length, seq, offset in zip(*(x.tolist() for x in plan.cut(g, base + at, n, inner.get(g), k)), strict=True):
                    rows.append((doc, first, length, zlib.crc32(wide[4 * first : 4 * (first + length)]), n, seq, offset, source))
            kinds = [pa.int64()] * 7 + [pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    rows = encoded.join(bases, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    rows = rows.select("doc_id", "source", "hash", "base", "at", "n", "ids")
    return (rows.sortWithinPartitions("hash") if many else rows).mapInArrow(run, PIECES)
