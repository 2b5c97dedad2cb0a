"""Exact top-k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are stored in blocks of descending norm. A rotation to the principal axes (from the sum of outer products over
all vectors) gathers most of every product in the first few components, and blocks carry those. The longest vectors of
all, one block, give each query k scores at once; a query block is then only sent the blocks whose longest vector times
one of its queries' lengths can reach that query's k-th score. It goes through its share of them from the longest on;
with the k-th best score so far, a block that can't reach it is skipped, and so is each vector whose partial product plus
|rest of q| |rest of x| can't. What is left is scored exactly in integers. Each query's shares are then merged. The query
set is stated (ids divisible by ``every``) and goes against all vectors in blocks; both sides are cut in blocks of fixed size.

Vectors that are null, or hold a null or non-finite component, take no part; nor do rows with a null id. Shorter
vectors count as padded with zeros. Components beyond 2**57 are cut off there, and scores beyond 64 bits are
ranked by what they are and returned as the largest or smallest. Rows that repeat an id are candidates of their own,
never of queries with that id; each different vector of a repeated query id is a query of its own, numbered in
``variant``. Ties go to the smaller id. Extra columns are ignored; no vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm import common

#: Vectors in a block, partial components, and shares of the candidates that a query block is matched with in parallel.
BLOCK, HEAD, SHARES = 1024, 16, 8
BLOCKS = "block long, longest double, ids binary, body binary, rotated binary"
FOUND = "query_id long, variant long, vec_id long, score long, exact string"
#: Relative and absolute slack of the bounds, for what rounding may lose.
SLACK = (2e-6, 1e-6)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (integer components), norm; valid rows only."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = float(1 << 57)
    whole = lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * 64)))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, whole).alias("x"))
    return rows.withColumn("norm", F.aggregate("x", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch.column("x")
    size = np.diff(x.offsets.to_numpy())
    out = np.zeros((batch.num_rows, width), np.int64)
    out[np.arange(width) < size[:, None]] = x.flatten().to_numpy()
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Principal axes, by descending strength, from the sum of outer products over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b, width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], ["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # width * width rows
    gram = np.zeros((width, width))
    gram[sums.i, sums.j] = sums.s
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def rotate(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first components after the rotation, and the length of what the others hold."""
    r = x.astype(float) @ axes
    return r[:, :HEAD], np.sqrt((r[:, HEAD:] ** 2).sum(axis=1))


def blocks(rows: DataFrame, width: int, order: list, size: int, kind: str, axes) -> DataFrame:
    """Blocks of at most ``size`` vectors in ``order``, with a number that ascends with it; ``ids``: each vector's id and
    variant; ``kind``: of the integers; ``rotated``: head and rest of each, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, size):
                own = b.slice(i, size)
                ids = np.stack([own.column("vec_id").to_numpy(), own.column("variant").to_numpy()], 1).astype("<i8").tobytes()
                longest = float(np.sqrt(own.column("norm").to_numpy().max()))
                x = matrix(own, width)
                head, rest = rotate(x, axes.value)
                turned = np.concatenate([head, np.nextafter(rest.astype(np.float32), np.float32(np.inf))[:, None]], 1).astype("<f4").tobytes()
                cols = [pa.array([v], k) for v, k in ((part << 32 | n, pa.int64()), (longest, pa.float64()), (ids, pa.binary()), (x.astype(kind).tobytes(), pa.binary()), (turned, pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "longest", "ids", "body", "rotated"])
                n += 1

    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


class Search:
    """The best k of a block of queries so far. ``order``: of exact scores that fit 64 bits, and of others."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, axes: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids[:, 0], q, k
        self.variants = ids[:, 1]
        self.head, self.rest = rotate(q, axes)
        self.norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        self.score = np.full((len(ids), k), None, object)
        self.least = np.full(len(ids), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def live(self, longest: float) -> np.ndarray:
        """The queries whose k-th score a vector of this length can reach."""
        return np.flatnonzero(self.norm * longest * (1 + SLACK[0]) + SLACK[1] >= self.least)

    def reach(self) -> float:
        """The length that a vector must have to matter to one of the queries."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = (self.least - SLACK[1]) / (self.norm * (1 + SLACK[0]))
        return float(np.min(np.where(self.norm > 0, need, -np.inf)))

    def add(self, ids: np.ndarray, x: np.ndarray, rotated: np.ndarray, longest: float) -> None:
        live = self.live(longest)
        if not len(live):
            return
        head, rest = rotated[:, :-1].astype(float), rotated[:, -1].astype(float)
        bound = self.head[live] @ head.T + np.outer(self.rest[live], rest)
        slack = SLACK[1] + SLACK[0] * self.norm[live, None] * longest
        may = (bound + slack >= self.least[live, None]) & (self.ids[live, None] != ids)
        columns = np.flatnonzero(may.any(axis=0))
        if not len(columns):
            return
        fits = float(self.norm[live].max()) * longest < 1 << 62
        kind = np.int64 if fits else object  # beyond 64 bits, Python's own integers
        exact = self.q[live].astype(kind) @ x[columns].astype(kind).T
        for row, i in enumerate(live.tolist()):
            hit = np.flatnonzero(may[row, columns])
            if fits and len(hit) > self.k:
                own = exact[row, hit]
                least = np.partition(own, len(own) - self.k)[len(own) - self.k]
                hit = hit[own >= least]
            best = sorted([(-s, f) for s, f in zip(self.score[i], self.found[i].tolist(), strict=True) if s is not None] + list(zip((-exact[row, hit]).tolist(), ids[columns[hit]].tolist(), strict=True)))[: self.k]
            self.score[i, : len(best)] = [-s for s, _ in best]
            self.found[i, : len(best)] = [f for _, f in best]
            if len(best) == self.k:
                self.least[i] = float(-best[-1][0])

    def result(self) -> pa.RecordBatch:
        rows = [(q, v, f, s) for q, v, fs, ss in zip(self.ids.tolist(), self.variants.tolist(), self.found.tolist(), self.score.tolist(), strict=True) for f, s in zip(fs, ss, strict=True) if s is not None]
        q, v, f, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        low, high = -(1 << 63), (1 << 63) - 1
        cols = [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(f, pa.int64()), pa.array([min(max(x, low), high) for x in s], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([str(x) if not low <= x <= high else None for x in s], pa.string())], [c.split()[0] for c in FOUND.split(", ")])


def unpacked(ids: bytes, body: bytes, rotated: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8").reshape(-1, 2)
    return ids, np.frombuffer(body, kind).reshape(len(ids), -1).astype(np.int64), np.frombuffer(rotated, "<f4").reshape(len(ids), -1)


def reaching(queries: DataFrame, candidates: DataFrame, seeds, axes, kind: str, k: int) -> DataFrame:
    """q (number of the query block), c (number of the candidate block): the pairs that can matter. The blocks' lengths and
    what the query blocks need are one row for each block; sorted together, a running count gives each query block how
    many of the longest blocks it has to see."""

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for own in zip(*(b.column(c).to_pylist() for c in ("ids", "body", "rotated")), strict=True):
                ids, q, _ = unpacked(*own, kind)
                search = Search(ids, q, axes.value, k)
                for longest, *block in seeds.value:
                    other, x, rotated = unpacked(*block, kind)
                    search.add(other[:, 0], x, rotated, longest)
                made.append(search.reach())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(made, pa.float64())], ["block", "reach"])

    wanted = queries.select("block", "ids", "body", "rotated").mapInArrow(need, "block long, reach double")
    both = candidates.select(F.lit(None).cast("long").alias("block"), F.col("longest").alias("at")).union(wanted.select("block", "reach"))
    before = Window.orderBy(F.col("at").desc(), F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each block
    seen = both.withColumn("n", F.count_if(F.col("block").isNull()).over(before)).where("block is not null and n > 0")
    return seen.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("c"))


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, variant."""
    spark = vectors.sparkSession
    rows = common.materialize(integers(vectors).withColumn("variant", F.lit(0).cast("long")), "vectors")
    size_of = rows.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    width = size_of["width"] or 1
    kind = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if (size_of["most"] or 0) < 1 << (bits - 1))
    axes = spark.sparkContext.broadcast(rotation(rows, width))  # width * width numbers
    order = [F.col("norm").desc(), F.col("vec_id")]
    numbered = lambda df: df.withColumn("n", F.row_number().over(Window.orderBy("block")).cast("long") - 1)
    candidates = common.materialize(blocks(rows, width, order, size, kind, axes), "candidates")
    variant = (F.row_number().over(Window.partitionBy("vec_id").orderBy("x")) - 1).cast("long")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]).withColumn("variant", variant)
    queries = common.materialize(blocks(asked, width, [F.col("vec_id"), F.col("variant")], size, kind, axes), "queries")
    numbers = numbered(candidates.select("block"))  # a row for each block
    first = candidates.join(numbers.where("n = 0"), "block").select("longest", "ids", "body", "rotated").collect()  # one block
    seeds = spark.sparkContext.broadcast([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in first])
    pairs = common.materialize(reaching(queries, candidates, seeds, axes, kind, k), "block-pairs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(queries.count() * SHARES, 4096))
    sent = pairs.join(numbers.select(F.col("n").alias("c"), "block"), "c").join(candidates, "block")
    share = F.pmod(F.xxhash64("block"), F.lit(SHARES)).cast("int")
    sent = sent.select("q", share.alias("share"), F.lit(False).alias("own"), "block", "longest", "ids", "body", "rotated")
    own = queries.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.lit(True).alias("own"), "block", "longest", "ids", "body", "rotated")
    ordered = own.unionByName(sent).repartition(parts, "q", "share").sortWithinPartitions("q", "share", F.col("own").desc(), F.col("longest").desc(), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for b in batches:
            for is_query, longest, *block in zip(*(b.column(c).to_pylist() for c in ("own", "longest", "ids", "body", "rotated")), strict=True):
                ids, x, rotated = unpacked(*block, kind)
                if is_query:
                    if search is not None:
                        yield search.result()
                    search = Search(ids, x, axes.value, k)
                else:
                    search.add(ids[:, 0], x, rotated, longest)
        if search is not None:
            yield search.result()

    found = ordered.select("own", "longest", "ids", "body", "rotated").mapInArrow(run, FOUND)
    beyond = F.coalesce(F.col("exact"), F.col("score").cast("string")).cast("decimal(38,0)")
    best = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), beyond.desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "variant")


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE) FOR c IN embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score, CAST(0 AS BIGINT) AS variant FROM r WHERE rank <= 20
"""
