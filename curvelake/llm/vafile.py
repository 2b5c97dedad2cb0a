"""Centroid clustering (Lloyd's rounds, exact in integers) over a VA-file: vectors compressed to few-bit cells.

1. Every component is cut into ``2**BITS`` cells, whose bounds follow the component's spread over all vectors. The cells,
   ``width`` bytes a vector, are one table; the whole vectors are another, bucketed by row, so that a join by row never
   moves them.
2. In each round tasks look at the cells only. Tables with an entry for each centroid, component and cell give the
   interval in which a vector's distance to the centroid lies. What all centroids have in common, the distance to
   their middle, is left out of the intervals: it decides nothing and would only widen them.
3. A vector is settled if one interval ends below where all others begin. The rest are fetched, and so are those that
   change their cluster, whose components have to move from one sum to the other; the others never leave the file. The first
   round takes every vector into a sum, and so goes through the vectors themselves.
4. Sums and counts of the clusters, ``k * width`` numbers, are all that the driver holds.

Vectors that don't have ``width`` components, or hold a null or non-finite one, take no part. Components beyond 2**57 are
cut off there; distances and inertias beyond 64 bits are returned as the largest. Repeated rows and ids are vectors of their own;
a vector with a null id is clustered but is no start. Equal hashes start in the order of their components. With
fewer than ``k`` vectors there are fewer centroids; no vectors, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from curvelake.llm import common

#: Bits of a cell. With 4 all but a few vectors have to be fetched, with 8 one in seven (measured on 64 components).
BITS = 8
#: Below this, squared distances fit 64 bits; beyond, Python's own integers are used.
NARROW = 1 << 26
STATE = "row long, cells binary, was int, now int"
LONGEST = (1 << 63) - 1


def integers(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """row, vec_id, x: valid vectors in integers."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.size("embedding") == width) & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = float(1 << 57)
    x = F.transform(wide, lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * scale))))
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


class Cells:
    """The cells of each component: ``low`` and ``high`` (component, cell), whole numbers, both included."""

    def __init__(self, spread: list[tuple[int, int, float, float]]) -> None:
        low, high = [], []
        # for cells as narrow as can be where most values lie, density to the power of a third: a wider normal's quantiles
        steps = [NormalDist(0, 3**0.5).inv_cdf(i / (1 << BITS)) for i in range(1, 1 << BITS)]
        for least, most, mean, deviation in spread:
            cuts = [min(max(int(mean + s * deviation), least), most) for s in steps]
            low.append([least, *cuts])
            high.append([*(max(c - 1, a) for a, c in zip([least, *cuts], cuts, strict=False)), most])
        self.kind = np.int64 if max([0, *(max(-a, b) for a, b, _, _ in spread)]) < NARROW else object
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.size = 1 << BITS

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.low[d, 1:], x[:, d], "right") for d in range(x.shape[1])], 1).astype(np.uint8)

    def intervals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest part (centroid, component, cell) in the distance less that to the centroids' middle."""
        c = centroids.astype(self.kind)
        middle = c.sum(axis=0) // len(c)
        slope = (middle - c)[:, :, None]
        at = lambda v: slope * (2 * v.astype(self.kind)[None] - (middle + c)[:, :, None])  # noqa: E731  (v - c)**2 - (v - middle)**2
        one, other = at(self.low), at(self.high)
        return np.minimum(one, other), np.maximum(one, other)

    def judge(self, cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The centroid with the least upper bound, and whether the intervals prove that it is the nearest."""
        where = cells + np.arange(cells.shape[1]) * self.size
        least, most = (np.stack([t[j].ravel()[where].sum(axis=1) for j in range(len(t))], 1) for t in tables)
        best = most.argmin(axis=1)
        bound = most[np.arange(len(best)), best][:, None]
        number = np.arange(least.shape[1])
        apart = (least > bound) | ((least == bound) & (number > best[:, None])) | (number == best[:, None])
        return best.astype(np.int32), apart.all(axis=1)


def distances(x: np.ndarray, centroids: np.ndarray, kind: type) -> np.ndarray:
    """Squared distance of each vector to each centroid."""
    x, c = x.astype(kind), centroids.astype(kind)
    return np.stack([((x - c[j]) ** 2).sum(axis=1) for j in range(len(c))], 1)


def spread(rows: DataFrame, width: int) -> list[tuple[int, int, float, float]]:
    """Least, greatest, mean and deviation of each component: ``width`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            if len(x):
                f = x.astype(float)
                cols = [np.arange(width), x.min(axis=0), x.max(axis=0), f.sum(axis=0), (f * f).sum(axis=0), np.full(width, len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "a", "b", "s", "q", "n"])

    parts = rows.select("x").mapInArrow(run, "i long, a long, b long, s double, q double, n long")
    found = parts.groupBy("i").agg(F.min("a"), F.max("b"), F.sum("s") / F.sum("n"), F.sum("q") / F.sum("n")).orderBy("i").collect()
    return [(a, b, mean, max(square - mean * mean, 0.0) ** 0.5) for _, a, b, mean, square in found]


def moves(fetched: DataFrame, k: int, width: int) -> list:
    """(cluster, component, what its sum gains, what its count gains): at most ``k * width`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = {}
        for b in batches:
            x, was, now = matrix(b.column("x"), width), b.column("was").to_numpy(), b.column("now").to_numpy()
            for j in range(k):
                come, go = now == j, was == j
                own = gains.setdefault(j, [[0] * width, 0])
                gained = [int(v) for v in x[come].astype(object).sum(axis=0) - x[go].astype(object).sum(axis=0)] if x.size and np.abs(x).max() >= 1 << 40 else (x[come].sum(axis=0) - x[go].sum(axis=0)).tolist()
                own[0] = [a + b for a, b in zip(own[0], gained, strict=True)] if come.any() or go.any() else own[0]
                own[1] += int(come.sum() - go.sum())
        made = [(j, i, str(s), n) for j, (sums, n) in gains.items() for i, s in enumerate(sums)]
        cols = list(zip(*made, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["j", "i", "s", "n"])

    parts = fetched.select("was", "now", "x").where("was <> now").mapInArrow(run, "j int, i int, s string, n long")
    return parts.groupBy("j", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, fetched (vectors read again, over all rounds)."""
    spark = vectors.sparkSession
    name, buckets = f"vectors_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = common.scratch(spark, "vectors")
    integers(vectors, width, scale).repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("path", path).saveAsTable(name)
    try:
        with common.passing(spark):
            return cluster_table(spark.table(name), k, rounds, width, seed)
    finally:
        spark.sql(f"DROP TABLE {name}")
        common.discard(spark, path)


def cluster_table(full: DataFrame, k: int, rounds: int, width: int, seed: str) -> DataFrame:
    spark = full.sparkSession
    by_hash = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = full.where("vec_id is not null").select(by_hash.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not starts:
        starts = full.select(F.lit("").alias("h"), "x").orderBy("x").limit(k).collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(-1, width)
    cells = Cells(spread(full, width))
    sums, counts, read = [[0] * width for _ in starts], [0] * len(starts), 0

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            now = distances(x, centroids, cells.kind).argmin(axis=1).astype(np.int32)
            coded = pa.array([c.tobytes() for c in cells.encode(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), coded, pa.array(np.full(len(x), -1, np.int32)), pa.array(now), b.column("x")], ["row", "cells", "was", "now", "x"])

    def looked(centroids: np.ndarray):
        tables = cells.intervals(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(-1, width)
                now, sure = cells.judge(own, tables)
                need = ~sure | (now != b.column("now").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("now"), pa.array(now), pa.array(need)], ["row", "cells", "was", "now", "need"])

        return run

    def settled(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                now = distances(matrix(b.column("x"), width), centroids, cells.kind).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("was"), pa.array(now), b.column("x")], ["row", "cells", "was", "now", "x"])

        return run

    wide = f"{STATE}, x array<long>"
    folder = common.scratch(spark, "rounds")
    fetched = common.write(full.select("row", "x").mapInArrow(first, wide), f"{folder}/0/fetched") if starts else None
    state = fetched
    for turn in range(1, rounds + 1 if starts else 1):
        for r in moves(fetched, len(starts), width):
            sums[r.j][r.i] += int(r.s)
            counts[r.j] = counts[r.j] + r.n if r.i == 0 else counts[r.j]
        centroids = np.array([[s // n for s in own] if n else old.tolist() for own, n, old in zip(sums, counts, centroids, strict=True)], np.int64)
        judged = common.write(state.select("row", "cells", "now").mapInArrow(looked(centroids), f"{STATE}, need boolean"), f"{folder}/{turn}/judged")
        wanted = judged.where("need").select("row", "cells", "was")
        seen = Observation()
        again = wanted.join(full.select("row", "x"), "row").mapInArrow(settled(centroids), wide)
        fetched = common.write(again.observe(seen, F.count(F.lit(1)).alias("n")), f"{folder}/{turn}/fetched")
        common.discard(spark, f"{folder}/{turn - 1}")
        read += seen.get["n"]
        state = judged.where("not need").select("row", "cells", "now").union(fetched.select("row", "cells", "now"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = matrix(b.column("x"), width), b.column("cluster").to_numpy()
            d = ((x.astype(cells.kind) - centroids.astype(cells.kind)[own]) ** 2).sum(axis=1)
            short = pa.array([min(int(v), LONGEST) for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), short, pa.array([str(v) for v in d], pa.string())], ["vec_id", "cluster", "distance", "exact"])

    kinds = "vec_id long, cluster int, distance long, exact string"
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, fetched long")
    last = state.select("row", F.col("now").alias("cluster")).join(full, "row").select("vec_id", "x", "cluster")
    rows = common.materialize(last.mapInArrow(measured, kinds), "clustered", keep=True)
    common.discard(spark, folder)
    totals = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    of: list[Column] = [
        F.array(*(F.lit(v) for v in own))[F.col("cluster")]
        for own in (
            [min(totals.get(j, 0), LONGEST) for j in range(len(starts))],
            [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()],
        )
    ]
    inertia = F.lit(min(sum(totals.values()), LONGEST)).cast("long")
    return rows.select("vec_id", "cluster", "distance", of[0].cast("long").alias("cluster_inertia"), inertia.alias("inertia"), of[1].alias("centroid_sha256"), F.lit(read).cast("long").alias("fetched"))


def oracle(k: int = 8, rounds: int = 10, seed: str = "3:") -> str:
    """SQL for DuckDB, without ``fetched``: the rounds one after the other."""
    near = "SELECT v.*, c.j, v.xx - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, j) = 1"
    parts = [
        """v AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT row_number() OVER () AS rn, vec_id, [floor(1024 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), x) - 1 AS j, x FROM v WHERE vec_id IS NOT NULL QUALIFY j < {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"m{r} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, floor(sum(e) / count(*)) AS m FROM (SELECT j, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i) GROUP BY j)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)")
    parts.append(f"a AS MATERIALIZED ({near.format(r=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) FOR e IN c.x], ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.j = a.j"""
