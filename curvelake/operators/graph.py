"""Embeddings: similarity, components, prototypes and matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from curvelake import scratch
from curvelake.functions.scalars import cosine, unit

#: Cosine from which two faces count as one person, and the bands of a match.
SAME, OK, REVIEW = 0.363, 0.55, 0.28
#: Vectors in a block, vectors that share a copy of the pivots, parts in which block pairs are found, and blocks in a bundle.
BLOCK, SHARE, SALTS, TILE = 512, 8192, 8, 32


def blocks(vectors: DataFrame, group: str, size: int = BLOCK) -> DataFrame:
    """block, group, n, ids, body, centre, radius: each group's vectors in blocks of ``size`` at most, of vectors that lie close
    together. A group with more than that is cut into cells around some of its own vectors (two for a block, but no more than four times the root of
    their number), a cell is cut by the distance from its pivot; no task needs a whole group. Rows without a group are left out."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), "id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n_"))
    rows = rows.join(sizes, "g").withColumn("salts_", F.floor(F.col("n_") / SHARE) + 1)
    spread = rows.select("g", "id", "v", F.pmod(F.xxhash64("id"), "salts_").alias("salt_"), F.lit(True).alias("own_"))
    cells = F.least(F.col("n_") * 2 / size, F.sqrt("n_") * 4)
    pivots = rows.where((F.col("n_") > size) & (F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n_") / cells))) == 0))
    pivots = pivots.select("g", "id", "v", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1)).alias("salt_"), F.lit(False).alias("own_"))
    sorted_ = spread.union(pivots).withColumn("k_", F.xxhash64("g", "salt_")).repartition(parts, "k_").sortWithinPartitions("k_", "own_")
    kinds = {f.name: f.dataType for f in rows.schema}
    held = [StructField("g", kinds["g"]), StructField("id", kinds["id"]), StructField("v", kinds["v"])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near = None, []
        for b in batches:
            keys, own = b.column("k_").to_numpy(), b.column("own_").to_numpy(zero_copy_only=False)
            v, cell, far = matrix(b.column("v")), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if b.num_rows else []
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if keys[i] != key:
                    key, near = keys[i], []
                if not own[i]:
                    near.append(v[i:j])
                elif near:
                    at = apart(v[i:j], np.concatenate(near))
                    cell[i:j], far[i:j] = at.argmin(axis=1), at.min(axis=1)
            mine = pa.array(own)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(mine) for c in ("g", "id", "v")), pa.array(cell[own]), pa.array(far[own])], ["g", "id", "v", "cell", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            made, v = [], matrix(b.column("v"))
            keys, ids, groups = b.column("k_").to_numpy(), b.column("id").to_pylist(), b.column("g").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if b.num_rows else []
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                for at in range(i, j, size):
                    own = v[at : min(at + size, j)]
                    centre = own.mean(axis=0)
                    made.append((part << 32 | n, groups[at], len(own), ids[at : at + len(own)], own.tobytes(), centre.tolist(), float(apart(own, centre[None]).max())))
                    n += 1
            cols = list(zip(*made, strict=True)) or [()] * 7
            types = [pa.int64(), b.schema.field("g").type, pa.int64(), pa.list_(b.schema.field("id").type), pa.binary(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "g", "n", "ids", "body", "centre", "radius"])

    cells = sorted_.mapInArrow(placed, StructType([*held, StructField("cell", IntegerType()), StructField("far", DoubleType())]))
    order = ["k_", "far"]
    cells = cells.withColumn("k_", F.xxhash64("g", "cell")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = StructType([StructField("block", LongType()), StructField("g", kinds["g"]), StructField("n", LongType()), StructField("ids", ArrayType(kinds["id"])), StructField("body", BinaryType()), StructField("centre", ArrayType(DoubleType())), StructField("radius", DoubleType())])
    return scratch.materialize(cells.mapInArrow(cut, out), "blocks")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each row of x from each row of y."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def block_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool) -> DataFrame:
    """a, b: the blocks of one group that may hold a pair of unit vectors with a cosine of ``threshold``: by the triangle inequality, no vector of
    one is nearer to one of the other than their centres, less both radii. ``same``: both sides are one list, each pair once."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    one = left.select("g", F.col("block").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("s_"))
    two = right.select("g", F.col("block").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s_"))
    gap = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = one.join(two, ["g", "s_"])
    return (met.where("a <= b") if same else met).where(gap - F.col("ra") - F.col("rb") <= reach).select("a", "b")


def tiled(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """g, ta, tb, a, b: block pairs with the square that they lie in, by the bundles of about TILE blocks that a group's blocks are dealt to."""

    def bundles(own: DataFrame, x: str) -> DataFrame:
        sizes = own.groupBy("g").agg(F.count("*").alias("n_"))
        return own.select("g", "block").join(sizes, "g").select("g", F.col("block").alias(x), F.pmod(F.xxhash64("block"), F.ceil(F.col("n_") / TILE)).alias("t" + x))

    met = pairs.join(bundles(left, "a"), "a").join(bundles(right, "b").drop("g"), "b")
    over = (F.col("ta") > F.col("tb")) if left is right else F.lit(False)  # of one list, a square and its mirror image are the same
    turned = [F.when(over, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ta", "tb"), ("tb", "ta"), ("a", "b"), ("b", "a"))]
    return scratch.materialize(met.select("g", *turned), "tiles")


def block_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, hits_only: bool) -> DataFrame:
    """g, a, b, sim of the vectors in ``pairs`` of blocks at or above the threshold; with ``hits_only`` g and a of those that have any. A block is
    sent once to each square of block pairs that needs it, not once for each pair; a task holds the blocks of one square."""
    kind, parts = left.schema["ids"].dataType.elementType, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [StructField("g", left.schema["g"].dataType), StructField("a", kind)] + ([] if hits_only else [StructField("b", kind), StructField("sim", DoubleType())])
    other = int(left is not right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, held = None, {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("g", "ta", "tb", "side", "a", "b")), strict=True)
            for k, (g, ta, tb, side, a, b) in enumerate(keys):
                if (g, ta, tb) != square:
                    square, held = (g, ta, tb), {}
                if side < 2:
                    ids = batch.column("ids")[k].values
                    held[side, a] = ids.take(pa.array(range(len(ids)))), np.frombuffer(batch.column("body")[k].as_buffer()).reshape(len(ids), -1).copy()
                    continue
                (ia, x), (ib, y) = held[0, a], held[other, b]
                sim = x @ y.T
                hit = sim >= threshold
                if hits_only:
                    i = np.flatnonzero(hit.any(axis=1))
                    cols = [ia.take(pa.array(i))]
                else:
                    if not other and a == b:
                        hit = np.triu(hit, 1)
                    i, j = np.nonzero(hit)
                    cols = [ia.take(pa.array(i)), ib.take(pa.array(j)), pa.array(sim[i, j])]
                yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(np.full(len(i), k))), *cols], [f.name for f in fields])

    met = tiled(pairs, left, right)
    body = lambda df, side: df.select(F.lit(side).alias("side"), F.col("block").alias("a"), "ids", "body")
    need = lambda x, side: met.select("g", "ta", "tb", F.lit(side).alias("side"), F.col(x).alias("a"))
    bodies = body(left, 0).union(body(right, 1)) if other else body(left, 0)
    sent = need("a", 0).union(need("b", other)).distinct().join(bodies, ["side", "a"]).withColumn("b", F.lit(None).cast("long"))
    asked = met.withColumns({"side": F.lit(2), "ids": F.lit(None).cast(left.schema["ids"].dataType), "body": F.lit(None).cast("binary")})
    columns = ["g", "ta", "tb", "side", "a", "b", "ids", "body"]
    rows = sent.select(*columns).union(asked.select(*columns)).repartition(parts, "g", "ta", "tb")
    return rows.sortWithinPartitions("g", "ta", "tb", "side").mapInArrow(run, StructType(fields))


def similar_pairs(vectors: DataFrame, group: str, threshold: float = SAME, size: int = BLOCK) -> DataFrame:
    """group, a, b (a < b), sim: pairs inside a group at or above the threshold. A group is the blocking key: pairs of
    different groups never meet. ``vectors``: group, id, v (unit length, all of one length)."""
    own = blocks(vectors, group, size)
    found = block_matches(block_pairs(own, own, threshold, True), own, own, threshold, False).where("a <> b")
    return found.select(F.col("g").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def components(vertices: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, id, component (its smallest id): labels take their neighbours' least, then their label's label, until still.
    ``vertices``: key, id; ``edges``: key, a, b."""
    spark, path = vertices.sparkSession, scratch.folder(vertices.sparkSession, "components")
    both = scratch.write(edges.select(*key, "a", "b").union(edges.select(*key, F.col("b"), F.col("a"))), f"{path}/edges")
    labels, turn = vertices.select(*key, "id", F.col("id").alias("label_")), 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("id")).agg(F.min("label_").alias("near_"))
        new = labels.join(near, [*key, "id"], "left").select(*key, "id", F.least("label_", F.coalesce("near_", "label_")).alias("low_"), F.col("label_").alias("old_"))
        jump = new.select(*key, F.col("id").alias("low_"), F.col("low_").alias("to_"))
        new = scratch.write(new.join(jump, [*key, "low_"], "left").select(*key, "id", F.least("low_", F.coalesce("to_", "low_")).alias("label_"), "old_"), f"{path}/{turn}")
        scratch.discard(spark, f"{path}/{turn - 1}")  # the labels before these
        if not new.where("label_ <> old_").limit(1).count():
            scratch.discard(spark, f"{path}/edges")
            return new.select(*key, "id", F.col("label_").alias("component"))
        labels, turn = new.drop("old_"), turn + 1


def largest_component(parts: DataFrame, key: list[str]) -> DataFrame:
    """key, id of each group's largest component; at equal sizes the one with the smallest id."""
    sizes = parts.groupBy(*key, "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*key).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"), F.max("n").alias("n"))
    return parts.join(best, [*key, "component"])


def prototypes(members: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, n, prototype: the unit mean of a group's vectors, for groups of ``least`` at least. ``members``: key, id, v."""
    cells = members.select(*key, F.posexplode("v").alias("i", "x")).groupBy(*key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    mean = cells.groupBy(*key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("m"))
    return mean.where(F.col("n") >= least).select(*key, "n", unit(F.col("m")).alias("prototype"))


def best_match(candidates: DataFrame, gallery: DataFrame, group: list[str], name: str) -> DataFrame:
    """group, id, sim (3 digits), status: each group's candidate with the highest (similarity, quality) against the
    prototype of its name. ``candidates``: group, name, id, quality, v; ``gallery``: name, prototype."""
    rows = candidates.join(gallery, name).withColumn("sim", F.round(cosine(F.col("v"), F.col("prototype")), 3))
    best = rows.groupBy(*group).agg(F.max(F.struct("sim", "quality", -F.col("id"))).alias("b"))
    status = F.when(F.col("b.sim") >= OK, "ok").when(F.col("b.sim") >= REVIEW, "needs_review").otherwise("deferred")
    return best.select(*group, (-F.col("b.col3")).alias("id"), F.col("b.sim").alias("sim"), status.alias("status"))


def second_pass(rows: DataFrame, key: str, least: int) -> DataFrame:
    """key, id, sim: to the reference, or to the unit mean of the group's anchors if that is larger and there are ``least``
    anchors, rows whose similarity to the reference is SAME or more. ``rows``: key, id, v, ref."""
    seen = rows.withColumn("own_", cosine(F.col("v"), F.col("ref")))
    template = prototypes(seen.where(F.col("own_") >= SAME).select(key, "id", "v"), [key], least).select(key, "prototype")
    both = seen.join(template, key, "left")
    return both.select(key, "id", F.greatest("own_", F.when(F.col("prototype").isNotNull(), cosine(F.col("v"), F.col("prototype")))).alias("sim"))


def new_people(new: DataFrame, old: DataFrame, group: str, threshold: float = SAME, size: int = BLOCK) -> DataFrame:
    """group, id of those without an old vector at or above the threshold in their group. Both: group, id, v (unit length, all of one length)."""
    ours, known = blocks(new, group, size), blocks(old, group, size)
    seen = block_matches(block_pairs(ours, known, threshold, False), ours, known, threshold, True).distinct()
    return new.select(group, "id").join(seen.select(F.col("g").alias(group), F.col("a").alias("id")), [group, "id"], "left_anti")


def merge_verdicts(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, status, note: a reviewed match takes its verdict; yes confirms, no rejects, anything else stays open."""
    rows = matches.join(verdicts, "id", "left")
    v = F.col("verdict")
    status = F.when(v.isNull(), F.col("status")).when(v == "yes", "ok").when(v == "no", "rejected").otherwise("needs_review")
    note = F.when(v.isin("yes", "no"), F.concat(F.lit("verified:"), v)).when(v.isNotNull(), F.lit("verified:unsure"))
    return rows.select("id", status.alias("status"), note.alias("note"))
