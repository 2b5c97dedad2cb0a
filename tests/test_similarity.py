"""The similarity join by blocks: the rows of a plain comparison, without comparing all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curvelake.operators import graph


def unit(v):
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def clustered(seed, n, groups=("a", "b", "c"), width=12, noise=0.15):
    rng = random.Random(seed)
    middles = [unit([rng.gauss(0, 1) for _ in range(width)]) for _ in range(40)]
    rows = []
    for i in range(n):
        g = "a" if rng.random() < 0.8 else rng.choice(groups)
        rows.append((g, i, unit([x + rng.gauss(0, noise) for x in rng.choice(middles)])))
    return rows + [("a", n, [0.0] * width), ("a", n + 1, rows[0][2]), ("b", n + 2, rows[0][2]), (None, n + 3, rows[0][2]), (None, n + 4, rows[0][2])]


def dot(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize(("size", "threshold"), [(512, 0.363), (40, 0.9), (7, 0.92)])
def test_pairs_are_those_of_a_plain_comparison(spark, size, threshold):
    rows = clustered(1, 500)
    want = {(g, a, b): dot(v, w) for g, a, v in rows for h, b, w in rows if g is not None and g == h and a < b and dot(v, w) >= threshold}
    out = graph.similar_pairs(spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(3), "g", threshold, size).collect()
    assert {(r.g, r.a, r.b) for r in out} == want.keys() and len(out) == len(want) > 50
    assert all(abs(r.sim - want[r.g, r.a, r.b]) < 1e-9 for r in out)


def test_cells_spare_most_pairs_of_a_large_group(spark):
    rows = [r for r in clustered(2, 3000, noise=0.05) if r[0] == "a"]
    own = graph.blocks(spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(3), "g", 32)
    n = own.select("block", "n")
    assert n.agg(F.sum("n")).first()[0] == len(rows) and n.agg(F.max("n")).first()[0] <= 32
    pairs = graph.block_pairs(own, own, 0.95, True)
    met = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").select(F.sum(F.col("na") * F.col("nb"))).first()[0]
    assert met < 0.25 * len(rows) ** 2 / 2


@pytest.mark.parametrize("size", [512, 9])
def test_new_people_are_those_without_an_old_face(spark, size):
    rows = clustered(3, 400)
    new, old = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    kind = "g string, id long, v array<double>"
    want = sorted((i for g, i, v in new if not any(g is not None and g == h and dot(v, w) >= 0.9 for h, _, w in old)), key=str)
    out = graph.new_people(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind), "g", 0.9, size).collect()
    assert sorted((r.id for r in out), key=str) == want and 0 < len(want) < len(new)
    empty = spark.createDataFrame([], kind)
    assert graph.new_people(spark.createDataFrame(new, kind), empty, "g").count() == len(new)
    assert graph.similar_pairs(empty, "g").count() == 0
