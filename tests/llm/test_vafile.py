"""Centroid clustering against Lloyd's rounds in plain integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.llm import vafile

KIND = "vec_id long, embedding array<double>, row string, cells string, x string"


def lloyd(rows, k, rounds, width, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, x in starts]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    total, each = sum(d for _, d, _ in found), collections.Counter()
    for _, d, j in found:
        each[j] += d
    cut = lambda v: min(v, (1 << 63) - 1)
    return collections.Counter((i, j, cut(d), cut(each[j]), cut(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def clustered(spark, rows, **how):
    out = vafile.clusters(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], KIND).repartition(3), **how)
    return collections.Counter(tuple(r)[:6] for r in out.collect()), out


@pytest.mark.parametrize("k", [1, 5])
def test_same_clusters_as_plain_rounds(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 3, 0.6) for _ in range(6)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, [0.5] * 6), (None, [0.1] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5), (204, [float("nan")] + [1.0] * 5), (205, [float("inf")] + [1.0] * 5)]
    got, _ = clustered(spark, rows, k=k, rounds=4, width=6)
    assert got == lloyd(rows, k, 4, 6)


def test_ties_few_vectors_and_none(spark):
    square = [(i, [float(i & 1), float(i >> 1 & 1)]) for i in range(4)] * 3
    assert clustered(spark, square, k=3, rounds=3, width=2)[0] == lloyd(square, 3, 3, 2)
    assert clustered(spark, square[:2], k=8, rounds=2, width=2)[0] == lloyd(square[:2], 8, 2, 2)
    assert not clustered(spark, [(1, None), (2, [1.0])], k=3, rounds=2, width=2)[0]
    nameless = clustered(spark, [(None, [1.0, 2.0]), (None, [3.0, 4.0])], k=1, rounds=2, width=2)[0]
    assert sum(nameless.values()) == 2


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.uniform(10, 40) for _ in range(3)]) for i in range(60)]
    assert clustered(spark, rows, k=4, rounds=3, width=3)[0] == lloyd(rows, 4, 3, 3)


def test_intervals_hold_every_distance_and_prove_only_what_is_so():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 130, (3000, 64))).astype(np.int64)
    x[:, 0] = 7  # a component without spread
    c = x[:5] // 2
    cells = vafile.Cells([(int(v.min()), int(v.max()), float(v.mean()), float(v.std())) for v in x.T])
    coded = cells.encode(x)
    assert (np.take_along_axis(cells.low.T, coded, 0) <= x).all() and (x <= np.take_along_axis(cells.high.T, coded, 0)).all()
    low, high = (np.stack([t[j][np.arange(64), coded].sum(axis=1) for j in range(5)], 1) for t in cells.intervals(c))
    exact = vafile.distances(x, c, np.int64)
    middle = ((x - c.sum(axis=0) // 5) ** 2).sum(axis=1)[:, None]
    assert (low <= exact - middle).all() and (exact - middle <= high).all()
    best, sure = cells.judge(coded, cells.intervals(c))
    assert (best == exact.argmin(axis=1))[sure].all()
    assert 0.5 < sure.mean() < 1


def test_most_vectors_are_not_fetched_again(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4 == j % 4) for j in range(16)]) for i in range(2000)]
    out = clustered(spark, rows, k=4, rounds=5, width=16)[1]
    assert out.select(F.max("fetched")).first()[0] < 5 * 2000 * 0.5
