"""Centroid clustering against plain distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.errors import PySparkException

from lintlake.llm import op13_centroids as op13

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, dims, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    placed = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in placed)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(e for _, e, m in placed if m == n), total, name[n]) for i, d, n in placed), key=repr)


def found(spark, rows, **options):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    table = table.withColumns({c: F.lit(f"extra {c}") for c in ("e", "cluster", "distance", "key", "inertia", "n", "x")})
    made = op13.cluster(table, **options)
    return sorted((tuple(r) for r in made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


DRAW = np.random.default_rng(3)
CLOUD = [(i, (DRAW.normal(size=8) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(400)]
NAN, INF = float("nan"), float("inf")
BAD = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [1.0] * 7 + [None]), (905, [1.0] * 7 + [NAN]), (906, [-INF] + [1.0] * 7)]
COPIES = [(7, [0.5] * 8)] * 50 + [(None, [0.5] * 8), (None, [-0.25] * 8), (8, [0.0] * 8), (8, [-0.001] * 8)]


@pytest.mark.parametrize("rows", [CLOUD, CLOUD + BAD + COPIES, COPIES, BAD, [], CLOUD[:3]])
@pytest.mark.parametrize("k", [16, 3])
def test_cluster(spark, rows, k):
    assert found(spark, rows, dims=8, k=k) == brute(rows, 8, k, 3)


def test_refused(spark):
    with pytest.raises(PySparkException, match="units or more"):
        found(spark, [(1, [3e6] * 8)], dims=8)


def vectors(n):
    return arrays(np.int64, (n, 4), elements=st.integers(-3, 3))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20).flatmap(vectors), st.integers(1, 9).flatmap(vectors))
def test_threshold_algorithm(x, centroids):
    """The nearest centroid, the smaller number of equally near ones."""
    number, distance = op13.nearest(x, centroids)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert number.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == every.min(axis=1).tolist()


def test_walk_stops_early():
    """Centroids far off in every dimension are never measured."""
    centroids = np.array([[0] * 4, [1] * 4, [1000] * 4, [2000] * 4])
    number, distance = op13.nearest(np.zeros((3, 4), np.int64), centroids)
    assert number.tolist() == [0] * 3 and distance.tolist() == [0] * 3
