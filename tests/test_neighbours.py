"""Neighbour search and SMOTE against direct distances, with hot copies and dense cells."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.operators import neighbours, training


def cloud(n=600):
    dice = np.random.default_rng(4)
    dense = dice.normal(0, 0.01, (n // 3, 3))
    wide = dice.normal(0, 5, (n // 3, 3))
    copies = np.tile([[1.0, 2.0, 3.0]], (n - 2 * (n // 3), 1))
    return np.vstack([dense, wide, copies])


def as_rows(spark, points):
    return spark.createDataFrame([(str(i), [float(v) for v in p]) for i, p in enumerate(points)], "id string, x array<double>")


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_one_group_is_exact(spark, shift):
    points = cloud() + shift
    near = neighbours.nearest_neighbours(as_rows(spark, points), 5, group=1000).collect()
    got = {int(r.id): np.array(r.neighbours) for r in near}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        gaps = np.sqrt(((points - p) ** 2).sum(1))
        gaps[i] = np.inf
        assert np.allclose(np.sqrt(((got[i] - p) ** 2).sum(1)), np.sort(gaps)[:5])


def test_small_groups_find_most_neighbours(spark):
    points = np.random.default_rng(1).normal(size=(4000, 3))
    near = neighbours.nearest_neighbours(as_rows(spark, points), 5, group=250).collect()
    found = 0
    for r in near[:400]:
        gaps = np.sqrt(((points - np.array(r.x)) ** 2).sum(1))
        limit = np.sort(gaps)[5] + 1e-12
        found += sum(np.linalg.norm(np.array(y) - np.array(r.x)) <= limit for y in r.neighbours)
    assert found / 2000 > 0.8


def recall(spark, n):
    points = np.random.default_rng(2).normal(size=(n, 14))
    near = neighbours.nearest_neighbours(as_rows(spark, points), 5).limit(400).collect()
    found = 0
    for r in near:
        gaps = np.sqrt(((points - np.array(r.x)) ** 2).sum(1))
        limit = np.sort(gaps)[5] + 1e-12
        found += sum(np.linalg.norm(np.array(y) - np.array(r.x)) <= limit for y in r.neighbours)
    return found / (5 * len(near))


def test_recall_does_not_fall_with_the_rows(spark):
    assert [n for n in (2000, 8000) if recall(spark, n) < 0.88] == []


def test_salted_join(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900 + 10).alias("k"), "id")
    known = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    made = salted_join(rows, known, ["k"], "n")
    assert made.columns == ["k", "id", "most"]
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.join(known.drop("n"), "k").collect()))


def test_groups_stay_small_in_many_dimensions(spark):
    for n in (5000, 20_000):
        points = np.random.default_rng(2).normal(size=(n, 14))
        rows = as_rows(spark, points).select(F.col("id").cast("bigint").alias("row"), "x")
        sizes = [r["count"] for r in neighbours.grouped(rows, tables=3).groupBy("table", "cell", "salt").count().collect()]
        # pairs compared per row: bounded by the group size, whatever the number of rows
        assert sum(s * s for s in sizes) / n < 3 * 1.5 * neighbours.GROUP and max(sizes) < 3 * neighbours.GROUP


def test_one_vector_many_times(spark):
    rows = spark.range(100_000).select(F.col("id").alias("row"), F.array(*[F.lit(0.0)] * 14).alias("x"))
    sizes = [r["count"] for r in neighbours.grouped(rows, tables=3).groupBy("table", "cell", "salt").count().collect()]
    assert max(sizes) < 3 * neighbours.GROUP and sum(sizes) == 300_000


def test_no_points(spark):
    empty = spark.createDataFrame([], "id string, x array<double>")
    assert neighbours.nearest_neighbours(empty, 5).count() == 0
    one = spark.createDataFrame([("a", [1.0])], "id string, x array<double>")
    assert neighbours.nearest_neighbours(one, 5).first().neighbours == []


def test_smote_balances(spark):
    points = cloud(300)
    rows = [(f"m{i}", [float(v) for v in p], 1.0) for i, p in enumerate(points[:60])]
    rows += [(f"n{i}", [float(v) for v in p], 0.0) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id string, x array<double>, target double")
    made = training.smote(df.select("id", array_to_vector("x").alias("features"), "target"))
    counts = {r.target: r["count"] for r in made.groupBy("target").count().collect()}
    assert counts == {0.0: 300, 1.0: 300}
    new = made.where(F.col("id").contains("~")).select(vector_to_array("features").alias("x")).collect()
    low, high = points[:60].min(0), points[:60].max(0)
    assert len(new) == 240 and all((np.array(r.x) >= low - 1e-9).all() and (np.array(r.x) <= high + 1e-9).all() for r in new)
    assert made.select("id").distinct().count() == 600


def test_smote_with_a_hot_id(spark):
    rows = [("same", [float(i % 5), 1.0], 1.0) for i in range(40)] + [(f"n{i}", [float(i), 0.0], 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, x array<double>, target double")
    made = training.smote(df.select("id", array_to_vector("x").alias("features"), "target"))
    counts = {r.target: r["count"] for r in made.groupBy("target").count().collect()}
    assert counts == {0.0: 200, 1.0: 200}
