"""Forests of a search: like Spark ML's trees, the same alone, in parts and together, and in few jobs."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lintlake.operators import forests, training

UNIT_WEIGHTS, SKEWED = [1.0, 1.0], [2.5, 0.7]


def made_rows(spark, coarse: int):
    """Three noisy features and one that never changes, dealt to four partitions."""
    made = []
    for i in range(360):
        a, b, c = float(i * 37 % 101 // coarse), float(i * 53 % 89 // coarse), float(i * 7 % 5)
        made.append((f"r{i}", Vectors.dense([a, b, c, 4.0]), float((coarse * (a + b) > 80) != (i % 9 == 0)), i % 3))
    made = spark.createDataFrame(made, ["id", "features", "target", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    return made.repartition(4, "id").sortWithinPartitions("id").persist()


@pytest.fixture(scope="module")
def rows(spark):
    return made_rows(spark, 1)


def f1(rows, settings, **kwargs):
    return forests.fold_f1(rows, training._scaler(), settings, 3, 7, **kwargs)


@pytest.mark.parametrize("coarse, weights", [(1, UNIT_WEIGHTS), (4, SKEWED)])
def test_a_whole_tree_is_spark_mls(spark, coarse, weights):
    rows = made_rows(spark, coarse)
    data = rows.withColumn("w", F.when(F.col("target") == 1, weights[1]).otherwise(weights[0]))
    judge = MulticlassClassificationEvaluator(labelCol="target", metricName="fMeasureByLabel", metricLabel=1.0)
    settings = [(1, 2, 1, weights), (1, 5, 6, weights)]
    for (_, depth, least, _), mine in zip(settings, f1(rows, settings, bagged=False, tried=4)):
        tree = RandomForestClassifier(
            featuresCol="scaled", labelCol="target", weightCol="w", numTrees=1, bootstrap=False,
            featureSubsetStrategy="all", maxDepth=depth, minInstancesPerNode=least,
        )
        for fold in range(3):
            model = Pipeline(stages=[training._scaler(), tree]).fit(data.where(F.col("fold") != fold))
            assert mine[fold] == pytest.approx(judge.evaluate(model.transform(data.where(F.col("fold") == fold))), abs=1e-9)


def test_a_forest_is_the_same_alone_and_in_parts(rows, monkeypatch):
    settings = [(5, 6, 1, UNIT_WEIGHTS), (7, 3, 4, SKEWED), (3, 4, 1, UNIT_WEIGHTS), (6, 6, 9, SKEWED)]
    together = f1(rows, settings)
    assert all(0 < v <= 1 for found in together for v in found)
    assert [f1(rows, [s])[0] for s in settings[1:3]] == together[1:3]
    for name, value in (("UNIT", 1), ("WAVE", 1_500), ("NODES", 2), ("SMALL_BYTES", 0), ("MOST_VALUES", 10_000)):
        monkeypatch.setattr(forests, name, value)
    assert f1(rows, settings) == together


def test_cuts_of_few_and_many_values(rows, monkeypatch):
    values, counts = forests.np.arange(200.0), forests.np.ones(200)
    assert forests.cut_points(values[:5], counts[:5]).tolist() == [0.5, 1.5, 2.5, 3.5]
    cuts = forests.cut_points(values, counts)
    assert len(cuts) == 31 and max(cuts[1:] - cuts[:-1]) <= 8
    # A value with most of the rows does not take the cuts of the others.
    counts[0] = 10_000
    assert len(forests.cut_points(values, counts)) == 31
    x = rows.select(F.array(F.lit(1.0), F.expr("CAST(substr(id, 2) AS double)")).alias("x"))
    exact = forests.all_cuts(x, 2)
    assert len(exact[0]) == 0 and len(exact[1]) == 31
    monkeypatch.setattr(forests, "MOST_VALUES", 5)
    assert abs(forests.all_cuts(x, 2)[1] - exact[1]).max() <= 3


def test_places_of_rows_are_not_left_behind(rows, monkeypatch):
    made, gone = [], []
    folder, remove = forests.shared_dir, forests._removed
    monkeypatch.setattr(forests, "shared_dir", lambda *a: made.append(folder(*a)) or made[-1])
    monkeypatch.setattr(forests, "_removed", lambda spark, path: gone.append(path) or remove(spark, path))
    f1(rows, [(3, 3, 1, UNIT_WEIGHTS)])
    assert len(made) >= 3 and made == gone


def test_more_trials_are_no_more_jobs(spark, rows):
    data, jobs = rows.select("id", "features", "target"), []
    for trials in (2, 8):
        spark.sparkContext.setJobGroup(f"trials-{trials}", "")
        best, found = training.trial_search(data, "rf", trials, overrides={"numTrees": 4, "maxDepth": 3})
        spark.sparkContext.setJobGroup("other", "")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials-{trials}")))
        values = [r.value for r in found.orderBy("trial").collect()]
        assert len(values) == trials and min(values) > 0.5
        assert best.stages[-1].getNumTrees == 4
    assert jobs[1] <= jobs[0] + 10


def test_rows_that_forests_cannot_take_go_the_usual_way(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(training, "_search", lambda *a: asked.append(a[2]))
    training.trial_search(rows.withColumn("target", F.col("target") + 0.5).drop("fold"), "rf", 2)
    training.trial_search(rows.drop("fold"), "rf", 2, overrides={"subsamplingRate": 0.5})
    training.trial_search(rows.drop("fold"), "rf", 2, overrides={"numTrees": 1})
    assert len(asked) == 3
