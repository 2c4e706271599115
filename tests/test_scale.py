"""Work that grows with the table in more tasks, not in longer ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.sources import corpus


def test_tasks_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_FILES", 10)
    cores = spark.sparkContext.defaultParallelism
    rows = 10 * (cores + 3)
    # As many partitions as cores, all rows in one of them: so row groups may lie.
    orders = spark.range(rows).select(
        F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.col("id").alias("o_custkey")
    ).repartition(cores, F.lit(1))
    made = corpus.templated_corpus(orders)
    assert made.rdd.getNumPartitions() == cores + 3
    assert max(made.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < rows / 2
    assert made.select("file_id").distinct().count() == rows


def test_a_search_has_the_tasks_that_its_rows_ask_for(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from lintlake.operators import training

    seen = []

    class Watched(training.CrossValidator):
        def fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), self.getParallelism(), dataset.count()))
            return super().fit(dataset)

    monkeypatch.setattr(training, "CrossValidator", Watched)
    rows = [(f"r{i}", Vectors.dense([float(i % 7), float(i % 2)]), float(i % 2)) for i in range(120)]
    data = spark.createDataFrame(rows, ["id", "features", "target"]).repartition(8)
    grid = {"numTrees": [2, 3], "maxDepth": [2]}
    best, trials = training.grid_search(data, "rf", grid, folds=2, parallelism=8)
    assert trials.count() == 2 and best.stages[-1].getCacheNodeIds()
    monkeypatch.setattr(training, "TASK_ROWS", 7)
    training.grid_search(data, "rf", grid, folds=2, parallelism=8)
    assert seen == [(1, 8, 120), (18, 1, 120)]
