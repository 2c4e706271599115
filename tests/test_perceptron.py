"""The perceptron: gradients against differences, epochs against one written out, the log and the best epoch."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lintlake.operators import embeddings, perceptron


def test_slopes_against_differences():
    draw = np.random.default_rng(1)
    layers = [4, 5, 3]
    flat = perceptron.first_weights(layers, 2)
    x, y = draw.normal(size=(9, 4)), (draw.random(9) < 0.4).astype(float)
    loss, slope = perceptron.slopes(perceptron.split(flat, layers), x, y, 3.5)

    def at(w):
        logits = perceptron.forward(perceptron.split(w, layers), x)[-1][:, 0]
        p = 1 / (1 + np.exp(-logits))
        return float(np.mean(np.where(y > 0, -3.5 * np.log(p), -np.log(1 - p))))

    assert abs(loss - at(flat)) < 1e-12
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert abs((at(flat + step) - at(flat - step)) / 2e-6 - slope[i]) < 1e-7


def table(spark, n, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0.3) | (x[:, 2] > 1.5)).astype(float)
    df = spark.createDataFrame([(str(i), a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id string, x array<double>, target double")
    return df.select("id", array_to_vector("x").alias("features"), "target")


def test_epoch_is_the_mean_of_its_tasks(spark):
    layers, positive = [3, 4], 2.0
    start = np.concatenate([perceptron.first_weights(layers, 1), np.zeros(42)])
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, 50).select(vector_to_array("features").alias("x"), F.col("target").alias("y")).repartition(3).cache()
    shared = spark.sparkContext.broadcast((start, 0))
    found = perceptron.epoch_sums(rows, shared, layers, positive, 0.01, 0, 5).orderBy("block").collect()
    flat = np.concatenate([[r[f"s{i}"] for i in range(perceptron.WIDE)] for r in found])
    size = len(start) // 3
    total = np.zeros(3 * size)
    n = 0
    for part in rows.rdd.glom().collect():
        if not part:
            continue
        x, y = np.array([r.x for r in part]), np.array([r.y for r in part])
        order = np.random.default_rng([5, 0]).permutation(len(y))
        w, m, v = (p.copy() for p in np.split(start, 3))
        _, g = perceptron.slopes(perceptron.split(w, layers), x[order], y[order], positive)
        m, v = 0.1 * g, 0.001 * g * g
        w = w * (1 - 0.01 * perceptron.DECAY) - 0.01 * (m / 0.1) / (np.sqrt(v / 0.001) + 1e-8)
        total += len(y) * np.concatenate([w, m, v])
        n += len(y)
    assert n == 50 == flat[3 * size + 2] and np.allclose(flat[: 3 * size], total, atol=1e-9)
    assert not flat[3 * size + 3 :].any()


def test_training_and_log(spark, tmp_path):
    train, val = table(spark, 1500), table(spark, 400, 7)
    model = embeddings.train_mlp(train, epochs=25, hidden=[16, 8], validation=val)
    log = model.epoch_log(spark).orderBy("epoch").collect()
    assert len(log) == 25 and [r.best for r in log].count(True) == 1
    assert next(r for r in log if r.best).val_f1 == max(r.val_f1 for r in log) > 0.75
    assert log[-1].loss < log[0].loss and all(a.rate >= b.rate for a, b in zip(log, log[1:]))
    scored = embeddings.score(model, val).join(val, "id").collect()
    tp = sum(r.predicted == 1 and r.target == 1 for r in scored)
    wrong = sum(r.predicted != r.target for r in scored)
    assert abs(2 * tp / (2 * tp + wrong) - max(r.val_f1 for r in log)) < 1e-9
    assert all((r.probability > 0.5) == (r.predicted == 1) for r in scored)
    model.save(spark, str(tmp_path / "m"))
    again = perceptron.Perceptron.load(spark, str(tmp_path / "m"))
    assert embeddings.score(again, val).exceptAll(embeddings.score(model, val)).count() == 0 and again.log == model.log


def test_positive_weight_and_edges(spark):
    rare = table(spark, 600).where("target = 0 OR id LIKE '%7'")
    model = embeddings.train_mlp(rare, epochs=12, hidden=[8, 4])
    assert all(r.val_f1 is None and not r.best for r in model.epoch_log(spark).collect())
    found = embeddings.score(model, rare).join(rare, "id").where("target = 1").agg(F.avg("predicted")).first()[0]
    assert found > 0.5
    none = embeddings.train_mlp(rare.limit(0), epochs=3)
    assert none.log == [] and embeddings.score(none, rare.limit(0)).count() == 0
