"""A perceptron with two hidden layers, trained by weighted mini-batches where the rows lie.

An epoch is one job: every task starts from the current weights, runs weighted mini-batch steps (AdamW)
over its own rows, and hands on its weights and moments times its number of rows; Spark sums them, and the
mean is where the next epoch starts. So what reaches the driver has the size of the network, whatever the
number of rows and tasks. After each epoch the validation rows are scored by tasks and their counts summed;
the learning rate is halved when the F1 has not risen for some epochs, and the weights of the best epoch are
returned with the log of all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import stored

# Rows of a mini-batch, learning rate, decay, epochs without a better score, and the factor then.
BATCH_ROWS, RATE, DECAY, PATIENCE, FACTOR = 64, 1e-3, 1e-4, 5, 0.5
#: Decay of the moments and their floor; numbers of a row of sums; rows scored at a time.
FIRST, SECOND, FLOOR, WIDE, SCORED = 0.9, 0.999, 1e-8, 64, 4096
#: Rows that a task trains on at least, where there are as many: the mean of many short runs learns little.
TASK_ROWS = 64 * BATCH_ROWS
EPOCH_LOG = "epoch int, loss double, val_loss double, val_precision double, val_recall double, val_f1 double, rate double, best boolean"


def shapes(layers: list[int]) -> list[tuple[int, ...]]:
    """Shapes of weights and offsets of a network with one output."""
    out: list[tuple[int, ...]] = []
    for rows, columns in zip(layers, [*layers[1:], 1]):
        out += [(rows, columns), (columns,)]
    return out


def split(flat: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """Views of a flat vector as weights and offsets."""
    out, at = [], 0
    for shape in shapes(layers):
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    """Uniform within one over the root of a layer's inputs."""
    draw = np.random.default_rng(seed)
    parts = []
    for rows, columns in zip(layers, [*layers[1:], 1]):
        bound = rows**-0.5
        parts += [draw.uniform(-bound, bound, rows * columns), draw.uniform(-bound, bound, columns)]
    return np.concatenate(parts)


def forward(parts: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The input of every layer, and the logits last."""
    out = [x]
    for k in range(0, len(parts), 2):
        z = out[-1] @ parts[k] + parts[k + 1]
        out.append(np.maximum(z, 0) if k + 2 < len(parts) else z)
    return out


def losses(logits: np.ndarray, y: np.ndarray, positive: float) -> np.ndarray:
    """Logistic loss of each row, positives weighted."""
    return np.where(y > 0, positive * np.logaddexp(0, -logits), np.logaddexp(0, logits))


def slopes(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, np.ndarray]:
    """Mean loss of some rows and its gradient, flat."""
    acts = forward(parts, x)
    logits = acts[-1][:, 0]
    p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
    back = (np.where(y > 0, positive * (p - 1), p) / len(y))[:, None]
    out = []
    for k in range(len(parts) - 2, -1, -2):
        out += [back.sum(axis=0), (acts[k // 2].T @ back).ravel()]
        if k:
            back = (back @ parts[k].T) * (acts[k // 2] > 0)
    return float(losses(logits, y, positive).mean()), np.concatenate(out[::-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def epoch_sums(rows: DataFrame, shared, layers: list[int], positive: float, rate: float, done: int, seed: int) -> DataFrame:
    """(block, s0, s1, ...): sums over tasks of rows times (weights, first and second moments, steps, loss)."""
    names = [f"s{i}" for i in range(WIDE)]

    def run(batches):
        state, steps = shared.value
        weights, mean, power = (part.copy() for part in np.split(state, 3))
        draw = np.random.default_rng([seed, done])
        count, total = 0, 0.0
        for b in batches:
            x, y = _matrix(b.column("x")), b.column("y").to_numpy()
            order = draw.permutation(len(y))
            for at in range(0, len(y), BATCH_ROWS):
                own = order[at : at + BATCH_ROWS]
                loss, slope = slopes(split(weights, layers), x[own], y[own], positive)
                steps += 1
                mean += (1 - FIRST) * (slope - mean)
                power += (1 - SECOND) * (slope * slope - power)
                weights *= 1 - rate * DECAY
                weights -= rate * (mean / (1 - FIRST**steps)) / (np.sqrt(power / (1 - SECOND**steps)) + FLOOR)
                total += loss * len(own)
                count += len(own)
        if not count:
            return
        flat = np.concatenate([weights, mean, power, [steps], [total / count], [1.0]]) * count
        flat = np.concatenate([flat, np.zeros(-len(flat) % WIDE)]).reshape(-1, WIDE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), *[pa.array(c) for c in np.ascontiguousarray(flat.T)]], ["block", *names])

    made = rows.mapInArrow(run, "block int, " + ", ".join(f"{n} double" for n in names))
    return made.groupBy("block").agg(*[F.sum(n).alias(n) for n in names])


def validation_counts(rows: DataFrame, shared, layers: list[int], positive: float):
    """Rows, summed loss, and true and false positives and negatives of the validation rows."""

    def run(batches):
        parts = split(shared.value[0][: sum(int(np.prod(s)) for s in shapes(layers))], layers)
        out = np.zeros(5)
        for b in batches:
            x, y = _matrix(b.column("x")), b.column("y").to_numpy() > 0
            for at in range(0, len(y), SCORED):
                logits, own = forward(parts, x[at : at + SCORED])[-1][:, 0], y[at : at + SCORED]
                says = logits >= 0
                out += [len(own), losses(logits, own, positive).sum(), (says & own).sum(), (says & ~own).sum(), (~says & own).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], ["n", "loss", "tp", "fp", "fn"])

    made = rows.mapInArrow(run, "n double, loss double, tp double, fp double, fn double")
    return made.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("n", "loss", "tp", "fp", "fn")]).first()


@dataclass
class Perceptron:
    """A fitted network: layer sizes, flat weights of the best epoch, and the log of the epochs."""

    layers: list[int]
    weights: np.ndarray
    log: list[dict] = field(default_factory=list)

    def epoch_log(self, spark: SparkSession) -> DataFrame:
        """One row per epoch; the scores are null without validation rows."""
        names = [c.split()[0] for c in EPOCH_LOG.split(", ")]
        return spark.createDataFrame([tuple(row[n] for n in names) for row in self.log], EPOCH_LOG)

    def transform(self, data: DataFrame) -> DataFrame:
        """``data`` with ``probability``, a vector of both classes, and ``prediction``."""
        layers, weights = list(self.layers), self.weights

        def score(x: pa.Array) -> pa.Array:
            parts = split(weights, layers)
            logits = [forward(parts, _matrix(x.slice(at, SCORED)))[-1][:, 0] for at in range(0, len(x), SCORED)]
            return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([np.empty(0), *logits]), -700, 700))))

        p = F.arrow_udf(score, "double")(vector_to_array("features"))
        made = data.withColumn("_p", p)
        both = array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))
        return made.withColumns({"probability": both, "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")

    def save(self, spark: SparkSession, path: str) -> None:
        """Layers and log as JSON, weights as an array, in one Parquet file."""
        row = (json.dumps(self.layers), self.weights.tolist(), json.dumps(self.log))
        spark.createDataFrame([row], "layers string, weights array<double>, log string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Perceptron:
        row = spark.read.parquet(path).first()
        return Perceptron(json.loads(row.layers), np.array(row.weights), json.loads(row.log))


def train(data: DataFrame, validation: DataFrame | None, hidden: list[int], epochs: int, seed: int = 42) -> Perceptron:
    """Train on (features vector, target) rows; a table without rows gives an untrained network."""
    spark = data.sparkSession
    rows = stored(data.select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("y")), "perceptron-rows")
    held = None
    if validation is not None:
        held = stored(validation.select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("y")), "perceptron-validation")
    facts = rows.agg(F.max(F.size("x")).alias("width"), F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos")).first()
    rows = rows.coalesce(max(1, facts.n // TASK_ROWS))
    layers = [facts.width or 0, *hidden]
    positive = (facts.n - facts.pos) / max(facts.pos, 1)
    weights = first_weights(layers, seed) if facts.width else np.zeros(sum(int(np.prod(s)) for s in shapes(layers)))
    size = len(weights)
    state, steps, rate = np.concatenate([weights, np.zeros(2 * size)]), 0, RATE
    best, best_weights, waited, log = 0.0, None, 0, []
    for epoch in range(epochs if facts.n else 0):
        shared = spark.sparkContext.broadcast((state, steps))
        sums = epoch_sums(rows, shared, layers, positive, rate, epoch, seed).orderBy("block").toArrow()
        shared.unpersist()
        flat = np.column_stack([sums.column(f"s{i}").to_numpy() for i in range(WIDE)]).ravel()
        flat = flat[: 3 * size + 3] / flat[3 * size + 2]
        state, steps, loss = flat[: 3 * size], max(1, round(flat[3 * size])), float(flat[3 * size + 1])
        entry = {"epoch": epoch + 1, "loss": loss, "val_loss": None, "val_precision": None, "val_recall": None, "val_f1": None, "rate": rate, "best": False}
        if held is not None:
            shared = spark.sparkContext.broadcast((state, steps))
            c = validation_counts(held, shared, layers, positive)
            shared.unpersist()
            precision, recall = c.tp / max(c.tp + c.fp, 1), c.tp / max(c.tp + c.fn, 1)
            f1 = 2 * c.tp / max(2 * c.tp + c.fp + c.fn, 1)
            entry |= {"val_loss": c.loss / max(c.n, 1), "val_precision": precision, "val_recall": recall, "val_f1": f1}
            if f1 > best:
                best, best_weights, waited = f1, state[:size].copy(), 0
                for row in log:
                    row["best"] = False
                entry["best"] = True
            else:
                waited += 1
                if waited > PATIENCE:
                    rate, waited = rate * FACTOR, 0
        log.append(entry)
    return Perceptron(layers, state[:size] if best_weights is None else best_weights, log)
