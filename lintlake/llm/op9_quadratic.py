"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a whole text (lengths, shares of character classes, repetition, variety) are transformed
to be roughly normal. Means and covariances of each class are sums over the labelled rows that may be
learned from, added up by Spark; only one matrix per class and partial sum reaches the driver. A class
covariance is shrunk towards the pooled one and towards its diagonal, its Cholesky factor is computed
once, and a task scores a batch by two triangular products: the difference of the log densities is
-(|L1^-1 (x - m1)|^2 - |L0^-1 (x - m0)|^2) / 2 and the logs of determinants and priors.

Defined results: null text is empty and gets a score like any other; a label of a document that is not
there, and null labels or ids, are not learned from; a document with several labels counts with each;
repeated rows give repeated results; without labels of both classes every score is 1; an empty table
gives no rows; other columns are ignored by ``score`` and carried by ``accepted``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import textstats as stats
from lintlake.llm.common import give_back, narrow, remainder, small_batches, stored, worker_state
from lintlake.llm.textstats import basic_counts, class_counts, class_table

FEATURES = 14
#: Shares of the pooled covariance and of the diagonal in a class covariance; variance added to each
#: feature after scaling by the pooled deviation.
POOLED, DIAGONAL, RIDGE = 0.3, 0.1, 0.3
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5


def features(text: str, table: np.ndarray) -> np.ndarray:
    """The transformed statistics of one text."""
    x = basic_counts(text)
    chars = class_counts(text, table)
    words, n, size = x["words"], max(x["n_words"], 1), max(len(text), 1)
    letters = max(chars[stats.LOWER] + chars[stats.UPPER] + chars[stats.WIDE_LOWER] + chars[stats.WIDE_UPPER], 1)
    counts = x["word_counts"]

    def share(v, of, least=0.002):
        return np.log(v / of + least)

    top = int(counts.max()) if len(counts) else 0
    bare = sum(not w.isalnum() and len(w) == 1 for w in words)
    return np.array([
        np.log(x["n_words"] + 5),
        np.log(x["word_chars"] / n + 1),
        share(x["n_symbols"], n),
        share(chars[stats.UPPER] + chars[stats.WIDE_UPPER], letters),
        share(chars[stats.DIGIT], size),
        share(chars[stats.PROSE], n),
        share(chars[stats.SYMBOL], size),
        share(chars[stats.SPACE], size),
        share(x["n_dup_lines"], max(x["n_lines"], 1), 0.02),
        share(x["n_repeat_words"], n, 0.02),
        share(top, n, 0.02),
        np.log((len(counts) + 5) / (n + 5) ** 0.75),
        share(bare, n, 0.01),
        share(text.count("!"), n, 0.01),
    ])


def vectors(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, x) with the features as an array."""
    rows = narrow(docs, id_col, text_col)

    def run(batches):
        state = worker_state()
        if "class_table" not in state:
            state["class_table"] = class_table()
        for b in batches:
            made = [features(t.as_py(), state["class_table"]) for t in b.column(1)]
            flat = np.concatenate(made) if made else np.empty(0)
            x = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * FEATURES, pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])
            give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Two normal densities with cached Cholesky factors."""

    def __init__(self, parts):
        """``parts``: for each class (count, sum, sum of outer products)."""
        counts = np.array([p[0] for p in parts], float)
        self.known = bool((counts > 0).all())
        if not self.known:
            return
        means = [p[1] / p[0] for p in parts]
        covs = [p[2] / p[0] - np.outer(m, m) for p, m in zip(parts, means)]
        pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(scale, scale)
        self.scale, self.terms = scale, []
        for n, m, c in zip(counts, means, covs):
            c = c / np.outer(scale, scale)
            lam = max(POOLED, FEATURES / (n + FEATURES))  # few rows: mostly the pooled covariance
            c = (1 - lam) * c + lam * pooled
            c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(len(m))
            factor = np.linalg.cholesky(c)
            const = np.log(n / counts.sum()) - np.log(np.diag(factor)).sum()
            self.terms.append((m, np.linalg.inv(factor).T, const))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known or not len(x):
            return np.ones(len(x))
        logs = [k - 0.5 * (((x - m) / self.scale @ inverse) ** 2).sum(axis=1) for m, inverse, k in self.terms]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(made: DataFrame, marks: DataFrame, id_col="doc_id", label_col="quality") -> Discriminant:
    """Learn from vectors and labels whose id is not held out."""
    marks = marks.select(marks[id_col].alias("_id"), marks[label_col].alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    marks = marks.where(remainder(F.col("_id"), FOLDS) != HELD_OUT)
    known = made.join(marks, F.col("doc_id") == F.col("_id")).select("_label", "x")

    def run(batches):
        sums = [[0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))] for _ in range(2)]
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            for k in (0, 1):
                own = x[y == k]
                sums[k] = [sums[k][0] + len(own), sums[k][1] + own.sum(axis=0), sums[k][2] + own.T @ own]
        flat = [[float(n), *s, *ss.ravel()] for n, s, ss in sums]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(flat, pa.list_(pa.float64()))], ["k", "sums"])

    partial = known.mapInArrow(run, "k bigint, sums array<double>")
    width = 1 + FEATURES + FEATURES**2
    total = partial.groupBy("k").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    parts = [(0, None, None), (0, None, None)]
    for r in total.collect():
        v = np.array(r[1:], float)
        parts[r["k"]] = (v[0], v[1 : 1 + FEATURES], v[1 + FEATURES :].reshape(FEATURES, FEATURES))
    return Discriminant(parts)


def score_vectors(made: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = made.schema["doc_id"].dataType.simpleString()
    scored = made.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def score(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    made = stored(vectors(docs, id_col, text_col), "features")
    return score_vectors(made, fit(made, marks, id_col, label_col))


def accepted(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    A verdict depends on the text alone, so the texts are judged where they lie and nothing is joined."""
    made = vectors(docs, id_col, text_col)
    model = fit(made, marks, id_col, label_col)

    def run(batches):
        state = worker_state()
        if "class_table" not in state:
            state["class_table"] = class_table()
        for b in batches:
            x = [features(t.as_py() or "", state["class_table"]) for t in b.column(text_at)]
            yield b.filter(pa.array(model.score(np.array(x).reshape(-1, FEATURES)) >= THRESHOLD))
            give_back()

    text_at = docs.columns.index(text_col)
    return small_batches(docs).mapInArrow(run, docs.schema)
