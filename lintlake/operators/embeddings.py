"""Embeddings: pooling, extraction, fusion with features, and heads on fused vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions import text as X
from lintlake.operators.tokens import default_tokens
from lintlake.operators.perceptron import Perceptron
from lintlake.operators.perceptron import train as train_perceptron
from lintlake.operators.training import boosted, with_weights

# Batch size of the encoder, sizes of the hidden layers, training rounds.
BATCH, HIDDEN, EPOCHS, FUSED_ROUNDS = 16, [256, 128], 50, 200
MASK_FLOOR = 1e-9
DEFAULT_DIM = 64


def cls_embedding(vectors: Column) -> Column:
    """The vector of the first token; null without tokens."""
    return F.get(vectors, F.lit(0))


def mean_pooled_embedding(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors where the mask is 1; null without tokens."""
    kept = F.aggregate(mask, F.lit(0.0), lambda total, m: total + m)

    def component(d: Column) -> Column:
        products = F.zip_with(vectors, mask, lambda v, m: F.get(v, d) * m)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x) / F.greatest(
            kept, F.lit(MASK_FLOOR)
        )

    return F.transform(F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1), component)


def extract_embeddings(
    codes: DataFrame,
    pooling: str = "cls",
    encoder: Callable | None = None,
    batch_size: int = BATCH,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Add ``embedding`` to (id, code) rows.

    ``encoder`` is a loader: called once per Python worker, it returns a function from a batch
    of texts to a batch of vectors, run in Arrow batches of ``batch_size``. Without one, tokens
    are hashed into ``dim`` buckets in the JVM: all of them for ``mean``, the first for ``cls``.
    """
    if pooling not in ("cls", "mean"):
        raise ValueError(f"Unknown pooling method: {pooling}")
    text = F.coalesce("code", F.lit(""))
    if encoder is not None:
        predict = predict_batch_udf(
            encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )
        return codes.withColumn("embedding", predict(text))
    found = default_tokens(text)
    tokens = codes.withColumn("_tokens", found if pooling == "mean" else F.slice(found, 1, 1))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(tokens)
    size = F.greatest(F.size("_tokens"), F.lit(1))
    mean = X.let(size, lambda n: F.transform(vector_to_array("_tf"), lambda v: (v / n).cast("float")))
    return hashed.withColumn("embedding", mean).drop("_tokens", "_tf")


def standardize(features: DataFrame, names: list[str]) -> DataFrame:
    """Population z-scores; a constant column is only centred."""
    facts = features.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    )
    held = features.withColumn("_f", facts.select(F.struct("*").alias("f")).scalar())

    def scaled(n: str) -> Column:
        spread = F.when(F.col(f"_f.s_{n}") == 0, 1.0).otherwise(F.col(f"_f.s_{n}"))
        return (F.col(n) - F.col(f"_f.m_{n}")) / spread

    return held.withColumns({n: scaled(n) for n in names}).drop("_f")


def reduce_dimensions(embeddings: DataFrame, size: int) -> DataFrame:
    """Principal components of centred embeddings."""
    vectors = embeddings.withColumn(
        "_v", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    model = PCA(k=size, inputCol="_v", outputCol="_p").fit(vectors)
    # The components of the mean vector are subtracted afterwards: projection is linear.
    centre = vectors.agg(Summarizer.mean(F.col("_v")).alias("_v"))
    shift = model.transform(centre).select(vector_to_array("_p").alias("s")).scalar()
    projected = model.transform(vectors).withColumn("_shift", shift)
    moved = F.zip_with(vector_to_array("_p"), "_shift", lambda p, s: p - s)
    return projected.withColumn("embedding", moved).drop("_v", "_p", "_shift")


def fuse_features(
    features: DataFrame, embeddings: DataFrame, names: list[str], reduce_dim: int | None = None
) -> DataFrame:
    """(id, features vector): z-scored columns followed by the embedding, joined on id."""
    width = None
    if reduce_dim:
        first = embeddings.select(F.size("embedding")).first()
        width = first[0] if first else 0
    reduced = embeddings
    if reduce_dim and reduce_dim < width:
        reduced = reduce_dimensions(embeddings, reduce_dim)
    joined = standardize(features, names).join(reduced.select("id", "embedding"), "id")
    columns = F.array(*[F.col(n).cast("double") for n in names])
    vector = array_to_vector(F.concat(columns, F.col("embedding").cast("array<double>")))
    keep = ["target"] if "target" in features.columns else []
    return joined.select("id", vector.alias("features"), *[F.col(c).cast("double") for c in keep])


def train_mlp(
    data: DataFrame, epochs: int = EPOCHS, hidden: list[int] | None = None, validation: DataFrame | None = None
) -> Perceptron:
    """A perceptron with two hidden layers; positives weigh neg/pos. With a validation table the weights
    are those of the epoch with the best F1, and ``epoch_log`` has the scores of all."""
    return train_perceptron(data, validation, hidden or HIDDEN, epochs)


def train_fused_boosted(data: DataFrame, params: dict | None = None) -> PipelineModel:
    trees = boosted({"maxIter": FUSED_ROUNDS, **(params or {})}).setFeaturesCol("features")
    return Pipeline(stages=[trees]).fit(with_weights(data))


def score(model: PipelineModel | Perceptron, data: DataFrame) -> DataFrame:
    """(id, probability, predicted) with class 1 above one half."""
    probability = vector_to_array("probability")[1]
    return model.transform(data).select(
        "id", probability.alias("probability"), (probability > 0.5).cast("int").alias("predicted")
    )
