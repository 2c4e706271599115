"""Model training with Spark ML: forests, boosted trees, SMOTE, cross-validation and search."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.functions.ranks import running_totals
from lintlake.operators import forests
from lintlake.operators.datasets import split_key
from lintlake.operators.evaluation import classification_metrics
from lintlake.operators.neighbours import nearest_neighbours
from lintlake.session import stored

NOT_FEATURES = ("id", "target", "func", "project", "commit_id", "language")
SEED = 42
# Deepest tree Spark ML grows; stands for "no limit".
MAX_DEPTH = 30
SCORES = ["accuracy", "precision", "recall", "f1", "roc_auc"]

# Default settings of the two models.
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 1, "seed": SEED}
BOOSTED = {
    "maxIter": 150,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": SEED,
}
# The search grids and the ranges of the trial search.
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 20, MAX_DEPTH], "weightCol": ["balanced", "unit"]}
BOOSTED_GRID = {"maxIter": [50, 100, 200], "maxDepth": [4, 6, 8], "stepSize": [0.01, 0.1, 0.2]}
TRIALS, SEARCH_FOLDS, FOLDS, NEIGHBOURS = 20, 3, 5, 5
#: Rows of a task of a search, about. A task holds and sends sums for all open nodes of all trees, however few
#: its rows are, so more tasks than the rows ask for multiply the work.
TASK_ROWS = 100_000


#: What the trials of a forest are drawn from, its columns of weights, and Spark ML's most classes.
FOREST_DRAWN, WEIGHTS, MOST_CLASSES = {"numTrees", "maxDepth", "minInstancesPerNode", "weightCol"}, ["balanced", "unit", "boost"], 100


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def preprocess_features(df: DataFrame) -> DataFrame:
    """(id, features vector, target) with nulls and NaN as 0; needs a ``target``."""
    if "target" not in df.columns:
        raise ValueError("Target column missing in dataset.")
    names = feature_names(df)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    keep = ["id"] if "id" in df.columns else []
    numeric = df.select(*keep, *[F.col(n).cast("double").alias(n) for n in names], F.col("target").cast("double"))
    return assembler.transform(numeric.fillna(0.0, names)).select(*keep, "features", "target")


def with_weights(data: DataFrame) -> DataFrame:
    """Class weights: ``balanced`` n / (2 n_c), ``boost`` neg/pos for the positives, ``unit`` 1."""
    counts = data.agg(
        F.count("*").alias("n"), F.count_if(F.col("target") == 1).alias("pos")
    ).select(F.struct("n", "pos").alias("c")).scalar()
    n, pos = F.col("_c.n"), F.col("_c.pos")
    of_class = F.when(F.col("target") == 1, pos).otherwise(n - pos)
    return (
        data.withColumn("_c", counts)
        .withColumns(
            {
                "balanced": n / (2.0 * of_class),
                "boost": F.when(
                    F.col("target") == 1, (n - pos) / F.greatest(pos, F.lit(1))
                ).otherwise(1.0),
                "unit": F.lit(1.0),
            }
        )
        .drop("_c")
    )


def _scaler() -> StandardScaler:
    # Trees split on order, so the sample deviation used here gives the same trees.
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def forest(params: dict | None = None) -> RandomForestClassifier:
    settings = {"weightCol": "balanced", **FOREST, **(params or {})}
    # Rows remember their nodes: without, each pass takes every row down every tree again and ships the trees.
    return RandomForestClassifier(featuresCol="scaled", labelCol="target", cacheNodeIds=True, **settings)


def boosted(params: dict | None = None) -> GBTClassifier:
    settings = {"weightCol": "boost", **BOOSTED, **(params or {})}
    return GBTClassifier(featuresCol="scaled", labelCol="target", **settings)


def classifier(model_type: str, params: dict | None = None):
    kinds = {"rf": forest, "xgb": boosted}
    if model_type.lower() not in kinds:
        raise ValueError("model_type must be 'rf' or 'xgb'")
    return kinds[model_type.lower()](params)


def train_random_forest(data: DataFrame, params: dict | None = None) -> PipelineModel:
    return Pipeline(stages=[_scaler(), forest(params)]).fit(with_weights(data))


def train_boosted_trees(data: DataFrame, params: dict | None = None) -> PipelineModel:
    return Pipeline(stages=[_scaler(), boosted(params)]).fit(with_weights(data))


def predictions(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(id, y_true, y_pred, y_proba) of a fitted model."""
    scored = model.transform(data)
    keep = ["id"] if "id" in data.columns else []
    return scored.select(
        *keep,
        F.col("target").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_proba"),
    )


def smote(data: DataFrame, k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """Add synthetic minority rows until the classes balance.

    Each new row lies between a minority row and one of its k nearest minority rows (found
    approximately, see ``neighbours``). The new rows are dealt evenly over the minority rows by rank.
    """
    counts = data.groupBy("target").agg(F.count("*").alias("n"))
    ends = counts.agg(
        F.count("*").alias("classes"), F.min(F.struct("n", "target")).alias("least"), F.max("n").alias("most")
    ).first()
    if ends.classes < 2:
        return data
    minority, have, wanted = ends.least.target, ends.least.n, ends.most - ends.least.n
    rows = data.where(F.col("target") == minority).select(
        F.col("id").cast("string").alias("id"), vector_to_array("features").alias("x")
    )
    ranked = running_totals(
        rows.select("id", split_key(F.col("id"), seed).alias("h")).groupBy("h").agg(F.count("*").alias("n")),
        [],
        "h",
        ["n"],
    )
    # Decimals, because the products of two row counts can pass the range of a bigint.
    before = "CAST(n_before AS DECIMAL(19, 0))"
    share = F.expr(f"div(({before} + n) * {wanted}, {have}) - div({before} * {wanted}, {have})")
    groups = stored(ranked.select("h", "n", F.col("n").alias("rows"), share.alias("share")).where("share > 0"), "shares")
    # Rows that share an id share its new rows; for a unique id nothing is left to chance.
    extra = (F.rand(seed) * F.col("n") < F.col("share") % F.col("n")).cast("bigint")
    copies = (F.expr("div(share, n)") + extra).cast("int")

    def draw(salt: str):
        key = F.concat_ws("|", "id", F.col("copy").cast("string"), F.lit(f"{salt}{seed}"))
        return (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)).cast("double")

    near = nearest_neighbours(rows, k).withColumn("h", split_key(F.col("id"), seed))
    made = (
        salted_join(near, groups, ["h"], "rows")
        .withColumn("copies", copies)
        .where("copies > 0")
        # A row without neighbours is repeated as it is.
        .withColumn("neighbours", F.when(F.size("neighbours") > 0, F.col("neighbours")).otherwise(F.array("x")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumns({"pick": draw("n"), "gap": draw("g")})
        .withColumn("y", F.element_at("neighbours", (F.floor(F.col("pick") * F.size("neighbours")) + 1).cast("int")))
        .withColumn("z", F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a)))
    )
    new = made.select(
        F.concat("id", F.lit("~"), F.col("copy").cast("string")).alias("id"),
        array_to_vector("z").alias("features"),
        F.lit(minority).cast("double").alias("target"),
    )
    return data.select(F.col("id").cast("string").alias("id"), "features", "target").unionByName(new)


def train_with_smote(
    data: DataFrame, model_type: str = "rf", params: dict | None = None, seed: int = SEED
) -> PipelineModel:
    """Scale, balance with SMOTE, then train with unit weights."""
    settings = {"weightCol": "unit", "maxDepth": MAX_DEPTH} if model_type.lower() == "rf" else {"weightCol": "unit"}
    trees = {"numTrees": 100} if model_type.lower() == "rf" else {"maxIter": 100}
    estimator = classifier(model_type, {**settings, **trees, **(params or {})})
    scaler = _scaler().fit(data)
    scaled = scaler.transform(data).select("id", F.col("scaled").alias("features"), "target")
    balanced = smote(scaled, seed=seed).withColumnRenamed("features", "scaled")
    fitted = estimator.fit(balanced.withColumn("unit", F.lit(1.0)))
    return PipelineModel(stages=[scaler, fitted])


def with_folds(data: DataFrame, folds: int, seed: int = SEED) -> DataFrame:
    """Fold of each row: its rank by a hash of the id inside its class, modulo the number of folds, so
    every fold has the classes in their shares. Copies of an id fall into the same fold."""
    keyed = data.withColumn("_h", split_key(F.col("id"), seed))
    counted = keyed.groupBy("target", "_h").agg(F.count("*").alias("n"))
    ranked = running_totals(counted, ["target"], "_h", ["n"])
    known = stored(ranked.select("target", "_h", "n", (F.col("n_before") % folds).cast("int").alias("fold")), "fold-keys")
    return salted_join(keyed, known, ["target", "_h"], "n").select(*data.columns, "fold")


def fold_scores(data: DataFrame, estimator, folds: int = FOLDS) -> DataFrame:
    """Rows, positives and the five scores of each held-out fold."""
    rows = stored(with_folds(data, folds), "folds")
    scores = None
    for fold in range(folds):
        train = with_weights(rows.where(F.col("fold") != fold))
        model = Pipeline(stages=[_scaler(), estimator]).fit(train)
        held = stored(predictions(model, rows.where(F.col("fold") == fold)), "held-out")
        counts = held.agg(F.count("*").alias("n"), F.sum("y_true").alias("positives")).select(F.struct("n", "positives")).scalar()
        one = classification_metrics(held).withColumns({"fold": F.lit(fold), "_c": counts})
        one = one.select("fold", "_c.n", "_c.positives", *SCORES)
        scores = one if scores is None else scores.unionByName(one)
    return scores


def cross_validate(data: DataFrame, estimator=None, folds: int = FOLDS) -> DataFrame:
    """Mean and population deviation over the folds, as mean_* and std_* columns."""
    scores = fold_scores(data, estimator or forest(), folds)
    return scores.agg(
        *[F.avg(s).alias(f"mean_{s}") for s in SCORES],
        *[F.stddev_pop(s).alias(f"std_{s}") for s in SCORES],
    )


def _search(data: DataFrame, estimator, maps: list[dict], folds: int, parallelism: int):
    """The settings by cross-validated F1. At most ``parallelism`` of them are fitted at a time: as many as keep
    the cores busy twice over with one task per ``TASK_ROWS`` rows, for each of them holds the rows."""
    pipeline = Pipeline(stages=[_scaler(), estimator])
    dealt = stored(with_folds(with_weights(data), folds), "folds")
    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    cores = data.sparkSession.sparkContext.defaultParallelism
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(
            labelCol="target", metricName="fMeasureByLabel", metricLabel=1.0
        ),
        numFolds=folds,
        foldCol="fold",
        parallelism=min(parallelism, -(-2 * cores // tasks)),
        seed=SEED,
    )
    # In a fixed order, because draws of rows follow it.
    fitted = validator.fit(dealt.repartition(tasks, "id").sortWithinPartitions("id"))
    return fitted.bestModel, _trials(data, maps, fitted.avgMetrics)


def _trials(data: DataFrame, maps: list[dict], values: list[float]) -> DataFrame:
    rows = [
        (i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(value))
        for i, (m, value) in enumerate(zip(maps, values))
    ]
    return data.sparkSession.createDataFrame(rows, "trial int, params string, value double")


def _forest_search(data: DataFrame, estimator, maps: list[dict], folds: int):
    """The settings of forests by cross-validated F1, all of them grown and scored together (see ``forests``); the
    best one is fitted to all rows. None where rows or folds are not what forests of classes can be grown from."""
    dealt = stored(with_folds(with_weights(data), folds), "folds")
    found = dealt.groupBy("fold", "target").agg(F.count("*").alias("n"), *[F.first(w).alias(w) for w in WEIGHTS])
    found = found.limit(folds * MOST_CLASSES + 1).collect()
    targets = {r.target for r in found}
    if len(found) > folds * MOST_CLASSES or any(t is None or t not in range(MOST_CLASSES) for t in targets):
        return None
    if {r.fold for r in found if r.target == 1} < set(range(folds)):
        return None
    weights = {w: [0.0] * (int(max(targets)) + 1) for w in WEIGHTS}
    for r in found:
        for w in WEIGHTS:
            weights[w][int(r.target)] = float(r[w])
    named = [{**{p.name: v for p, v in estimator.extractParamMap().items()}, **{p.name: v for p, v in m.items()}} for m in maps]
    # A forest of one tree tries all features at a node.
    if any(m["numTrees"] < 2 for m in named):
        return None
    settings = [(m["numTrees"], m["maxDepth"], m["minInstancesPerNode"], weights[m["weightCol"]]) for m in named]
    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    # In a fixed order, because draws of rows follow it.
    rows = dealt.repartition(tasks, "id").sortWithinPartitions("id").persist()
    by_fold = forests.fold_f1(rows, _scaler(), settings, folds, SEED)
    values = [sum(v) / folds for v in by_fold]
    best = max(range(len(maps)), key=values.__getitem__)
    model = Pipeline(stages=[_scaler(), estimator]).fit(rows, maps[best])
    rows.unpersist()
    return model, _trials(data, maps, values)


def grid_search(
    data: DataFrame,
    model_type: str = "rf",
    grid: dict | None = None,
    folds: int = SEARCH_FOLDS,
    parallelism: int = 4,
):
    """Full grid by cross-validated F1: (best model, trials table)."""
    estimator = classifier(model_type)
    builder = ParamGridBuilder()
    for name, values in (grid or (FOREST_GRID if model_type == "rf" else BOOSTED_GRID)).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return _search(data, estimator, builder.build(), folds, parallelism)


def draw_params(model_type: str, trials: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from the search ranges."""
    dice = random.Random(seed)
    drawn = []
    for _ in range(trials):
        # The ranges of the trial search.
        if model_type == "rf":
            drawn.append(
                {
                    "numTrees": dice.randint(50, 300),
                    "maxDepth": dice.randint(5, 30),
                    "minInstancesPerNode": max(dice.randint(1, 10), dice.randint(2, 20) // 2),
                    "weightCol": dice.choice(["balanced", "balanced", "unit"]),
                }
            )
        elif model_type == "xgb":
            drawn.append(
                {
                    "maxIter": dice.randint(50, 300),
                    "maxDepth": dice.randint(3, 15),
                    "stepSize": math.exp(dice.uniform(math.log(1e-3), math.log(0.3))),
                    "subsamplingRate": dice.uniform(0.5, 1.0),
                    "featureSubsetStrategy": f"{dice.uniform(0.5, 1.0):.3f}",
                    "minInstancesPerNode": dice.randint(1, 10),
                }
            )
        else:
            raise ValueError(f"Unknown model type: {model_type}")
    return drawn


def trial_search(
    data: DataFrame,
    model_type: str = "rf",
    trials: int = TRIALS,
    folds: int = SEARCH_FOLDS,
    parallelism: int = 4,
    overrides: dict | None = None,
):
    """Random search by cross-validated F1: (best model, trials table)."""
    estimator = classifier(model_type)
    maps = [
        {estimator.getParam(n): v for n, v in {**drawn, **(overrides or {})}.items()}
        for drawn in draw_params(model_type, trials)
    ]
    if model_type == "rf" and not set(overrides or {}) - FOREST_DRAWN:
        found = _forest_search(data, estimator, maps, folds)
        if found:
            return found
    return _search(data, estimator, maps, folds, parallelism)


def feature_importances(model: PipelineModel, names: list[str], top: int = 15) -> DataFrame:
    """The ``top`` features by importance, highest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(names, values)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)
