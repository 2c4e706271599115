"""Dataset splits, statistics and checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions.ranks import select_ranks
from lintlake.operators.features import numeric_columns

SEED = 42
NOT_LISTED = ("id", "target", "func")


def split_key(id_column: Column, seed: int = SEED) -> Column:
    """A uniform 60-bit number per id; any engine with md5 can compute it."""
    digest = F.md5(F.concat(id_column.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def create_splits(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    id_column: str = "id",
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: train, val or test, in the given shares of each class.

    Rows are ordered by a hash of their id inside a class and cut at exact ranks, which are selected
    without sorting; the two cut points per class (their number is checked) are joined back, so the rows
    stay put. Copies of an id fall into the same split. The table is read three times.
    """
    if abs(train + val + test - 1.0) >= 1e-5:
        raise ValueError("Ratios must sum to 1.0")
    stratum = F.lit(0)
    if "target" in df.columns:
        # Rows without a class are a class of their own.
        stratum = F.coalesce(F.col("target").cast("string"), F.lit("none"))
    keyed = df.withColumns({"_stratum": stratum, "_key": split_key(F.col(id_column), seed)})
    shares = [train, train + val]
    found = select_ranks(keyed, "_stratum", "_key", shares, lambda n, i: math.floor(n * shares[i]))
    # A split begins at the first key with so many rows before it: that at the rank, or the one behind it.
    rows = [
        (stratum, *(x and x.value + (x.before < math.floor(x.total * shares[i])) for i, x in enumerate(cuts)))
        for stratum, cuts in found.items()
    ]
    kind = keyed.schema["_stratum"].dataType.simpleString()
    cuts = df.sparkSession.createDataFrame(rows, f"_stratum {kind}, _val_from bigint, _test_from bigint")
    split = (
        F.when(F.col("_key") >= F.col("_test_from"), "test")
        .when(F.col("_key") >= F.col("_val_from"), "val")
        .otherwise("train")
    )
    return (
        keyed.join(F.broadcast(cuts), "_stratum")
        .withColumn("split", split)
        .drop("_stratum", "_key", "_val_from", "_test_from")
    )


def three_way(split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(split.where(F.col("split") == name).drop("split") for name in ("train", "val", "test"))


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    kind = df.schema[name].dataType
    empty = c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()
    return F.count_if(empty)


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: size, feature names, nulls per column and buggy share (null for no rows), in one pass.

    ``class_distribution`` has the rows per class.
    """
    features = [c for c in df.columns if c not in NOT_LISTED]
    facts = [F.count("*").alias("total_rows")]
    facts += [_missing(df, c).alias(f"missing_{c}") for c in df.columns]
    if "target" in df.columns:
        facts.append((F.try_divide(F.count_if(F.col("target") == 1), F.count("*"))).alias("buggy_ratio"))
    names = F.array(*[F.lit(c) for c in features]).cast("array<string>")
    return df.agg(*facts).withColumn("features", names)


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per class, nulls left out."""
    return df.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("n"))


def validate_dataset(df: DataFrame) -> DataFrame:
    """One row per issue, in the order of the checks; no rows for a sound dataset."""
    numeric = numeric_columns(df)
    target = "target" in df.columns
    aggregates = [F.count("*").alias("_rows")]
    aggregates += [_missing(df, c).alias(f"_null_{c}") for c in df.columns]
    aggregates += [F.stddev_samp(c).alias(f"_std_{c}") for c in numeric]
    if target:
        aggregates += [
            F.min("target").alias("_low"),
            F.max("target").alias("_high"),
            F.count_if(F.col("target") == 1).alias("_buggy"),
        ]
    facts = df.agg(*aggregates)
    nulls = sum((F.col(f"_null_{c}") for c in df.columns), F.lit(0))
    # The wording of the issues.
    checks = []
    if target:
        one_class = F.col("_low").isNull() | (F.col("_low") == F.col("_high"))
        checks.append(
            F.when(
                one_class,
                "Only one class present in 'target'. ML models need at least two classes.",
            ).when(
                F.col("_buggy") / F.col("_rows") < 0.05,
                "Severe class imbalance: 'buggy' class is < 5%. Consider SMOTE.",
            )
        )
    else:
        checks.append(F.lit("Missing 'target' column for labels."))
    checks.append(
        F.when(
            nulls > 0,
            F.concat(F.lit("Found "), nulls.cast("string"), F.lit(" missing values across all columns.")),
        )
    )
    checks += [
        F.when(F.col(f"_std_{c}") == 0, f"Feature '{c}' has zero variance (constant value).")
        for c in numeric
    ]
    found = F.filter(F.array(*checks), lambda issue: issue.isNotNull())
    issues = F.when(F.col("_rows") == 0, F.array(F.lit("Dataset is empty."))).otherwise(found)
    return facts.select(F.posexplode(issues).alias("position", "issue"))
