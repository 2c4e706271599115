"""Labels: from submissions, labelled code and verdicts; alignment and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that mark a verdict as buggy.
BUG_WORDS = ["error", "fail", "bug", "vulnerable", "reject", "wrong"]


def submission_labels(submissions: DataFrame, order: str) -> DataFrame:
    """0 for status Accepted, else 1 (null too); the last row in ``order`` wins per id."""
    target = F.when(F.col("status") == "Accepted", 0).otherwise(1)
    return submissions.groupBy(F.col("submission_id").cast("string").alias("key")).agg(
        F.max_by(target, order).alias("target")
    )


def code_labels(lines: DataFrame, order: str = "line") -> DataFrame:
    """Labels keyed ``project_commit``; defaults are ``unk`` and the line number; last wins.

    Bad lines (``_corrupt_record`` set) are left out, all good ones count; ``bad_lines`` has the others.
    """
    rows = lines.where("_corrupt_record IS NULL") if "_corrupt_record" in lines.columns else lines
    key = F.concat_ws(
        "_",
        F.coalesce("project", F.lit("unk")),
        F.coalesce("commit_id", F.col(order).cast("string")),
    )
    return rows.groupBy(key.alias("key")).agg(
        F.max_by(F.coalesce("target", F.lit(0)), order).alias("target")
    )


def bad_lines(lines: DataFrame, order: str = "line") -> DataFrame:
    """The lines that could not be read, with their position."""
    return lines.where("_corrupt_record IS NOT NULL").select(order, "_corrupt_record")


def verdict_labels(verdicts: DataFrame) -> DataFrame:
    """Integers are kept, text is 1 when it holds a bug word, anything else is 0."""
    if dict(verdicts.dtypes)["verdict"] in ("int", "bigint", "smallint", "tinyint"):
        target = F.coalesce(F.col("verdict").cast("int"), F.lit(0))
    elif dict(verdicts.dtypes)["verdict"] == "string":
        target = F.when(F.lower("verdict").rlike("|".join(BUG_WORDS)), 1).otherwise(0)
    else:
        target = F.lit(0)
    return verdicts.select("key", target.alias("target"))


def align_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Set ``target`` from the label of the id, 0 when there is none; unchanged without an id.

    Labels are unique per key, so rows are never multiplied; Spark picks broadcast or shuffle
    from the size of the labels.
    """
    if "id" not in features.columns:
        return features
    known = labels.select(F.col("key").alias("_key"), F.col("target").alias("_target"))
    joined = features.drop("target").join(
        known, F.col("id").cast("string") == F.col("_key"), "left"
    )
    return joined.withColumn("target", F.coalesce("_target", F.lit(0))).drop("_key", "_target")


def label_statistics(labels: DataFrame) -> DataFrame:
    total, buggy = F.count("*"), F.count_if(F.col("target") == 1)
    return labels.agg(
        total.alias("total"),
        buggy.alias("buggy"),
        (total - buggy).alias("clean"),
        F.when(total == 0, 0.0).otherwise(buggy / total).alias("buggy_ratio"),
    )
