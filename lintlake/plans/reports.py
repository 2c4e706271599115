"""Queries over the stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.ranks import at_rank
from lintlake.schemas import COMPLEXITY_ITEM, METRICS_ITEM, SECURITY_ITEM
from lintlake.sources.report_store import delete_report, delete_reports, find_report, read_reports

# The languages offered, which include one the parser rejects, and the page limits.
OFFERED_LANGUAGES = ["python", "c", "cpp", "java", "javascript"]
PAGE_DEFAULT, PAGE_MAX = 20, 100
#: Rows up to which a page is found with one heap per task.
HEAP = 10_000


def report_by_id(reports: DataFrame, report_id: str) -> DataFrame:
    """The report with the id; no row when there is none."""
    return reports.where(F.col("id") == report_id)


def _of_language(reports: DataFrame, language: str | None) -> DataFrame:
    return reports.where(F.col("language") == language) if language else reports


def list_reports(
    reports: DataFrame,
    skip: int = 0,
    limit: int = PAGE_DEFAULT,
    language: str | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """A page of reports, newest first, with the total number in ``total``.

    Ties are settled by id, so that pages do not overlap. ``after``, the (created_at, id) of the last
    report seen, starts the page behind it, however deep that is; ``skip`` counts from there. The page's
    keys are found first, with a heap of ``skip + limit`` of them per task; where that would be more than
    ``HEAP``, the key at the place ``skip`` is selected in rounds of counting. Its rows, at most
    ``PAGE_MAX``, are then fetched by key.
    """
    if skip < 0 or not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"skip must be >= 0 and limit in 1..{PAGE_MAX}")
    chosen = _of_language(reports, language)
    total = chosen.agg(F.count("*").alias("n")).scalar()
    newest = [F.desc("created_at"), F.asc("id")]
    keys = chosen.select("created_at", "id")
    if after is not None:
        keys = keys.where(_is_behind(*after))
    if skip + limit > HEAP:
        keys, skip = at_rank(keys, [("created_at", False), ("id", True)], skip, limit, HEAP)
    page = keys.orderBy(*newest).limit(skip + limit).offset(skip)
    page = page.select(F.col("created_at").alias("_at"), F.col("id").alias("_id")).distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("created_at").eqNullSafe(F.col("_at"))
    rows = chosen.join(F.broadcast(page), same, "left_semi")
    return rows.orderBy(*newest).limit(limit).withColumn("total", total)


def _is_behind(created_at, report_id):
    """Whether a report comes behind the given one: older, or as old with a larger id."""
    if created_at is None:
        older = F.lit(False)
    else:
        older = (F.col("created_at") < F.lit(created_at)) | F.col("created_at").isNull()
    return older | F.col("created_at").eqNullSafe(F.lit(created_at)) & (F.col("id") > F.lit(report_id))


def summary_stats(reports: DataFrame) -> DataFrame:
    """Reports by risk level, and all of them in the row with a null level, in one pass.

    Only the sums per level are rolled up.
    """
    levels = reports.groupBy("risk_level").agg(
        F.count("*").alias("n"), F.sum("bug_probability").alias("p")
    )
    return levels.rollup("risk_level").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("analyses"),
        F.coalesce(F.sum("p") / F.sum("n"), F.lit(0.0)).alias("average_bug_probability"),
    )


def without_report(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """Reports that remain after deleting the ids of a table."""
    return reports.join(ids.select("id"), "id", "left_anti")


def to_response(stored: DataFrame) -> DataFrame:
    """Reports stored with JSON text columns in response shape; bad JSON becomes the default."""

    def parsed(column: str, schema: str):
        return F.from_json(column, schema)

    zero = F.lit("{}")
    complexity = parsed("complexity_json", f"array<{COMPLEXITY_ITEM.simpleString()}>")
    issues = parsed("security_issues_json", f"array<{SECURITY_ITEM.simpleString()}>")
    kind = METRICS_ITEM.simpleString()
    metrics = F.coalesce(parsed("metrics_json", kind), F.from_json(zero, kind))
    filled = F.struct(
        *[
            F.coalesce(metrics[f.name], F.lit(0).cast(f.dataType)).alias(f.name)
            for f in METRICS_ITEM.fields
        ]
    )
    return stored.select(
        F.col("id").alias("analysis_id"),
        "code_hash",
        "language",
        "bug_probability",
        "risk_level",
        F.coalesce(complexity, F.array()).alias("complexity_estimates"),
        F.coalesce(issues, F.array()).alias("security_issues"),
        filled.alias("metrics"),
        F.col("created_at").alias("analyzed_at"),
    )


def supported_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in OFFERED_LANGUAGES], "language string")


__all__ = [
    "delete_report",
    "delete_reports",
    "find_report",
    "list_reports",
    "read_reports",
    "report_by_id",
    "summary_stats",
    "supported_languages",
    "to_response",
    "without_report",
]
