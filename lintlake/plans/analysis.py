"""The analysis of submitted snippets: metrics, estimates, findings and one report per snippet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import nodes as N
from lintlake.functions import text as X
from lintlake.operators import complexity, metrics, security, structure
from lintlake.operators.parse import with_nodes
from lintlake.schemas import COMPLEXITY_ITEM, METRICS_ITEM, REPORT, SECURITY_ITEM

# The size limit of the web form and the steps of the bug probability, added in this order.
MAX_CHARS = 100_000
BASE_PROBABILITY, PROBABILITY_CAP = 0.1, 0.99
COMPLEXITY_STEP, NESTING_STEP, FINDING_STEP = 0.2, 0.15, 0.3


def code_hash(code: Column) -> Column:
    return F.sha2(code, 256)


def split_by_size(snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the size limit of the web form. A caller who wants that limit splits
    first; ``analyze`` has none."""
    too_large = F.length(F.coalesce("code", F.lit(""))) > MAX_CHARS
    rejected = snippets.where(too_large).select(
        "file_id", F.lit("Code too large. Maximum 100,000 characters.").alias("reason")
    )
    return snippets.where(~too_large), rejected


def bug_probability(cc: Column, nesting: Column, findings: Column) -> Column:
    p = F.lit(BASE_PROBABILITY)
    p = p + F.when(cc > 10, COMPLEXITY_STEP).otherwise(0.0)
    p = p + F.when(nesting > 3, NESTING_STEP).otherwise(0.0)
    p = p + F.when(findings > 0, FINDING_STEP).otherwise(0.0)
    return F.least(p, F.lit(PROBABILITY_CAP))


def _metrics_item(nodes: Column, code: Column) -> Column:
    """Metrics of a parsed file; zeros and a plain line count when the parse failed."""
    fns = F.transform(
        N.functions(nodes),
        lambda f: F.struct(F.greatest(f["end_lineno"] - f["lineno"] + 1, F.lit(1)).alias("length")),
    )
    parsed = F.struct(
        F.size(N.functions(nodes)).alias("function_count"),
        structure.max_nesting(nodes).alias("max_nesting_depth"),
        metrics.total_lines(code).alias("total_lines"),
        metrics.average_length(fns).alias("avg_function_length"),
        metrics.cyclomatic_complexity(nodes).alias("cyclomatic_complexity"),
    )
    failed = F.struct(
        F.lit(0).alias("function_count"),
        F.lit(0).alias("max_nesting_depth"),
        X.line_count(code).alias("total_lines"),
        F.lit(0.0).alias("avg_function_length"),
        F.lit(0).alias("cyclomatic_complexity"),
    )
    return F.when(nodes.isNotNull(), parsed).otherwise(failed).cast(METRICS_ITEM)


def analyze(snippets: DataFrame, at: Column | None = None) -> DataFrame:
    """One report per snippet (``file_id``, ``code``, ``language``), of any length.

    The whole analysis of a snippet happens in its row after one parse: the plan is a scan, the
    parse and projections, without any shuffle. ``at`` is the time stamped on the reports.
    """
    stamped = F.current_timestamp() if at is None else at
    code = F.coalesce("code", F.lit(""))
    # Taken along through the parse, so that it is not evaluated again after it.
    parsed = with_nodes(snippets.withColumn("code", code))
    found = complexity.add_estimates(security.add_findings(parsed)).withColumn(
        "metrics", _metrics_item(F.col("nodes"), F.col("code"))
    )
    listed = F.coalesce(
        F.transform(
            "estimates", lambda e: F.struct(*[e[f.name].alias(f.name) for f in COMPLEXITY_ITEM.fields])
        ),
        F.array(),
    )
    issues = F.transform(
        "findings", lambda f: F.struct(*[f[s.name].alias(s.name) for s in SECURITY_ITEM.fields])
    )
    return found.select(
        F.col("file_id").alias("id"),
        code_hash(F.col("code")).alias("code_hash"),
        F.col("code").alias("code_snippet"),
        bug_probability(
            F.col("metrics.cyclomatic_complexity"),
            F.col("metrics.max_nesting_depth"),
            F.size("findings"),
        ).alias("bug_probability"),
        security.risk_level(security.risk_score(F.col("findings"))).alias("risk_level"),
        listed.alias("complexity"),
        issues.alias("security_issues"),
        "metrics",
        stamped.alias("created_at"),
        stamped.alias("updated_at"),
        "language",
    ).select(*REPORT.fieldNames())


def new_ids(snippets: DataFrame) -> DataFrame:
    """Give snippets without an id of their own a random one."""
    return snippets.withColumn("file_id", F.expr("uuid()"))
