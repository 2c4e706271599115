"""File metrics: line counts, lengths, cyclomatic complexity, volume, maintainability, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import nodes as N
from lintlake.functions import text as X
from lintlake.operators import structure as S
from lintlake.operators.parse import with_nodes

DECISIONS = ("If", "For", "While", "ExceptHandler", "With", "Assert", "loop", "condition")


def clean_language(language: Column) -> Column:
    return X.strip(F.lower(language))


def total_lines(code: Column) -> Column:
    return F.size(X.boundary_lines(F.coalesce(code, F.lit(""))))


def line_counts(code: Column, language: Column) -> Column:
    """Struct of total, code, blank and comment lines.

    Brace languages need the state "inside a block comment", so their lines are folded;
    a block comment opens only where a line starts with it.
    """

    def hashed(rows: Column) -> Column:
        return F.struct(
            N.count_if(rows, lambda r: r == "").alias("blank"),
            N.count_if(rows, lambda r: r.startswith("#")).alias("comment"),
        )

    def step(state: Column, row: Column) -> Column:
        opens = row.startswith("/*")
        in_comment = state["open"] | opens
        comment = in_comment | row.startswith("//")
        blank = ~in_comment & (row == "")
        return F.struct(
            (in_comment & ~row.contains("*/")).alias("open"),
            (state["blank"] + blank.cast("int")).alias("blank"),
            (state["comment"] + comment.cast("int")).alias("comment"),
        )

    def braced(rows: Column) -> Column:
        start = F.struct(
            F.lit(False).alias("open"), F.lit(0).alias("blank"), F.lit(0).alias("comment")
        )
        return F.aggregate(
            rows, start, step, lambda s: F.struct(s["blank"].alias("blank"), s["comment"].alias("comment"))
        )

    def count(rows: Column) -> Column:
        kinds = F.when(language.isin("c", "java", "javascript"), braced(rows)).otherwise(hashed(rows))
        return X.let(
            kinds,
            lambda k: F.struct(
                F.size(rows).alias("total"),
                F.greatest(F.size(rows) - k["blank"] - k["comment"], F.lit(0)).alias("code"),
                k["blank"].alias("blank"),
                k["comment"].alias("comment"),
            ),
        )

    stripped = F.transform(X.boundary_lines(F.coalesce(code, F.lit(""))), X.strip)
    return X.let(stripped, count)


def halstead_volume(code: Column) -> Column:
    def volume(found: Column) -> Column:
        distinct = F.size(F.array_distinct(found))
        return F.when(distinct <= 1, 1.0).otherwise(
            F.greatest(F.size(found) * F.log2(distinct), F.lit(1.0))
        )

    return X.let(X.tokens(F.coalesce(code, F.lit(""))), volume)


def maintainability_index(volume: Column, complexity: Column, loc: Column) -> Column:
    raw = (
        171.0
        - 5.2 * F.ln(F.when(volume <= 0, 1.0).otherwise(volume))
        - 0.23 * complexity
        - 16.2 * F.ln(F.when(loc <= 0, 1).otherwise(loc))
    )
    scaled = F.least(F.greatest(raw, F.lit(0.0)) * 100.0 / 171.0, F.lit(100.0))
    return X.let(scaled, X.round_half_even)


def decision_weight(n: Column) -> Column:
    return (
        F.when(n["kind"].isin(*DECISIONS), 1)
        .when(n["kind"].isin("BoolOp", "comprehension"), n["n"])
        .otherwise(0)
    )


def cyclomatic_complexity(nodes: Column) -> Column:
    return N.sum_of(nodes, decision_weight) + 1


def function_metrics(nodes: Column) -> Column:
    """Functions sorted by (name, walk order) with their length and own complexity."""
    return F.array_sort(
        F.transform(
            N.functions(nodes),
            lambda f: F.struct(
                f["name"].alias("name"),
                f["depth"].alias("depth"),
                f["pre"].alias("pre"),
                F.greatest(f["end_lineno"] - f["lineno"] + 1, F.lit(1)).alias("length"),
                cyclomatic_complexity(N.subtree(nodes, f)).alias("cyclomatic_complexity"),
            ),
        )
    )


def average_length(functions: Column) -> Column:
    """Mean over all functions, 0.0 without any; ``functions`` has a ``length`` field."""
    mean = N.sum_of(functions, lambda f: f["length"]) / F.size(functions)
    return F.when(F.size(functions) == 0, 0.0).otherwise(X.let(mean, X.round_half_even))


def risk_reasons(m: dict[str, Column]) -> Column:
    def text(before: str, value: Column, after: str = ")") -> Column:
        return F.concat(F.lit(before), value.cast("string"), F.lit(after))

    cc, nest = m["cyclomatic_complexity"], m["max_nesting_depth"]
    length, mi = m["max_function_length"], m["maintainability_index"]
    # The thresholds and wording of the risk rules.
    reasons = F.array(
        F.when(cc > 20, text("Very high cyclomatic complexity (", cc)).when(
            cc > 10, text("High cyclomatic complexity (", cc)
        ),
        F.when(nest > 5, text("Excessive nesting depth (", nest)).when(
            nest > 3, text("Deep nesting (", nest)
        ),
        F.when(length > 100, text("Very long function (", length, " lines)")).when(
            length > 50, text("Long function (", length, " lines)")
        ),
        F.when(mi < 20, text("Low maintainability index (", mi)).when(
            mi < 40, text("Below-average maintainability (", mi)
        ),
        F.when(
            (m["function_count"] == 0) & (m["code_lines"] > 50),
            F.lit("No functions in a file with 50+ lines — consider refactoring"),
        ),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def risk_level(reasons: Column) -> Column:
    severe = F.exists(reasons, lambda r: r.rlike("Very|Excessive|Low maint"))
    return (
        F.when(severe | (F.size(reasons) >= 3), "high")
        .when(F.size(reasons) >= 1, "medium")
        .otherwise("low")
    )


def add_file_metrics(parsed: DataFrame) -> DataFrame:
    """Add every file metric to a parsed table. No shuffle: all inputs are in the row."""
    nodes = F.col("nodes")
    named = S.last_of_each(F.col("functions"), "name")
    measured = (
        parsed.withColumn("language", clean_language(F.col("language")))
        .withColumns(
            {
                "lines": line_counts(F.col("code"), F.col("language")),
                "functions": function_metrics(nodes),
                "class_count": S.class_count(nodes),
                "loop_count": N.count_if(nodes, lambda n: n["kind"].isin(*N.LOOP_KINDS, "loop")),
                "condition_count": N.count_if(nodes, lambda n: n["kind"].isin("If", "condition")),
                "variable_count": F.size(S.variable_structs(nodes)),
                "max_nesting_depth": S.max_nesting(nodes),
                "cyclomatic_complexity": cyclomatic_complexity(nodes),
                "halstead_volume": halstead_volume(F.col("code")),
            }
        )
        .withColumn("by_name", named)
        .withColumns(
            {
                "total_lines": F.col("lines.total"),
                "code_lines": F.col("lines.code"),
                "blank_lines": F.col("lines.blank"),
                "comment_lines": F.col("lines.comment"),
                "function_count": F.size("functions"),
                "avg_function_length": average_length(F.col("functions")),
                "max_function_length": F.coalesce(F.array_max("by_name.length"), F.lit(0)),
                "maintainability_index": maintainability_index(
                    F.col("halstead_volume"), F.col("cyclomatic_complexity"), F.col("lines.code")
                ),
                "per_function_complexity": F.map_from_arrays(
                    "by_name.name", "by_name.cyclomatic_complexity"
                ),
                "per_function_length": F.map_from_arrays("by_name.name", "by_name.length"),
            }
        )
    )
    names = [
        "cyclomatic_complexity",
        "max_nesting_depth",
        "max_function_length",
        "maintainability_index",
        "function_count",
        "code_lines",
    ]
    return (
        measured.withColumn("risk_reasons", risk_reasons({n: F.col(n) for n in names}))
        .withColumn("risk_level", risk_level(F.col("risk_reasons")))
        .drop("lines", "functions", "by_name")
    )


METRIC_COLUMNS = [
    "total_lines",
    "code_lines",
    "blank_lines",
    "comment_lines",
    "function_count",
    "class_count",
    "loop_count",
    "condition_count",
    "variable_count",
    "max_nesting_depth",
    "cyclomatic_complexity",
    "avg_function_length",
    "max_function_length",
    "maintainability_index",
    "per_function_complexity",
    "per_function_length",
    "language",
    "risk_level",
    "risk_reasons",
]


def file_metrics(files: DataFrame) -> DataFrame:
    """One metrics row per file that parses."""
    parsed = with_nodes(files).where("nodes IS NOT NULL")
    return add_file_metrics(parsed).select("file_id", *METRIC_COLUMNS)


def function_breakdown(files: DataFrame) -> DataFrame:
    """Per file and function name: complexity and length, the last definition of a name wins."""
    parsed = with_nodes(files).where("nodes IS NOT NULL")
    last = S.last_of_each(function_metrics(F.col("nodes")), "name")
    return parsed.select("file_id", F.inline(last)).select(
        "file_id", F.col("name").alias("function_name"), "cyclomatic_complexity", "length"
    )
