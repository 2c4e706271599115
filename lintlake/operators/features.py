"""Feature vectors of code snippets, their validity and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions import nodes as N
from lintlake.functions import text as X
from lintlake.functions.ranks import exact_quantiles, quantile_map, quantile_of, with_scan_index
from lintlake.operators import metrics as M
from lintlake.operators import structure as S
from lintlake.operators.parse import with_nodes
from lintlake.schemas import FEATURES

NOT_FEATURES = ("id", "target")


def comment_ratio(code: Column) -> Column:
    """Share of lines that start with ``#`` or ``//``, whatever the language."""
    blank_in_line = X.SPACE.replace(r"\t-\r", r"\t\x0b-\r")
    starts = rf"(?md)^[{blank_in_line}]*(#|//)"
    return F.regexp_count(code, F.lit(starts)) / X.line_count(code)


def lexical_columns(code: Column) -> dict[str, Column]:
    return {"line_count": X.line_count(code), "comment_ratio": comment_ratio(code)}


def text_columns(code: Column, function_count: Column) -> dict[str, Column]:
    def halves(quote: str) -> Column:
        return F.floor(X.count_of(code, quote) / 2).cast("int")

    return {
        "has_recursion": (code.contains("return") & (function_count > 0)).cast("int"),
        "import_count": X.count_of(code, "import ") + X.count_of(code, "from "),
        "operator_count": X.count_chars(code, "+-*/><")
        + X.count_of(code, "==")
        + X.count_of(code, "!="),
        "string_literal_count": halves('"') + halves("'"),
        "numeric_literal_count": X.digit_words(code),
    }


def rough_columns(code: Column) -> dict[str, Column]:
    """Structure guessed from substrings, for text that is not parsed."""

    def count(*pieces: str) -> Column:
        total = F.lit(0)
        for piece in pieces:
            total = total + X.count_of(code, piece)
        return total

    indent = F.transform(
        X.lines(code), lambda row: F.length(row) - F.length(F.regexp_replace(row, rf"^[{X.SPACE}]+", ""))
    )
    return {
        "loop_count": count("for ", "while "),
        "condition_count": count("if ", "elif "),
        "function_count": count("def ", "function "),
        "avg_function_length": F.lit(0.0),
        "max_nesting_depth": F.floor(F.array_max(indent) / 4).cast("int"),
        "cyclomatic_complexity": count("if ", "for ", "while ") + 1,
        "variable_count": F.lit(0),
    }


def structural_columns(nodes: Column) -> dict[str, Column]:
    """Structure from the nodes; loops, conditions and variables of brace languages stay 0."""
    lengths = F.transform(
        N.functions(nodes),
        lambda f: F.struct(F.greatest(f["end_lineno"] - f["lineno"] + 1, F.lit(1)).alias("length")),
    )
    return {
        "loop_count": N.count_if(nodes, lambda n: n["kind"].isin(*N.LOOP_KINDS)),
        "condition_count": N.count_if(nodes, lambda n: n["kind"] == "If"),
        "function_count": F.size(N.functions(nodes)),
        "avg_function_length": M.average_length(lengths),
        "max_nesting_depth": S.max_nesting(nodes),
        "cyclomatic_complexity": M.cyclomatic_complexity(nodes),
        "variable_count": N.count_if(
            S.variable_structs(nodes), lambda v: F.lit(True)
        ),
    }


def _row(source: DataFrame, structure: dict[str, Column], failed: Column) -> DataFrame:
    """Blank code gives zeros and an error; a failed parse keeps the lexical part only."""
    code = F.coalesce("code", F.lit(""))
    blank = X.is_blank(code)
    kinds = {"avg_function_length": "double", "comment_ratio": "double"}

    def unless(stop: Column, value: Column, name: str) -> Column:
        return F.when(stop, 0).otherwise(F.coalesce(value, F.lit(0))).cast(kinds.get(name, "int"))

    counted = source.withColumns(
        {name: unless(blank | failed, value, name) for name, value in structure.items()}
    )
    lexical = {n: unless(blank, v, n) for n, v in lexical_columns(code).items()}
    text = {
        n: unless(blank | failed, v, n)
        for n, v in text_columns(code, F.col("function_count")).items()
    }
    return counted.withColumns({**lexical, **text, "error": blank | failed})


def extract_features(samples: DataFrame) -> DataFrame:
    """The fourteen features of each snippet (``id``, ``code``, optional ``target``).

    One pass over the rows: parse, then expressions on the row; nothing is shuffled.
    """
    language = F.coalesce("language", F.lit("python")) if "language" in samples.columns else F.lit("python")
    ready = samples.withColumn("language", language)
    parsed = with_nodes(ready)
    structure = structural_columns(F.col("nodes"))
    # Brace languages report functions, nesting and complexity only.
    structure["variable_count"] = F.when(
        M.clean_language(F.col("language")) == "python", structure["variable_count"]
    ).otherwise(0)
    rows = _row(parsed, structure, F.col("nodes").isNull())
    keep = ["target"] if "target" in samples.columns else []
    return rows.select("id", *FEATURES, "error", *keep)


def extract_rough_features(samples: DataFrame) -> DataFrame:
    """Text-only features, without a parser: stays in the JVM."""
    code = F.coalesce("code", F.lit(""))
    rows = _row(samples, rough_columns(code), F.lit(False))
    keep = ["target"] if "target" in samples.columns else []
    return rows.select("id", *FEATURES, "error", *keep)


def with_position_ids(samples: DataFrame) -> DataFrame:
    """Fill a missing ``id`` with the zero-based scan position of the sample."""
    given = F.col("id").cast("string") if "id" in samples.columns else F.lit(None).cast("string")
    return (
        with_scan_index(samples, "position")
        .withColumn("id", F.coalesce(given, F.col("position").cast("string")))
        .drop("position")
    )


def is_valid(error: Column, line_count: Column) -> Column:
    return ~error & (line_count != 0)


def valid_features(features: DataFrame) -> DataFrame:
    return features.where(is_valid(F.col("error"), F.col("line_count")))


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def clean_features(features: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Drop failed rows, fill nulls with 0 and clip every feature at its upper quantile.

    The quantiles are exact: counts per distinct value are ranked, never whole columns. The
    table is read twice, so pass a stored one rather than a fresh extraction.
    """
    kept = features
    if "error" in features.columns:
        kept = features.where("NOT error").drop("error")
    filled = kept.fillna(0)
    names = numeric_columns(filled)
    limits = quantile_map(exact_quantiles(filled, names, [quantile]))
    clipped = {
        n: F.least(F.col(n).cast("double"), quantile_of(F.col("_limits"), n, quantile)) for n in names
    }
    return filled.withColumn("_limits", limits).withColumns(clipped).drop("_limits")
