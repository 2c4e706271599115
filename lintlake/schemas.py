"""Column contracts shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# A table of source files: one row per file or labelled snippet.
CODE = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("project", T.StringType()),
        T.StructField("commit_id", T.StringType()),
    ]
)

# One syntax node. A file's nodes form an array in pre-order, so the subtree of a node is the
# contiguous slice [pre, last]; breadth-first order is the order of (depth, pre).
NODE = T.StructType(
    [
        T.StructField("pre", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        # function, class, loop target, called plain name or declared variable
        T.StructField("name", T.StringType()),
        # called attribute, or the keyword of a brace-language construct
        T.StructField("attr", T.StringType()),
        # x in x.attr()
        T.StructField("base", T.StringType()),
        # operator of the assigned expression, or kind of an if test
        T.StructField("op", T.StringType()),
        # numeric constant on the right of the assignment
        T.StructField("num", T.DoubleType()),
        # parameters of a function, branches of an if, values - 1 of a BoolOp, ifs of a comprehension
        T.StructField("n", T.IntegerType()),
        # decorators of a function, or every name bound by an assignment
        T.StructField("names", T.ArrayType(T.StringType())),
        # names that are targets of an assignment themselves, not inside a tuple or list
        T.StructField("direct", T.ArrayType(T.StringType())),
        # docstring, annotation, or body text of a brace-language function
        T.StructField("text", T.StringType()),
        # name of the innermost enclosing function
        T.StructField("scope", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("end_lineno", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        # control-flow blocks around and including this node
        T.StructField("nest", T.IntegerType()),
        # loops only: enclosing loops and itself, outermost first
        T.StructField("loop_path", T.ArrayType(T.IntegerType())),
        # loops only: slice of the body, and loops inside it
        T.StructField("body_first", T.IntegerType()),
        T.StructField("body_last", T.IntegerType()),
        T.StructField("body_loops", T.IntegerType()),
        # functions only: functions in the subtree, itself included
        T.StructField("n_fns", T.IntegerType()),
    ]
)

PARSED = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODE)),
    ]
)

COMPLEXITY_ITEM = T.StructType(
    [
        T.StructField("function_name", T.StringType()),
        T.StructField("complexity_class", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
SECURITY_ITEM = T.StructType(
    [
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("cwe_id", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("remediation", T.StringType()),
    ]
)
METRICS_ITEM = T.StructType(
    [
        T.StructField("function_count", T.IntegerType()),
        T.StructField("max_nesting_depth", T.IntegerType()),
        T.StructField("total_lines", T.IntegerType()),
        T.StructField("avg_function_length", T.DoubleType()),
        T.StructField("cyclomatic_complexity", T.IntegerType()),
    ]
)

# The stored report table, partitioned by load and language.
REPORT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("code_hash", T.StringType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("bug_probability", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("complexity", T.ArrayType(COMPLEXITY_ITEM)),
        T.StructField("security_issues", T.ArrayType(SECURITY_ITEM)),
        T.StructField("metrics", METRICS_ITEM),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("language", T.StringType()),
    ]
)
STORED_REPORT = T.StructType([*REPORT.fields, T.StructField("load_id", T.StringType())])

LABELLED_CODE = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("commit_id", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("func", T.StringType()),
    ]
)

SUBMISSIONS = T.StructType(
    [
        T.StructField("submission_id", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

# The fourteen model inputs, in order.
FEATURES = [
    "loop_count",
    "condition_count",
    "function_count",
    "avg_function_length",
    "max_nesting_depth",
    "cyclomatic_complexity",
    "line_count",
    "comment_ratio",
    "import_count",
    "variable_count",
    "has_recursion",
    "string_literal_count",
    "numeric_literal_count",
    "operator_count",
]
