"""Structure of a file: walk order, functions, loops, conditions, variables, nesting, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import nodes as N

BRACE_KINDS = ("function_def", "loop", "condition", "variable")


def walk(parsed: DataFrame) -> DataFrame:
    """One row per node; (file_id, pre) is depth-first order."""
    return parsed.select("file_id", F.inline("nodes"))


def function_structs(nodes: Column) -> Column:
    """Functions in breadth-first order."""

    def describe(f: Column) -> Column:
        parent = N.node(nodes, f["parent"])
        return F.struct(
            f["depth"],
            f["pre"],
            f["name"],
            f["lineno"].alias("start_line"),
            f["end_lineno"].alias("end_line"),
            f["n"].alias("parameter_count"),
            (f["end_lineno"] - f["lineno"]).alias("body_line_count"),
            F.greatest(f["end_lineno"] - f["lineno"] + 1, F.lit(1)).alias("length"),
            f["names"].alias("decorators"),
            F.coalesce(
                (parent["kind"] == "ClassDef") & (parent["depth"] == f["depth"] - 1), F.lit(False)
            ).alias("is_method"),
            F.when(f["kind"] != "function_def", f["text"]).alias("docstring"),
            F.when(f["kind"] == "function_def", f["text"]).otherwise("").alias("body_text"),
        )

    return N.breadth_first(F.transform(N.functions(nodes), describe))


def loop_structs(nodes: Column) -> Column:
    return F.transform(
        N.of_kind(nodes, *N.LOOP_KINDS, "loop"),
        lambda n: F.struct(
            n["pre"],
            F.when(n["kind"] == "loop", n["attr"]).otherwise(F.lower(n["kind"])).alias("keyword"),
            n["lineno"].alias("start_line"),
            n["end_lineno"].alias("end_line"),
            F.size(n["loop_path"]).alias("nesting_depth"),
            n["scope"].alias("parent_function"),
            F.when(n["kind"] == "For", n["name"]).otherwise("").alias("iteration_target"),
        ),
    )


def condition_structs(nodes: Column) -> Column:
    """``if`` statements in breadth-first order; an ``elif`` is a row of its own."""
    return N.breadth_first(
        F.transform(
            N.of_kind(nodes, "If", "condition"),
            lambda n: F.struct(
                n["depth"],
                n["pre"],
                F.when(n["kind"] == "If", "if").otherwise(n["attr"]).alias("keyword"),
                n["lineno"].alias("start_line"),
                n["end_lineno"].alias("end_line"),
                F.coalesce(n["n"] > 1, F.lit(False)).alias("has_else"),
                F.coalesce(n["n"], F.lit(1)).alias("branch_count"),
                n["scope"].alias("parent_function"),
            ),
        )
    )


def _variable(n: Column, name: Column, ordinal: Column) -> Column:
    return F.struct(
        name.alias("name"),
        n["lineno"].alias("line"),
        n["depth"].alias("depth"),
        n["pre"].alias("pre"),
        ordinal.alias("ordinal"),
        F.when(n["scope"].isNull(), "global").otherwise("local").alias("scope"),
        n["text"].alias("type_annotation"),
        n["scope"].alias("parent_function"),
    )


def variable_structs(nodes: Column) -> Column:
    """Declared names; in Python the first binding of each (name, line) in walk order.

    Sorted by (name, line, walk order), so a repeat is always right behind its first binding.
    """
    bindings = F.flatten(
        F.transform(
            N.of_kind(nodes, "Assign", "AnnAssign"),
            lambda n: F.transform(
                F.coalesce(n["names"], F.array().cast("array<string>")),
                lambda name, i: _variable(n, name, i),
            ),
        )
    )
    declared = F.transform(
        N.of_kind(nodes, "variable"), lambda n: _variable(n, n["name"], F.lit(0))
    )
    return F.concat(first_of_each(F.array_sort(bindings), "name", "line"), declared)


def first_of_each(ordered: Column, *keys: str) -> Column:
    """Keep the first of equal neighbours of a sorted array."""
    from lintlake.functions.text import let

    def keep(items: Column) -> Column:
        def is_first(x: Column, i: Column) -> Column:
            before = F.get(items, i - 1)
            same = before[keys[0]] == x[keys[0]]
            for key in keys[1:]:
                same = same & (before[key] == x[key])
            return F.when(i == 0, True).otherwise(~same)

        return F.filter(items, is_first)

    return let(ordered, keep)


def last_of_each(ordered: Column, key: str) -> Column:
    """Keep the last of equal neighbours of a sorted array."""
    from lintlake.functions.text import let

    return let(
        ordered,
        lambda items: F.filter(
            items,
            lambda x, i: F.when(i == F.size(items) - 1, True).otherwise(
                F.get(items, i + 1)[key] != x[key]
            ),
        ),
    )


def max_nesting(nodes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(nodes, lambda n: n["nest"])), F.lit(0))


def class_count(nodes: Column) -> Column:
    return N.count_if(nodes, lambda n: n["kind"] == "ClassDef")


def _exploded(parsed: DataFrame, structs: Column, *drop: str) -> DataFrame:
    return parsed.select("file_id", F.inline(structs)).drop(*drop)


def functions_table(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, function_structs(F.col("nodes")))


def loops_table(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, loop_structs(F.col("nodes")))


def conditions_table(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, condition_structs(F.col("nodes")))


def variables_table(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, variable_structs(F.col("nodes")), "ordinal")


def nesting_table(parsed: DataFrame) -> DataFrame:
    return parsed.where("nodes IS NOT NULL").select(
        "file_id",
        max_nesting(F.col("nodes")).alias("max_nesting_depth"),
        class_count(F.col("nodes")).alias("class_count"),
    )
