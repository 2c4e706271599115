"""Expressions over a file's node array.

Every file carries its own nodes in pre-order, so "inside" is a slice and no containment join
or shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef", "function_def")
LOOP_KINDS = ("For", "While")


def node(nodes: Column, position: Column) -> Column:
    return F.element_at(nodes, position + 1)


def between(nodes: Column, first: Column, last: Column) -> Column:
    return F.slice(nodes, first + 1, F.greatest(last - first + 1, F.lit(0)))


def subtree(nodes: Column, root: Column) -> Column:
    return between(nodes, root["pre"], root["last"])


def body(nodes: Column, loop: Column) -> Column:
    return between(nodes, loop["body_first"], loop["body_last"])


def of_kind(nodes: Column, *kinds: str) -> Column:
    return F.filter(nodes, lambda n: n["kind"].isin(*kinds))


def count_if(nodes: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(nodes, test))


def sum_of(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0), lambda total, x: total + value(x))


def functions(nodes: Column) -> Column:
    return of_kind(nodes, *FUNCTION_KINDS)


def breadth_first(items: Column) -> Column:
    """Items that start with (depth, pre) in breadth-first order."""
    return F.array_sort(items)


def unnest(df: DataFrame, keep: list[str], items: str, position: str) -> DataFrame:
    """One row per element of an array-of-structs column, with its position.

    The outer form is used and empty rows are dropped afterwards: from the inner form the
    optimizer infers a test of the array's size and pushes it below the projection that
    computes the array, which would then be computed again, within its own lambdas too.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, "_item"))
    return rows.where(F.col(position).isNotNull()).select(*keep, position, "_item.*")
