"""Approximate nearest neighbours in groups of bounded size.

Every row is placed by the signs of a few random projections around their medians, in several
independent tables, so that near rows mostly share a cell in one of them. A cell above the group
size is dealt to salted groups; a group is searched by direct differences, so coordinates far from
the origin lose no digits. The work is tables x rows x group size, whatever the number of dimensions
and of copies: copies of a row are rows of their own, and a cell of copies is salted like any other.
Neighbours are approximate: one that shares no group with a row is not found. A cell gets narrower with
every doubling of the rows, so the number of tables grows with the bits of a cell's code, by as much as
keeps nine of ten neighbours found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.session import stored

#: Rows of a group on average; tables of projections at two bits, and their growth per further bit.
GROUP, TABLES, MORE_TABLES = 512, 3, 1.32
SEED = 42


def _projection(x: Column, weights: np.ndarray) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def _search(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest other rows of each row of a group, with their squared distances."""
    x = np.stack(group["x"].to_numpy())
    k = min(k, len(x) - 1)
    if k < 1:
        kinds = {"row": "int64", "distance": "float64", "other": "int64", "y": "object"}
        return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in kinds.items()})
    near, far = [], []
    step = max(1, (4 << 20) // (len(x) * x.shape[1]))  # about 32 MB of differences at a time
    for at in range(0, len(x), step):
        d = ((x[at : at + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        near.append(best)
        far.append(np.take_along_axis(d, best, axis=1))
    near, far = np.concatenate(near), np.concatenate(far)
    return pd.DataFrame(
        {
            "row": np.repeat(group["row"].to_numpy(), k),
            "distance": far.ravel(),
            "other": group["row"].to_numpy()[near.ravel()],
            "y": list(x[near.ravel()]),
        }
    )


def tables_for(bits: int) -> int:
    """Tables that find nine of ten neighbours where cells have codes of so many bits."""
    return math.ceil(TABLES * MORE_TABLES ** max(0, bits - 2))


def grouped(rows: DataFrame, group: int = GROUP, tables: int | None = None) -> DataFrame:
    """(table, cell, salt, row, x): each row once per table, in a group of about ``group`` rows at most."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    bits = max(0, math.ceil(math.log2(max(facts.n, 1) / group)))
    tables = tables or tables_for(bits)
    dice = np.random.default_rng(SEED)
    lines = dice.normal(size=(tables, bits, facts.width or 0))
    values = [[_projection(F.col("x"), w) for w in table] for table in lines]
    flat = [v for table in values for v in table]
    if flat:
        medians = rows.agg(*[F.percentile_approx(v, F.lit(0.5), F.lit(1000)).alias(f"m{i}") for i, v in enumerate(flat)]).first()
    cells = []
    for t in range(tables):
        code = F.lit(0).cast("long")
        for b in range(bits):
            code = code * 2 + (values[t][b] > F.lit(medians[t * bits + b])).cast("long")
        cells.append(F.struct(F.lit(t).alias("table"), code.alias("cell")))
    placed = rows.select("row", "x", F.explode(F.array(*cells)).alias("c")).select("c.table", "c.cell", "row", "x")
    sizes = stored(placed.groupBy("table", "cell").agg(F.count("*").alias("n")), "cells")
    parts = F.ceil(F.col("n") / (2 * group)).cast("long").alias("parts")
    salted = salted_join(placed, sizes.select("table", "cell", "n", parts), ["table", "cell"], "n")
    salt = F.pmod(F.xxhash64(F.lit(SEED), "table", "row"), "parts")
    return salted.select("table", "cell", salt.alias("salt"), "row", "x")


def nearest_neighbours(points: DataFrame, k: int, group: int = GROUP, tables: int | None = None) -> DataFrame:
    """The columns of ``points`` (with ``x``, an array of doubles) and ``neighbours``: up to k arrays,
    nearest first, of other rows; empty for a row that is alone."""
    rows = stored(points.withColumn("row", F.monotonically_increasing_id()), "points")
    found = (
        grouped(rows.select("row", "x"), group, tables)
        .groupBy("table", "cell", "salt")
        .applyInPandas(lambda g: _search(g, k), "row bigint, distance double, other bigint, y array<double>")
    )
    # A pair met in several tables counts once.
    best = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("distance", "other", "y"))).alias("found"))
    distinct = F.slice(F.array_distinct("found"), 1, k)
    return (
        rows.join(best, "row", "left")
        .withColumn("neighbours", F.coalesce(F.transform(distinct, lambda s: s["y"]), F.array().cast("array<array<double>>")))
        .drop("row", "found")
    )
