"""Joins with keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is salted if it has more than 1/HOT_SHARE of the rows.
HOT_SHARE = 1_000


def salted_join(rows: DataFrame, known: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``keys`` with ``known``, which has one row per key and, in ``n``, how many rows the
    key has. Rows of a key with over a thousandth of all rows are dealt to as many salts as thousandths, and
    what is known of it is repeated for each (under 2,000 rows more), so that no task gets them all. ``n`` is
    not among the columns of the result."""
    total = known.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    salts = F.ceil(F.col(n) * HOT_SHARE / F.lit(max(total, 1))).cast("int")
    hot = known.where(is_hot).select(*[F.col(k).alias(f"_{k}") for k in keys], salts.alias("_salts"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    tagged = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(hot), same, "left")
    salt = F.pmod(F.xxhash64("_row"), F.coalesce("_salts", F.lit(1))).cast("int")
    tagged = tagged.withColumn("_salt", salt).drop("_salts", "_row", *[f"_{k}" for k in keys])
    each = F.when(is_hot, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return tagged.join(known.withColumn("_salt", F.explode(each)).drop(n), [*keys, "_salt"], how).drop("_salt")
