"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources take the weights of the pattern in the order of their names; what a source cannot
give (``most`` times its size) is shared again by weight until no target is above its cap.

Draw: every document gets the key -ln(u) / w, u a hash of its id and text and w its quality weight, so a sort
by key is a weighted draw without replacement. Complete epochs of the source come first; what is left
of the target is filled in key order by a prefix sum. The prefix sum is taken in two steps: keys are
cut into ``CELLS`` cells, the cells of a source are summed and prefix-summed, and only the one cell
in which the budget ends is sorted row by row, so that a source with a third of all rows is spread
over all tasks.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, the
last; null ids, and rows that repeat an id, are drawn by their texts; rows that repeat id and text have one
key and are drawn one by one in any order, which gives the same rows; an
empty table gives no rows; sources without words have target 0; other columns are carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import WORD, scalar_row, stored

#: Weights of the sources in order, repeating; the mix's size over that of all documents; the most
#: often that a source is repeated.
PATTERN, SHARE, MOST = (5, 2, 1), 1.5, 2
CELLS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """0.05 to 1: one minus the share of characters that are neither letters nor ordinary in prose."""
    odd = F.length(F.translate(text, "#$%&*|<>{}[]=+\\^~_@!", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.try_divide(odd, F.length(text)).cast("double")), F.lit(0.05))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the md5 of the id and of the text, so that rows without an id, or that
    repeat one, are drawn each for itself."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("#"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(own.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_weights(sizes: DataFrame, pattern) -> DataFrame:
    """Add the weight of each source by its place in code point order, null last.

    Places are counted in ranges of names, so there is no task that holds all sources."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        sizes.repartitionByRange(n, F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()), "sources"
    )
    starts, count = [], 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], count))
        count += r["count"]
    inside = Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))
    if not starts:
        return placed.select("source", "source_size", F.lit(0).alias("weight"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("_part"))
    place = start + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in pattern]), (place % len(pattern) + 1).cast("int"))
    return stored(placed.select("source", "source_size", weight.alias("weight")), "weights")


def targets(sizes: DataFrame, pattern=PATTERN, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size). A pass sums the sources that are under
    their cap; only sums reach the driver, and each pass but the last caps at least one source."""
    weighed = with_weights(sizes, pattern)
    cap = F.col("source_size") * float(most)
    budget = None
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * level < cap
        sums = scalar_row(
            weighed.agg(
                F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
                F.coalesce(F.sum(F.when(~free, cap)), F.lit(0.0)).alias("capped"),
                F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("weight"),
            )
        )
        budget = share * sums["all"]
        new = (budget - sums["capped"]) / sums["weight"] if sums["weight"] else level or 0.0
        if new == level or not sums["weight"]:
            break
        level = new
    return weighed.select("source", "source_size", F.least(F.col("weight") * (level or 0.0), cap).alias("target"))


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
    pattern=PATTERN, share=SHARE, most=MOST, cut_last=True, carry=True,
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted),
    as columns doc_id, size, source_size, target, taken and, with ``carry``, the whole row as ``row``.

    ``cut_last``: the document in which a source's budget ends is taken in part, to the word. Otherwise
    it is taken whole if that brings the source nearer to its target."""
    text = docs[text_col].cast("string")
    ends = -F.log(uniform(docs[id_col], text)) / quality_weight(text)
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size_of(text).alias("size"), ends.alias("key"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    # exp(-key) is in (0, 1); low cells are drawn first.
    rows = rows.withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * CELLS).cast("int"))
    if not carry:
        rows = stored(rows, "rows-to-mix")
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("bulk")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("bulk").alias("source_size")), pattern, share, most)
    aims = aims.withColumnRenamed("source", "_source")
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        cells.withColumn("ahead", F.coalesce(F.sum("bulk").over(earlier), F.lit(0)))
        .join(aims, F.col("source").eqNullSafe(F.col("_source")))
        .select("_source", F.col("cell").alias("_cell"), "bulk", "ahead", "source_size", "target", epochs.cast("long").alias("epochs"))
        .withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("ends", (F.col("ahead") < F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("bulk")))
    )
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    left = F.col("rest") - F.col("before")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left)) if cut_last else F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    sorted_cell = found.where("ends").withColumn("before", before).withColumn("drawn", last.cast("long")).drop("before")
    others = found.where("NOT ends").withColumn(
        "drawn", F.when(F.col("ahead") < F.col("rest"), F.col("size")).otherwise(0).cast("long")
    )
    taken = F.col("epochs") * F.col("size") + F.col("drawn")
    return sorted_cell.unionByName(others).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else [])
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, of whole documents: each row as often as it is taken, with its own columns."""
    drawn = mix(docs, cut_last=False, **options).where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return drawn.select("row", F.explode(times)).select("row.*")
