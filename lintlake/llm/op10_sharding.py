"""Sharding by sampled splitters: near-equal bytes per shard, equal texts together.

1. Draw a size-weighted sample of sort keys (64-bit hashes of the text) of bounded expected size.
2. Its quantiles are the boundaries of ``ranges`` key ranges, many more than shards.
3. Ranges that came out overfull are subdivided: by a second hash of the text, so that equal texts
   stay together, and a text whose copies alone outweigh a whole shard by the place of the row.
4. The measured ranges (their number is bounded by parameters) are dealt to shards, largest first to
   the lightest shard. A range of too many rows (many copies of a short text) stays in its shard but is
   cut into pieces by the place of the row, so that no task sorts it whole. A row's slot is its piece's
   offset plus its position in the piece.

Only the sample and the range sizes reach the driver. The work after the first pass is on narrow rows.

Defined results: null text has size 1 and no text bytes; rows that repeat each other get slots of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import scalar_row, stored

#: Shards, key ranges per shard, and sampled keys per range (expected).
SHARDS, RANGES, SAMPLED = 16, 64, 32
SEED = 42


def sort_key(text: Column) -> Column:
    """The upper 52 bits of the text's hash: exact as a double."""
    return F.shiftrightunsigned(F.xxhash64(text), 12).cast("double")


def splitters(rows: DataFrame, total: int, ranges: int, sampled: int) -> list[float]:
    """Boundaries of the ranges: quantiles of a sample in which a row is drawn with a probability in
    proportion to its size, at most 2 * ranges * sampled rows on average."""
    chance = F.col("size") * (ranges * sampled) / F.lit(max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sorted(r.key for r in rows.where(drawn < chance).select("key").collect())
    cuts = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return [float("-inf"), *sorted(cuts), float("inf")]


def deal(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Range to shard: largest first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    heapify(heap)
    placed = {}
    for size, r in sorted(((size, r) for r, size in sizes), reverse=True):
        load, shard = heap[0]
        heapreplace(heap, (load + size, shard))
        placed[r] = shard
    return placed


def shard(docs: DataFrame, shards=SHARDS, ranges=RANGES, sampled=SAMPLED, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ranges *= shards
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(text).alias("key"),
        ),
        "rows-to-shard",
    )
    # The place of a row in the stored table (part and row): unlike its id, never null or repeated.
    place = F.xxhash64(F.lit(SEED), F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index")
    rows = rows.withColumn("_place", place)
    total = scalar_row(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))).n
    cuts = splitters(rows, total, ranges, sampled)
    placed = Bucketizer(splits=cuts, inputCol="key", outputCol="_range").transform(rows) if len(cuts) > 2 else rows.withColumn("_range", F.lit(0.0))
    placed = placed.withColumn("_range", F.col("_range").cast("int"))

    # Texts that outweigh a shard (fewer than there are shards) and the weight of each range: both
    # tables have a proven size, so they are broadcast.
    mean = max(total / ranges, 1)
    heavy = placed.groupBy("key").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") * shards > total)
    heavy = heavy.select("key", F.ceil(F.col("_bytes") / mean).cast("int").alias("_by_id"))
    bytes_of = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    full = bytes_of.select("_range", F.greatest(F.lit(1), F.ceil(F.col("_bytes") / (2 * mean))).cast("int").alias("_by_text"))
    by_id = F.pmod("_place", F.coalesce("_by_id", F.lit(1)))
    by_text = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.coalesce("_by_text", F.lit(1)))
    placed = (
        placed.join(F.broadcast(heavy), "key", "left").join(F.broadcast(full), "_range", "left")
        .withColumn("_part", F.struct("_range", by_text.alias("t"), (F.col("_by_id").isNotNull()).alias("h"), by_id.alias("i")))
        .select("doc_id", "size", "text_crc32", "key", "_part", "_place")
    )
    measured = placed.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("_part").collect()
    home = deal([(i, m.bytes) for i, m in enumerate(measured)], shards)
    part = placed.schema["_part"].dataType.simpleString()
    # Pieces of equal rows, twice the mean range at most: fewer than there are ranges, beside one for each part.
    most = max(1, -(-2 * sum(m.rows for m in measured) // ranges))
    pieces = spark.createDataFrame([(m["_part"], -(-m.rows // most)) for m in measured], f"_part {part}, _pieces int")
    cut = F.pmod(F.xxhash64("_place"), F.col("_pieces")).cast("int").alias("_piece")
    placed = placed.join(F.broadcast(pieces), "_part").select("doc_id", "size", "text_crc32", "key", "_part", cut)
    counts = placed.groupBy("_part", "_piece").agg(F.count("*").alias("rows")).orderBy("_part", "_piece").collect()
    number = {m["_part"]: i for i, m in enumerate(measured)}
    taken, plan = [0] * shards, []
    for c in counts:
        to = home[number[c["_part"]]]
        plan.append((c["_part"], c["_piece"], to, taken[to]))
        taken[to] += c.rows
    known = spark.createDataFrame(plan, f"_part {part}, _piece int, shard int, _start bigint")
    inside = Window.partitionBy("_part", "_piece").orderBy("key", "doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(known), ["_part", "_piece"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_start") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
