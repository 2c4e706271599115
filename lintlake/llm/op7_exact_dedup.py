"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest: one row per distinct text. A batch of documents
is counted per digest (partial aggregation, so copies do not travel), anti-joined with the index by
sort-merge on the bucket key, and the digests that are new are appended. Every document then looks
its digest up in the index. Groups that hold over a thousandth of the batch (at most 1,000 of them,
so their table has a proven size) are looked up by broadcast; what is left for the join has no group
larger than that.

Defined results: null text counts as empty; a null id ranks below every other; of rows that repeat
both id and text one is kept; an empty batch adds nothing and returns no rows; other columns are
ignored by ``decisions`` and carried by ``survivors``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import scalar_row
from lintlake.session import shared_dir, stored

#: A group is looked up by broadcast if it holds more than 1/HOT_SHARE of the batch.
HOT_SHARE = 1_000


@dataclass(frozen=True)
class DigestIndex:
    """A table (digest, keep_id, group_size, batch) in ``buckets`` buckets sorted by digest."""

    spark: SparkSession
    table: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, table: str, path: str, buckets: int | None = None, id_type: str = "bigint"):
        """Register the index kept at ``path``, or an empty one. By default it has as many buckets as the
        session has shuffle partitions: then the rows of a bucket come from one task."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id {id_type}, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, table, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode(
            "append"
        ).saveAsTable(self.table)


def digest(text: Column, normalise=lambda c: c) -> Column:
    """SHA-256 of the text in UTF-8, lowercase hex."""
    return F.sha2(normalise(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def add_batch(docs: DataFrame, index: DigestIndex, batch: str, id_col="doc_id", text_col="text") -> None:
    """Append the texts of a batch that the index lacks. A batch that is already in is not added twice,
    so a job that broke off after this step may be run again."""
    if index.rows().where(F.col("batch") == batch).limit(1).count():
        return
    # Written down, because the optimizer would move the anti-join below the aggregate, and all copies
    # would be shuffled instead of one row for each text and task.
    counted = stored(
        docs.select(docs[id_col].alias("id"), digest(docs[text_col]).alias("digest"))
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
        "counted-digests",
    )
    fresh = counted.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")))


def looked_up(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (with a column ``_digest``) with the index's _keep, _size and _batch beside them."""
    known = index.rows().select(
        F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"),
        F.col("group_size").alias("_size"), F.col("batch").alias("_batch"),
    )
    total = scalar_row(known.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n"))).n
    hot = F.col("_size") * HOT_SHARE > total
    facts = ["_keep", "_size", "_batch"]
    large = known.where(hot).select("_digest", F.struct(*facts).alias("_hot"))
    tagged = rows.join(F.broadcast(large), "_digest", "left")
    rest = (
        tagged.where("_hot IS NULL").drop("_hot")
        .join(known.where(~hot).hint("merge"), "_digest")
    )
    return tagged.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*").unionByName(rest)


def decisions(docs: DataFrame, index: DigestIndex, batch: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A text that an earlier batch brought is not kept, and keep_id is that batch's row."""
    add_batch(docs, index, batch, id_col, text_col)
    copies = (
        docs.select(docs[id_col].alias("doc_id"), digest(docs[text_col]).alias("_digest"))
        .groupBy("_digest", "doc_id").agg(F.count("*").alias("_copies"))
    )
    found = looked_up(copies, index).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1) & (F.col("_batch") == batch)
    return found.select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        kept.alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame, index: DigestIndex, batch: str, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay, with all their columns: one for each text the index did not have."""
    add_batch(docs, index, batch, id_col, text_col)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), digest(docs[text_col]).alias("_digest"))
    mine = F.col(f"_row.{id_col}").eqNullSafe(F.col("_keep")) & (F.col("_batch") == batch)
    # Only rows that repeat the kept id and text are left to drop here.
    return looked_up(whole, index).where(mine).dropDuplicates(["_digest"]).select("_row.*")


def new_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    """An empty index in the shared folder."""
    path = shared_dir(spark, "digests")
    return DigestIndex.open(spark, "lintlake_digests_" + path.rsplit("-", 1)[1], path, id_type=id_type)
