"""Stored reports: loads, a compacted base sliced by id, and a table of deletions, merged on read.

Layout of a store at ``path``:

- ``load_id=<load>/language=<language>/``: a load as it was appended, sorted by id inside its files, with a
  Bloom filter on the id, so that a search for one id reads no row group that lacks it.
- ``_base/<name>/slice=<n>/``: all loads up to a compaction, dealt to slices by a hash of the id and
  sorted inside them. An id lies in one slice, so a search reads that slice's files, however many loads
  there were. The rows keep their ``load_id``.
- ``_deleted/<batch>/``: (id, load_id) of deleted reports. Reports are anti-joined with them on read.
- ``_snapshots/<version>/``: what a compaction has taken in: its base, the loads and the deletions. A store
  is read by its latest complete snapshot; what that does not name is read beside the base.

Nothing is rewritten in place. A compaction that breaks off leaves files that no snapshot names; one that
ended without clearing leaves loads that the snapshot says are in the base. ``clear`` removes what the
latest snapshot has made superfluous, and only that. A load that is written again after a compaction took it
in is a repetition and is ignored; a report that was deleted stays deleted when its load is repeated, and is
seen again when another load brings it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.schemas import REPORT, STORED_REPORT

#: Reports of a slice, about; waiting loads from which ``compact_when_due`` compacts.
SLICE_ROWS, DUE_LOADS = 1_000_000, 32
DELETED = T.StructType([T.StructField("id", T.StringType()), T.StructField("load_id", T.StringType())])
PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])
BASE = T.StructType([*STORED_REPORT.fields, T.StructField("slice", T.IntegerType())])


def bloom(writer):
    """Parquet options of a writer for searches by id."""
    return writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")


def escaped(spark: SparkSession, value: str) -> str:
    """A value as it stands in the name of a partition folder."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path; none if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Snapshot:
    """What the latest compaction has taken in."""

    version: int = 0
    base: str = ""
    slices: int = 0
    loads: frozenset = field(default_factory=frozenset)
    deletions: frozenset = field(default_factory=frozenset)


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The newest snapshot whose write was completed; version 0 if there is none."""
    for version in sorted((int(v) for v in folders(spark, f"{path}/_snapshots") if v.isdigit()), reverse=True):
        parts = spark.read.schema(PART).parquet(f"{path}/_snapshots/{version}").collect()
        slices = [int(p.name) for p in parts if p.kind == "slices"]
        if slices:
            named = {kind: frozenset(p.name for p in parts if p.kind == kind) for kind in ("base", "load", "deletion")}
            return Snapshot(version, *named["base"], slices[0], named["load"], named["deletion"])
    return Snapshot()


def waiting_loads(spark: SparkSession, path: str, snapshot: Snapshot) -> list[str]:
    """Folder names of the loads that are not in the base."""
    return [f for f in folders(spark, path) if f.startswith("load_id=") and f not in snapshot.loads]


def slice_of(report_id: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(report_id), F.lit(max(slices, 1))).cast("int")


def _live(spark: SparkSession, path: str, snapshot: Snapshot, waiting: list[str], report_id: str | None = None) -> DataFrame:
    """Reports of the base and of the waiting loads, without the deleted ones."""
    names = STORED_REPORT.fieldNames()
    rows = spark.createDataFrame([], STORED_REPORT)
    if waiting:
        loads = spark.read.schema(STORED_REPORT).option("basePath", path)
        # All loads are read as one folder while there is no base to tell them from.
        rows = loads.parquet(*([f"{path}/{w}" for w in waiting] if snapshot.version else [path]))
    if snapshot.version:
        base = spark.read.schema(BASE).parquet(f"{path}/_base/{snapshot.base}")
        if report_id is not None:
            base = base.where(F.col("slice") == slice_of(F.lit(report_id), snapshot.slices))
        rows = rows.select(*names).unionByName(base.select(*names)) if waiting else base.select(*names)
    batches = [f"{path}/_deleted/{b}" for b in folders(spark, f"{path}/_deleted") if b not in snapshot.deletions]
    if batches:
        gone = spark.read.schema(DELETED).parquet(*batches)
        rows = rows.join(gone, ["id", "load_id"], "left_anti").select(*names)
    return rows if report_id is None else rows.where(F.col("id") == report_id)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All reports of a store that were not deleted."""
    path = path.rstrip("/")
    snapshot = latest(spark, path)
    return _live(spark, path, snapshot, waiting_loads(spark, path, snapshot))


def find_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """The report with the id, from the one slice that can hold it and the row groups of the waiting loads
    whose Bloom filter lets it pass; no row when there is none."""
    path = path.rstrip("/")
    snapshot = latest(spark, path)
    return _live(spark, path, snapshot, waiting_loads(spark, path, snapshot), report_id)


def append_reports(reports: DataFrame, path: str, load_id: str) -> None:
    """Add a load of reports. Writing the same load again replaces it, so a repeated batch leaves no
    duplicates."""
    spark = reports.sparkSession
    rows = reports.select(*REPORT.fieldNames()).sortWithinPartitions("language", "id")
    writer = bloom(rows.write.mode("overwrite").partitionBy("language"))
    writer.parquet(f"{path.rstrip('/')}/load_id={escaped(spark, load_id)}")


def delete_reports(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete the reports with the ids of a table from every load that holds them; how many there were.

    One job finds them and writes their names down, whatever the number of loads; no report is rewritten."""
    path = path.rstrip("/")
    batch = f"{path}/_deleted/{uuid.uuid4().hex}"
    held = read_reports(spark, path).select("id", "load_id")
    held.join(ids.select("id").distinct(), "id", "left_semi").write.parquet(batch)
    return spark.read.schema(DELETED).parquet(batch).count()


def delete_report(spark: SparkSession, path: str, report_id: str) -> bool:
    """Delete one report from every load; false when it does not exist."""
    path = path.rstrip("/")
    found = find_report(spark, path, report_id).select("id", "load_id").collect()
    if found:
        spark.createDataFrame(found, DELETED).coalesce(1).write.parquet(f"{path}/_deleted/{uuid.uuid4().hex}")
    return bool(found)


def compact(spark: SparkSession, path: str, slice_rows: int = SLICE_ROWS) -> int:
    """Take all waiting loads and deletions into a new base, and publish it; its version.

    The base is complete before the snapshot names it, and the snapshot is one file. Two compactions at a
    time cannot both publish: the second finds its version taken and fails."""
    path = path.rstrip("/")
    before = latest(spark, path)
    waiting = waiting_loads(spark, path, before)
    deletions = folders(spark, f"{path}/_deleted")
    rows = _live(spark, path, before, waiting)
    version = before.version + 1
    base = uuid.uuid4().hex
    slices = max(1, -(-rows.count() // slice_rows))
    dealt = rows.withColumn("slice", slice_of(F.col("id"), slices)).hint("rebalance", "slice").sortWithinPartitions("slice", "id")
    bloom(dealt.write.mode("overwrite").partitionBy("slice")).parquet(f"{path}/_base/{base}")
    parts = [("slices", str(slices)), ("base", base), *(("load", x) for x in {*before.loads, *waiting}), *(("deletion", x) for x in deletions)]
    spark.createDataFrame(parts, PART).coalesce(1).write.parquet(f"{path}/_snapshots/{version}")
    return version


def clear(spark: SparkSession, path: str) -> None:
    """Remove the loads, deletions, bases and snapshots that the latest snapshot has made superfluous. Not to
    be run while jobs still read an earlier state of the store."""
    path = path.rstrip("/")
    snapshot = latest(spark, path)
    if not snapshot.version:
        return
    old = [f"{path}/{x}" for x in folders(spark, path) if x in snapshot.loads]
    old += [f"{path}/_deleted/{x}" for x in folders(spark, f"{path}/_deleted") if x in snapshot.deletions]
    old += [f"{path}/_base/{x}" for x in folders(spark, f"{path}/_base") if x != snapshot.base]
    old += [f"{path}/_snapshots/{x}" for x in folders(spark, f"{path}/_snapshots") if x.isdigit() and int(x) < snapshot.version]
    for x in old:
        remove(spark, x)


def compact_when_due(spark: SparkSession, path: str, loads: int = DUE_LOADS) -> bool:
    """Compact a store that has so many waiting loads; whether it had."""
    path = path.rstrip("/")
    due = len(waiting_loads(spark, path, latest(spark, path))) >= loads
    if due:
        compact(spark, path)
    return due
