"""The store of reports: searches, deletions, compactions that break off, and pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from lintlake.plans import analysis, reports
from lintlake.sources import report_store as store
from lintlake.sources import writers


def make(spark, ids, language="python"):
    rows = spark.createDataFrame([(str(i),) for i in ids], "id string")
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in analysis.REPORT.fields if f.name not in ("id", "language", "created_at", "risk_level")]
    at = F.timestamp_seconds(F.expr("coalesce(try_cast(id AS bigint), 0) div 10")).alias("created_at")
    return rows.select("id", *null, at, F.lit("LOW").alias("risk_level"), F.lit(language).cast("string").alias("language"))


def ids(df):
    return sorted(r.id for r in df.collect())


def scanned(df):
    """(files, rows) that the file scans of a run brought up."""
    df.collect()
    files, rows = 0, 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith("Scan parquet"):
            files += node.metrics().apply("numFiles").value()
            rows += node.metrics().apply("numOutputRows").value()
    return files, rows


def fill(spark, path, loads, rows=40):
    for k in range(loads):
        writers.append_reports(make(spark, range(k * rows, (k + 1) * rows)).coalesce(1), path, f"load {k}/a=b%")


def test_find_does_not_grow_with_loads(spark, tmp_path):
    seen, found = [], []
    for loads in (3, 30):
        path = str(tmp_path / f"s{loads}")
        fill(spark, path, loads)
        waiting = scanned(store.find_report(spark, path, "57"))
        store.compact(spark, path, slice_rows=20)
        seen.append((waiting[1], scanned(store.find_report(spark, path, "57"))))
        found.append(ids(store.find_report(spark, path, "57")))
        assert ids(store.find_report(spark, path, "none")) == []
    assert found == [["57"], ["57"]]
    # Waiting loads: the rows of the one row group that holds the id; the base: one file.
    assert [s[0] for s in seen] == [40, 40]
    assert [s[1][0] for s in seen] == [1, 1] and all(s[1][1] <= 60 for s in seen)


def test_delete_is_one_job_for_many_loads(spark, tmp_path):
    path = str(tmp_path / "s")
    fill(spark, path, 12, 10)
    writers.append_reports(make(spark, ["x", "y"], None), path, "odd")
    tracker, group = spark.sparkContext.statusTracker(), "delete"
    spark.sparkContext.setJobGroup(group, "delete")
    gone = spark.createDataFrame([(str(i),) for i in range(0, 120, 3)] + [("x",), ("x",), ("none",)], "id string")
    assert store.delete_reports(spark, path, gone) == 41
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 8
    left = sorted([str(i) for i in range(120) if i % 3] + ["y"])
    assert ids(store.read_reports(spark, path)) == left
    assert store.delete_report(spark, path, "y") and not store.delete_report(spark, path, "y")
    assert not store.delete_report(spark, path, "x")
    # A repeated load brings nothing back, another load does.
    writers.append_reports(make(spark, ["x", "y"], None), path, "odd")
    assert ids(store.read_reports(spark, path)) == left[:-1]
    writers.append_reports(make(spark, ["y"], None), path, "other")
    assert ids(store.read_reports(spark, path)) == left
    assert [r.language for r in store.find_report(spark, path, "y").collect()] == [None]


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["base", "snapshot", "clear"])
def test_broken_compactions_lose_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    fill(spark, path, 3, 10)
    store.delete_reports(spark, path, make(spark, [4, 14]))
    want = sorted(str(i) for i in range(30) if i not in (4, 14))
    real = store.slice_of if step == "base" else None

    def fail(*_):
        raise Broken

    if step == "base":
        monkeypatch.setattr(store, "slice_of", fail)
    elif step == "snapshot":
        monkeypatch.setattr(store, "PART", property(fail))  # the snapshot is not written
    else:
        calls = []

        def remove(spark, x, real=store.remove):
            calls.append(x)
            if len(calls) > 2:
                raise Broken
            real(spark, x)

        monkeypatch.setattr(store, "remove", remove)
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.compact(spark, path, 10)
        store.clear(spark, path)
    monkeypatch.undo()
    assert ids(store.read_reports(spark, path)) == want
    assert (real or store.slice_of) is store.slice_of
    writers.append_reports(make(spark, [77]), path, "late")
    assert store.delete_report(spark, path, "5")
    want = sorted([*(w for w in want if w != "5"), "77"])
    store.compact(spark, path, 10)
    assert ids(store.read_reports(spark, path)) == want
    store.clear(spark, path)
    assert ids(store.read_reports(spark, path)) == want
    # A load that the base holds may be repeated, also after its folder is gone.
    writers.append_reports(make(spark, range(10)), path, "load 0/a=b%")
    assert ids(store.read_reports(spark, path)) == want
    assert not store.compact_when_due(spark, path, 1)
    store.compact(spark, path)
    assert ids(store.read_reports(spark, path)) == want


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    assert store.read_reports(spark, path).count() == 0 == store.find_report(spark, path, "1").count()
    assert not store.delete_report(spark, path, "1")
    writers.append_reports(make(spark, []), path, "empty")
    assert store.compact(spark, path) == 1 and store.read_reports(spark, path).count() == 0
    writers.append_reports(make(spark, [3]), path, "one")
    assert ids(store.read_reports(spark, path)) == ["3"]


def test_pages(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    fill(spark, path, 4, 50)
    writers.append_reports(make(spark, ["u", "v", "w"], None).withColumn("created_at", F.lit(None).cast("timestamp")), path, "odd")
    table = store.read_reports(spark, path)
    order = [r.id for r in table.orderBy(F.desc("created_at"), "id").collect()]
    for heap in (10_000, 7):
        monkeypatch.setattr(reports, "HEAP", heap)
        for skip, limit in ((0, 5), (3, 20), (101, 9), (195, 20), (500, 5)):
            page = reports.list_reports(table, skip, limit).collect()
            assert [r.id for r in page] == order[skip : skip + limit]
            assert {r.total for r in page} <= {203}
    after = None
    seen = []
    while page := reports.list_reports(table, 0, 60, after=after).collect():
        seen += [r.id for r in page]
        after = (page[-1].created_at, page[-1].id)
    assert seen == order
    plan = reports.list_reports(table, 20, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan and "rangepartitioning" not in plan


def test_pages_of_equal_times(spark):
    rows = [(str(i % 400).zfill(4), datetime.datetime(2020, 1, 1), "c") for i in range(3000)]
    table = spark.createDataFrame(rows, "id string, created_at timestamp, language string")
    from lintlake.functions.ranks import at_rank

    order = sorted(r[0] for r in rows)
    for rank in (0, 17, 1500, 2950):
        kept, skip = at_rank(table.select("created_at", "id"), [("created_at", False), ("id", True)], rank, 10, 50)
        part = [r.id for r in kept.orderBy(F.desc("created_at"), "id").limit(skip + 10).offset(skip).collect()]
        assert part == order[rank : rank + 10] and skip < 3000


def test_loads_are_made_from_their_own_reports(spark, monkeypatch):
    from lintlake import queries

    read, append = [], writers.append_reports

    def watched(load, path, load_id):
        read.append(set(load.inputFiles()))
        append(load, path, load_id)

    monkeypatch.setattr(writers, "append_reports", watched)
    path = queries.report_store(spark, "/root/testdata/sf0.001")
    assert len(read) == 12 and all(read)
    assert len(set().union(*read)) == sum(map(len, read))
    assert store.read_reports(spark, path).count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
