"""Sources, sinks, stored reports, streams and models."""

import json

import os

import pytest
from pyspark.sql import functions as F

from lintlake.operators import complexity, embeddings, evaluation, metrics, registry, security, training
from lintlake.operators.parse import parse_errors
from lintlake.plans import analysis, reports
from lintlake.sources import corpus, readers, writers
from lintlake.streaming import submissions
from tests.conftest import SAMPLE, VULNERABLE


def test_source_files(spark, tmp_path):
    (tmp_path / "a.PY").write_bytes(b"x = 1\r\ny = '\xff'\r")
    (tmp_path / "b.mjs").write_text("let a = 1;")
    (tmp_path / "c.txt").write_text(" \n")
    (tmp_path / ".py").write_text("x")
    files = readers.source_files(spark, str(tmp_path / "*"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert rows["a.PY"].code == "x = 1\ny = '�'\n" and rows["a.PY"].language == "python"
    assert rows["b.mjs"].language == "javascript" and rows["c.txt"].language is None
    assert rows["c.txt"].is_empty
    assert {r.path.rsplit("/", 1)[1] for r in readers.rejected_files(files).collect()} >= {"c.txt"}


def test_feature_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,id,y\n5,3,z\n")
    (tmp_path / "c.csv").write_text("id,x\n4,9\n")
    (tmp_path / "note.txt").write_text("id\n0\n")
    rows = sorted((r.id, r.x, r.y) for r in readers.feature_csvs(spark, str(tmp_path)).collect())
    assert rows == [(1, 2, None), (3, 5, "z"), (4, 9, None)]
    (tmp_path / "none").mkdir()
    assert readers.feature_csvs(spark, str(tmp_path / "none")).count() == 0
    assert readers.feature_csvs(spark, str(tmp_path / "missing")).count() == 0


def test_feature_csvs_of_many_files(spark, tmp_path):
    """The number of jobs does not depend on the number of files."""
    jobs = []
    for n in (99, 108):  # more than Spark lists without a job
        folder = tmp_path / f"in {n}"
        folder.mkdir()
        for k in range(n):
            (folder / f"f {k}%[+].csv").write_text(["id,x\n", "\n  \ny,id\n", '"id","z"\r\n'][k % 3] + f"{k},{k + 100}\n")
        (folder / "blank.csv").write_text("\n\n")
        spark.sparkContext.setJobGroup(f"csv{n}", "")
        made = readers.feature_csvs(spark, str(folder)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"csv{n}")))
        spark.sparkContext._jsc.clearJobGroup()
        want = [((k, k + 100, None, None), (k + 100, None, k, None), (k, None, None, k + 100))[k % 3] for k in range(n)]
        assert sorted(((r.id, r.x, r.y, r.z) for r in made), key=repr) == sorted(want, key=repr)
    assert jobs[0] == jobs[1]


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "id int, s string")
    for kind in ("csv", "parquet"):
        path = writers.save_dataset(df, str(tmp_path / "set"), kind)
        assert path.endswith(f".{kind}")
        assert [tuple(r) for r in readers.dataset(spark, path).collect()] == [(1, "a,b")]
    with pytest.raises(ValueError):
        writers.save_dataset(df, str(tmp_path / "set"), "xml")


def test_metric_outputs(make_code):
    made = metrics.file_metrics(make_code(("python", SAMPLE)))
    document = json.loads(writers.metrics_json(made).first().json)
    assert document["per_function_length"] == {"hello_world": 2, "complex_function": 6}
    rows = {r.metric: r.value for r in writers.metrics_rows(made).collect()}
    assert rows["per_function_complexity.complex_function"] == "3"
    assert rows["risk_reasons"] == "" and rows["maintainability_index"] == "63.8"


def test_json_report(make_code):
    made = json.loads(security.json_reports(make_code(("python", VULNERABLE))).first().report)
    assert made["summary"]["risk_level"] == "HIGH" and made["summary"]["total_findings"] == 2
    assert [f["rule_id"] for f in made["findings"]] == ["SEC-002", "SEC-016"]
    assert made["findings"][0]["file_path"] == "unknown"


def test_parse_errors(make_code):
    rows = parse_errors(make_code(("python", "def f(:"), ("cobol", "x"), ("python", "x\0"), ("Python ", "x"))).collect()
    assert sorted(r.file_id for r in rows) == ["0", "1", "2"]


@pytest.fixture
def stored(spark, make_code, tmp_path):
    code = make_code(("python", SAMPLE), ("python", VULNERABLE), ("c", "int x;"))
    at = F.timestamp_seconds(F.col("file_id").cast("bigint"))
    path = str(tmp_path / "reports")
    writers.append_reports(analysis.analyze(code, at), path, "one")
    return path


def test_reports(spark, stored):
    table = reports.read_reports(spark, stored)
    assert table.count() == 3
    assert [r.id for r in reports.list_reports(table).collect()] == ["2", "1", "0"]
    page = reports.list_reports(table, 1, 1, "python").collect()
    assert [(r.id, r.total) for r in page] == [("0", 2)]
    with pytest.raises(ValueError):
        reports.list_reports(table, 0, 101)
    assert reports.report_by_id(table, "nope").count() == 0
    stats = {r.risk_level: r.analyses for r in reports.summary_stats(table).collect()}
    assert stats == {None: 3, "SECURE": 2, "HIGH": 1}


def test_pages_do_not_overlap(spark, stored):
    table = reports.read_reports(spark, stored)
    shallow = [r.id for r in reports.list_reports(table, 1, 2).collect()]
    deep = reports.list_reports(table, 0, 3)
    assert [r.id for r in deep.collect()][1:] == shallow
    assert {r.total for r in deep.collect()} == {3}


def test_repeated_load_replaces_itself(spark, stored):
    table = reports.read_reports(spark, stored)
    again = table.select(*[c for c in table.columns if c != "load_id"]).limit(3).collect()
    writers.append_reports(spark.createDataFrame(again, analysis.REPORT), stored, "one")
    assert reports.read_reports(spark, stored).count() == 3


def test_delete(spark, stored):
    assert reports.delete_report(spark, stored, "1")
    assert not reports.delete_report(spark, stored, "1")
    assert sorted(r.id for r in reports.read_reports(spark, stored).collect()) == ["0", "2"]
    again = reports.read_reports(spark, stored).drop("load_id").collect()
    writers.append_reports(spark.createDataFrame(again, analysis.REPORT), stored, "two")
    assert reports.delete_reports(spark, stored, spark.createDataFrame([("0",), ("2",), ("7",)], "id string")) == 4
    assert reports.read_reports(spark, stored).count() == 0
    assert not [p for p in os.listdir(os.path.dirname(stored)) if "rewrite" in p]


def test_streams(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "reports")
    numbers = corpus.sample_set(corpus.numbered(spark, 40))
    code = readers.code_table(numbers)
    code.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(code.schema).option("maxFilesPerTrigger", 1).parquet(source)
    submissions.analyze_stream(stream, path, str(tmp_path / "c1")).awaitTermination()
    kept = {}

    def sink(stats, number):
        kept.update({r.risk_level: r.analyses for r in stats.collect()})

    arriving = spark.readStream.schema(reports.read_reports(spark, path).schema).parquet(path)
    submissions.stats_stream(arriving, sink, str(tmp_path / "c2")).awaitTermination()
    batch = {r.risk_level: r.analyses for r in reports.summary_stats(analysis.analyze(code)).collect() if r.risk_level}
    assert kept == batch and sum(kept.values()) == 40


def test_sample_set(spark):
    rows = corpus.sample_set(corpus.numbered(spark, 2000)).collect()
    share = sum(r.target for r in rows) / 2000
    assert 0.25 < share < 0.35 and rows[7].commit_id == "syn_0007"
    assert all(("eval(data)" in r.func) == bool(r.target) for r in rows)


def blobs(spark, n=240):
    rows = [(str(i), float(i % 7 + 4 * (i % 4 == 0)), float((i * 37) % 11), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, a double, b double, target int")


def test_training(spark, tmp_path):
    data = training.preprocess_features(blobs(spark))
    model = training.train_random_forest(data, {"numTrees": 10})
    scored = training.predictions(model, data)
    scores = evaluation.classification_metrics(scored).first()
    assert scores.roc_auc > 0.9 and scores.f1 > 0.7
    top = training.feature_importances(model, ["a", "b"], 1).collect()
    assert [r.feature for r in top] == ["a"]
    with pytest.raises(ValueError):
        training.preprocess_features(blobs(spark).drop("target"))
    with pytest.raises(ValueError):
        training.classifier("svm")
    base = str(tmp_path / "models")
    for version in ("1", "2", "3"):
        registry.version_model(model, base, "m", {"f1": 1}, version)
    listed = registry.list_versions(spark, base, "m").collect()
    assert [r.version for r in listed] == ["3", "2", "1"] and json.loads(listed[0].metadata)["f1"] == 1
    assert registry.delete_old_versions(spark, base, "m", 2) == ["1"]
    assert [r.version for r in registry.list_versions(spark, base, "m").collect()] == ["3", "2"]
    again = training.predictions(registry.load_latest(spark, base, "m"), data)
    assert again.exceptAll(scored).count() == 0
    assert registry.list_versions(spark, base, "other").count() == 0
    with pytest.raises(FileNotFoundError):
        registry.load_model(spark, base + "/none")


def test_evaluation_edges(spark):
    one = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.3)], "y_true int, y_pred int, y_proba double")
    assert tuple(evaluation.classification_metrics(one).first()) == (0.0, 0.0, 0.0, 0.0, 0.5)
    tied = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.9), (0, 0, 0.1)], "y_true int, y_pred int, y_proba double")
    assert evaluation.roc_auc(tied).first()[0] == 0.875
    assert [r["count"] for r in evaluation.confusion_matrix(one).orderBy("y_true", "y_pred").collect()] == [0, 0, 2, 0]


def test_user_encoder(spark):
    def loader():
        import numpy as np

        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, code string")
    rows = embeddings.extract_embeddings(df, "cls", loader).collect()
    assert [list(r.embedding) for r in rows] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        embeddings.extract_embeddings(df, "max")


def test_reduced_embeddings_are_centred(spark):
    rows = [(str(i), [float(i), float(i % 3), float(-i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    made = embeddings.reduce_dimensions(df, 2).select(F.get("embedding", F.lit(0)).alias("p"))
    assert abs(made.agg(F.avg("p")).first()[0]) < 1e-9


def test_complexity_csv(make_code):
    rows = complexity.csv_rows(complexity.estimates_table(make_code(("python", SAMPLE)))).collect()
    assert {(r.function_name, r.confidence, r.max_loop_depth) for r in rows} == {("hello_world", "0.95", 0), ("complex_function", "0.90", 2)}
