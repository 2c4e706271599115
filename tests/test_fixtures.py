"""The two reference snippets with their known answers."""

from lintlake.operators import complexity, features, metrics, security
from lintlake.plans import analysis
from tests.conftest import SAMPLE, VULNERABLE


def test_sample_metrics(make_code):
    row = metrics.file_metrics(make_code(("python", SAMPLE))).first()
    assert (row.total_lines, row.code_lines, row.blank_lines, row.comment_lines) == (10, 8, 2, 0)
    assert (row.function_count, row.class_count, row.loop_count) == (2, 0, 2)
    assert (row.condition_count, row.variable_count, row.max_nesting_depth) == (0, 1, 2)
    assert (row.cyclomatic_complexity, row.avg_function_length, row.max_function_length) == (3, 4.0, 6)
    assert row.per_function_complexity == {"hello_world": 1, "complex_function": 3}
    assert row.maintainability_index == 63.8
    assert (row.risk_level, row.risk_reasons) == ("low", [])


def test_sample_volume(make_code):
    from pyspark.sql import functions as F

    code = make_code(("python", SAMPLE), ("python", VULNERABLE))
    found = [r[0] for r in code.orderBy("file_id").select(metrics.halstead_volume(F.col("code"))).collect()]
    assert abs(found[0] - 199.03672606650858) < 1e-9
    assert abs(found[1] - 156.0801066523054) < 1e-9


def test_sample_complexity(make_code):
    rows = {r.function_name: r for r in complexity.estimates_table(make_code(("python", SAMPLE))).collect()}
    assert rows["hello_world"].complexity_class == "O(1)" and rows["hello_world"].confidence == 0.95
    nested = rows["complex_function"]
    assert (nested.complexity_class, nested.confidence, nested.matched_pattern) == ("O(n²)", 0.9, "nested_loop_2")
    chain = nested.loop_nests[0]
    assert (chain.loop_types, chain.start_line, chain.end_line) == (["for", "for"], 7, 9)


def test_vulnerable_findings(make_code):
    code = make_code(("python", VULNERABLE))
    rows = security.findings_table(code).orderBy("finding_order").collect()
    assert [(r.rule_id, r.line_number, r.column, r.severity) for r in rows] == [
        ("SEC-002", 6, 4, "HIGH"),
        ("SEC-016", 9, 11, "HIGH"),
    ]
    summary = security.security_summary(code).first()
    assert (summary.risk_score, summary.risk_level) == (6.0, "HIGH")
    report = analysis.analyze(code).first()
    assert report.bug_probability == 0.4 and report.risk_level == "HIGH"
    assert report.metrics.total_lines == 10


def test_features(make_code):
    code = make_code(("python", SAMPLE), ("python", VULNERABLE), ("python", " \n"), ("python", "def f(:"))
    rows = {r.id: r for r in features.extract_features(code.withColumnRenamed("file_id", "id")).collect()}
    assert (rows["0"].line_count, rows["0"].operator_count, rows["0"].string_literal_count) == (11, 2, 1)
    assert (rows["0"].numeric_literal_count, rows["0"].has_recursion, rows["0"].import_count) == (1, 1, 0)
    assert (rows["1"].line_count, rows["1"].operator_count, rows["1"].import_count) == (11, 1, 1)
    assert rows["1"].comment_ratio == 2 / 11
    assert rows["2"].error and rows["2"].line_count == 0
    assert rows["3"].error and rows["3"].line_count == 1 and rows["3"].has_recursion == 0


def test_failed_parse_keeps_a_report(make_code):
    row = analysis.analyze(make_code(("python", "def f(:\n  eval(x)\n"), ("cpp", "int a;"), ("python", "x\0"))).collect()
    by_id = {r.id: r for r in row}
    assert by_id["0"].metrics.total_lines == 3 and by_id["0"].complexity == []
    assert by_id["0"].metrics.cyclomatic_complexity == 0 and by_id["0"].bug_probability == 0.1
    assert by_id["1"].risk_level == "SECURE" and by_id["2"].metrics.function_count == 0


def test_size_limit(make_code):
    code = make_code(("python", "#" * 100_000), ("python", "#" * 100_001))
    accepted, rejected = analysis.split_by_size(code)
    assert [r.file_id for r in accepted.collect()] == ["0"]
    assert [r.file_id for r in rejected.collect()] == ["1"]
    assert analysis.analyze(code).count() == 2


def test_long_files_and_lines_are_kept_whole(make_code):
    long = "x = 1\n" * 30_000 + "password = " + "'" + "p" * 300 + "'\n"
    row = analysis.analyze(make_code(("python", long))).first()
    assert row.metrics.total_lines == 30_001 and len(row.security_issues) == 1
    from lintlake.operators import security

    found = security.line_findings_table(make_code(("python", long))).first()
    assert len(found.code_snippet) == 313
