"""One query per operator: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators import (
    catalog,
    complexity,
    datasets,
    embeddings,
    evaluation,
    features,
    labels,
    metrics,
    registry,
    security,
    structure,
    tokens,
    training,
)
from lintlake.operators.parse import EXTENSIONS, language_of_path, parse_errors, with_nodes
from lintlake.plans import analysis, reports
from lintlake.schemas import FEATURES
from lintlake.session import shared_dir, stored
from lintlake.sources import corpus, readers, writers
from lintlake.sources.report_store import compact, folders
from lintlake.streaming import submissions

Q: dict = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code(spark: SparkSession, d: str) -> DataFrame:
    return corpus.templated_corpus(table(spark, d, "orders"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return with_nodes(code(spark, d)).where("nodes IS NOT NULL")


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit("python").alias("language"),
        F.col("text").alias("code"),
        F.col("doc_id"),
        F.col("lang"),
        F.col("source"),
    )


def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    """Text features of the documents with their quality as target."""
    known = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("int").alias("target")
    )
    rough = features.extract_rough_features(documents(spark, d).select("id", "code"))
    labelled = rough.join(known.select(F.col("key").cast("bigint").alias("id")), "id", "left_semi")
    return labels.align_labels(labelled, known)


def training_data(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors of the labelled documents, written once so that no fit extracts them again."""
    return training.preprocess_features(stored(doc_features(spark, d).drop("error"), "features"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed score of the labelled documents against their quality."""
    score = (F.col("n_chars") % 1000) / 1000.0
    return (
        table(spark, d, "documents")
        .select("doc_id", score.alias("y_proba"))
        .join(table(spark, d, "labels"), "doc_id")
        .select(
            F.col("quality").cast("int").alias("y_true"),
            (F.col("y_proba") >= 0.5).cast("int").alias("y_pred"),
            "y_proba",
        )
    )


def stored_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the corpus; the time of a report grows with its key."""
    at = F.timestamp_seconds(F.col("file_id").cast("bigint"))
    return analysis.analyze(code(spark, d), at)


def report_table(spark: SparkSession, d: str) -> DataFrame:
    """The same reports, written and read back."""
    path = shared_dir(spark, "reports")
    writers.append_reports(stored_reports(spark, d), path, "first")
    return reports.read_reports(spark, path)


def report_store(spark: SparkSession, d: str) -> str:
    """A store of the same reports in twelve loads, one of them without a language; a compaction has
    taken eight loads in."""
    path, made = shared_dir(spark, "reports"), shared_dir(spark, "loads")
    rows = stored_reports(spark, d)
    # A folder for each load, so that making one does not read the reports of all.
    rows.withColumn("part", F.col("id").cast("bigint") % 12).write.partitionBy("part").parquet(made)
    for k in range(12):
        # A load without reports has no folder.
        has = f"part={k}" in folders(spark, made)
        load = spark.read.schema(rows.schema).parquet(f"{made}/part={k}") if has else spark.createDataFrame([], rows.schema)
        if k == 5:
            load = load.withColumn("language", F.lit(None).cast("string"))
        writers.append_reports(load, path, f"load-{k}")
        if k == 7:
            compact(spark, path)
    return path


# ---- sources and sinks ---------------------------------------------------------------------


@query
def s1_source_files(spark, d):
    path = shared_dir(spark, "files")
    rows = table(spark, d, "conversations").select("role", "text")
    rows.write.partitionBy("role").text(path)
    files = readers.source_files(spark, f"{path}/*/*.txt", "python")
    return files.groupBy(F.regexp_extract("path", "role=([^/]+)/", 1).alias("role")).agg(
        F.sum(F.length("code")).alias("chars"), F.sum(X.count_of(F.col("code"), "\n")).alias("lines")
    )


@query
def s2_detect_language(spark, d):
    endings = [*EXTENSIONS, ".TXT", ".PY", "", "."]
    number = (F.col("o_orderkey") % len(endings)).cast("int")
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), number + 1)
    path = F.concat(F.lit("a.b/f"), F.col("o_orderkey").cast("string"), ending)
    return table(spark, d, "orders").select("o_orderkey", path.alias("path")).withColumn(
        "language", language_of_path(F.col("path"))
    )


@query
def s3_labelled_code(spark, d):
    path = shared_dir(spark, "lines")
    writers.save_code_lines(corpus.sample_set(order_numbers(spark, d)), path)
    return readers.labelled_code(spark, path).select(
        "project", "commit_id", "target", F.md5("func").alias("func_md5")
    )


def _submissions(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "Accepted").when(
        F.col("o_orderstatus") == "F", "Wrong Answer"
    )
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("submission_id"), status.alias("status"), "o_orderkey"
    )


@query
def s4_submissions(spark, d):
    path = shared_dir(spark, "submissions")
    _submissions(spark, d).select("submission_id", "status").write.option("header", True).csv(path)
    return readers.submissions(spark, path).groupBy("submission_id", "status").agg(
        F.count("*").alias("n")
    )


@query
def s5_feature_csvs(spark, d):
    path = shared_dir(spark, "csvs")
    known = table(spark, d, "labels")
    known.select(F.col("doc_id").alias("id"), "quality").write.mode("append").option("header", True).csv(path)
    known.select("toxic", F.col("doc_id").alias("id")).write.mode("append").option("header", True).csv(path)
    return readers.feature_csvs(spark, path).select("id", "quality", "toxic")


@query
def s6_load_dataset(spark, d):
    path = writers.save_dataset(table(spark, d, "labels"), shared_dir(spark, "set"), "parquet")
    return readers.dataset(spark, path).select("doc_id", "quality", "toxic")


@query
def s7_train_and_validation(spark, d):
    split = datasets.create_splits(table(spark, d, "labels"), id_column="doc_id")
    train, val, _ = datasets.three_way(split)
    paths = (
        writers.save_dataset(train, shared_dir(spark, "train"), "csv"),
        writers.save_dataset(val, shared_dir(spark, "val"), "parquet"),
    )
    read_train, read_val = readers.train_and_validation(spark, *paths)
    cols = [F.col(c).cast("bigint").alias(c) for c in ("doc_id", "quality", "toxic")]
    return read_train.select(*cols, F.lit("train").alias("part")).unionByName(
        read_val.select(*cols, F.lit("val").alias("part"))
    )


@query
def s8_save_dataset(spark, d):
    path = writers.save_dataset(table(spark, d, "supplier"), shared_dir(spark, "csv"), "csv")
    return readers.dataset(spark, path).select("s_suppkey", "s_name")


@query
def s9_sample_set(spark, d):
    return corpus.sample_set(order_numbers(spark, d))


@query
def s10_synthetic_labels(spark, d):
    return corpus.synthetic_labels(order_numbers(spark, d))


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


@query
def s11_save_embeddings(spark, d):
    path = shared_dir(spark, "embeddings")
    writers.save_embeddings(_embeddings(spark, d), path)
    return spark.read.parquet(path).select(
        "id", F.size("embedding").alias("dims"), F.round(F.array_max("embedding").cast("double"), 5).alias("peak")
    )


@query
def s12_load_embeddings(spark, d):
    path = shared_dir(spark, "embeddings")
    writers.save_embeddings(_embeddings(spark, d), path)
    every = F.posexplode("embedding").alias("d", "v")
    return readers.embeddings(spark, path).select("id", every).withColumn("v", F.round(F.col("v").cast("double"), 5))


@query
def s13_metrics_json(spark, d):
    made = writers.metrics_json(metrics.file_metrics(code(spark, d)))
    names = [
        "total_lines", "code_lines", "blank_lines", "comment_lines", "function_count", "class_count", "loop_count",
        "condition_count", "variable_count", "max_nesting_depth", "cyclomatic_complexity", "max_function_length",
        "language", "risk_level",
    ]
    # One reading of a document for all its names.
    return made.select("file_id", F.json_tuple("json", *names).alias(*names))


@query
def s14_metrics_rows(spark, d):
    return writers.metrics_rows(metrics.file_metrics(code(spark, d)))


@query
def s15_append_reports(spark, d):
    return report_table(spark, d).select("id", "language", "risk_level", "load_id")


@query
def s16_reports_table(spark, d):
    path = shared_dir(spark, "reports")
    name = "reports_" + path[-32:]
    writers.append_reports(stored_reports(spark, d), path, "first")
    writers.create_reports_table(spark, name, path)
    return spark.table(name).groupBy("language").agg(F.count("*").alias("n"))


@query
def s17_log_experiment(spark, d):
    path = shared_dir(spark, "log")
    scores = evaluation.classification_metrics(predictions(spark, d)).first().asDict()
    writers.log_experiment(spark, "fixed_score", {"cut": 0.5}, scores, path)
    shape = "experiment_id string, model string, metrics map<string,double>"
    return spark.read.schema(shape).json(path).select(
        F.length("experiment_id").alias("id_digits"),
        "model",
        F.round(F.element_at("metrics", "f1"), 9).alias("f1"),
    )


@query
def s18_save_results(spark, d):
    path = shared_dir(spark, "results")
    writers.save_results(evaluation.classification_metrics(predictions(spark, d)), path)
    saved = spark.read.schema("accuracy double, precision double, recall double, f1 double, roc_auc double").json(path)
    return saved.select(*[F.round(c, 9).alias(c) for c in saved.columns])


def _cut_trials(spark, d):
    cuts = F.explode(F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("cut")
    rows = predictions(spark, d).select("y_true", "y_proba", cuts)
    tp = F.count_if((F.col("y_true") == 1) & (F.col("y_proba") >= F.col("cut")))
    predicted = F.count_if(F.col("y_proba") >= F.col("cut"))
    positive = F.count_if(F.col("y_true") == 1)
    return rows.groupBy("cut").agg(
        F.to_json(F.struct(F.first("cut").alias("cut"))).alias("params"),
        (2 * tp / (predicted + positive)).alias("value"),
    )


@query
def s19_save_tuning_results(spark, d):
    path = shared_dir(spark, "tuning")
    writers.save_tuning_results(_cut_trials(spark, d), path)
    saved = spark.read.schema("best_value double, best_params string, n_trials bigint").json(path)
    return saved.select(F.round("best_value", 9).alias("best_value"), "best_params", "n_trials")


# ---- parse and structure -------------------------------------------------------------------


@query
def a1_parse(spark, d):
    return with_nodes(code(spark, d)).where("language = 'python'").select(
        "file_id", F.col("nodes").isNotNull().alias("ok")
    )


@query
def a1_parse_errors(spark, d):
    return parse_errors(code(spark, d)).select(
        "file_id", "language", F.regexp_extract("parse_error", "^[A-Za-z]+", 0).alias("kind")
    )


@query
def a2_brace_languages(spark, d):
    kept = parsed(spark, d).where("language <> 'python'")
    return structure.walk(kept).groupBy("file_id", "kind").agg(F.count("*").alias("n"))


@query
def a3_walk(spark, d):
    every = with_nodes(code(spark, d), full=True, fields=["depth"]).where("nodes IS NOT NULL")
    return structure.walk(every).groupBy("file_id").agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("height")
    )


@query
def a4_functions(spark, d):
    return structure.functions_table(parsed(spark, d)).select(
        "file_id", "name", "start_line", "end_line", "parameter_count", "is_method",
        F.array_join("decorators", ",").alias("decorators"), "docstring",
    )


@query
def a5_loops(spark, d):
    return structure.loops_table(parsed(spark, d)).drop("pre")


@query
def a6_conditions(spark, d):
    return structure.conditions_table(parsed(spark, d)).drop("pre", "depth")


@query
def a7_variables(spark, d):
    return structure.variables_table(parsed(spark, d)).drop("pre", "depth")


@query
def a8_nesting(spark, d):
    return structure.nesting_table(parsed(spark, d)).select("file_id", "max_nesting_depth")


@query
def a9_classes(spark, d):
    return structure.nesting_table(parsed(spark, d)).select("file_id", "class_count")


# ---- metrics -------------------------------------------------------------------------------


@query
def m1_line_counts(spark, d):
    lines = metrics.line_counts(F.col("code"), F.col("language"))
    return code(spark, d).select("file_id", lines.alias("l")).select("file_id", "l.*")


@query
def m1_line_counts_text(spark, d):
    lines = metrics.line_counts(F.col("code"), F.col("language"))
    return documents(spark, d).select("file_id", lines.alias("l")).select("file_id", "l.*")


@query
def m2_total_lines(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", metrics.total_lines(F.col("html")).alias("total_lines"))


def _metrics(spark, d, *columns):
    return metrics.file_metrics(code(spark, d)).select("file_id", *columns)


@query
def m3_function_count(spark, d):
    return _metrics(spark, d, "function_count")


@query
def m4_average_length(spark, d):
    return _metrics(spark, d, "avg_function_length")


@query
def m5_function_lengths(spark, d):
    made = metrics.file_metrics(code(spark, d))
    return made.select(
        "file_id", "max_function_length", F.explode_outer("per_function_length").alias("name", "length")
    )


@query
def m6_cyclomatic(spark, d):
    return metrics.file_metrics(code(spark, d).where("language = 'python'")).select(
        "file_id", "cyclomatic_complexity"
    )


@query
def m7_cyclomatic_brace(spark, d):
    return metrics.file_metrics(code(spark, d).where("language <> 'python'")).select(
        "file_id", "cyclomatic_complexity"
    )


@query
def m8_cyclomatic_by_function(spark, d):
    made = metrics.file_metrics(code(spark, d))
    named = F.explode_outer("per_function_complexity").alias("name", "cyclomatic_complexity")
    return made.select("file_id", named).where("name IS NOT NULL")


@query
def m9_nesting(spark, d):
    return _metrics(spark, d, "max_nesting_depth")


@query
def m10_volume(spark, d):
    return code(spark, d).select(
        "file_id", F.round(metrics.halstead_volume(F.col("code")), 6).alias("volume")
    )


@query
def m10_volume_text(spark, d):
    return documents(spark, d).select(
        "file_id", F.round(metrics.halstead_volume(F.col("code")), 6).alias("volume")
    )


@query
def m11_maintainability(spark, d):
    return _metrics(spark, d, "maintainability_index")


@query
def m12_risk(spark, d):
    made = metrics.file_metrics(code(spark, d))
    return made.select("file_id", "risk_level", F.array_join("risk_reasons", "; ").alias("reasons"))


@query
def m13_file_metrics(spark, d):
    counts = [c for c in metrics.METRIC_COLUMNS if not c.startswith("per_") and c != "risk_reasons"]
    return _metrics(spark, d, *counts)


@query
def m14_breakdown(spark, d):
    return metrics.function_breakdown(code(spark, d))


# ---- complexity ----------------------------------------------------------------------------


@query
def c1_loop_nests(spark, d):
    made = complexity.loop_nests_table(code(spark, d)).drop("chain")
    return made.withColumn("loop_types", F.array_join("loop_types", ","))


@query
def c2_recursive(spark, d):
    return complexity.facts_table(code(spark, d)).select("file_id", "name", "recursive")


@query
def c3_branches(spark, d):
    return complexity.facts_table(code(spark, d)).select("file_id", "name", "branches")


def _detector(spark, d, name):
    return complexity.module_searches(code(spark, d)).select("file_id", name)


@query
def c4_binary_search(spark, d):
    return _detector(spark, d, "binary_search")


@query
def c5_divide_and_conquer(spark, d):
    return _detector(spark, d, "divide_and_conquer")


@query
def c6_logarithmic_loop(spark, d):
    return _detector(spark, d, "logarithmic_loop")


@query
def c7_sort_call(spark, d):
    return _detector(spark, d, "sort_call")


@query
def c8_estimates(spark, d):
    return complexity.estimates_table(code(spark, d)).select(
        "file_id", "function_name", "complexity_class", "confidence", "matched_pattern", "is_recursive",
        "start_line", "end_line",
    )


@query
def c9_estimates_in_order(spark, d):
    return complexity.estimates_table(code(spark, d)).select("file_id", "walk_order", "function_name")


@query
def c10_rules(spark, d):
    used = complexity.estimates_table(code(spark, d)).groupBy(
        F.col("matched_pattern").alias("pattern_name")
    ).agg(F.count("*").alias("n"))
    rules = catalog.complexity_rules(spark).join(used, "pattern_name", "left").fillna(0, ["n"])
    return rules.select("pattern_name", "complexity_class", "confidence", "category", "class_rank", "n").orderBy(
        "class_rank", "pattern_name"
    )


@query
def c11_match_rule(spark, d):
    wanted = [" Binary_Search ", "nested_loop", "efficient", "sort", "xx_power_set_xx", "none", "MERGE_SORT"]
    number = (F.col("o_orderkey") % len(wanted)).cast("int")
    lookups = table(spark, d, "orders").select(
        "o_orderkey", F.element_at(F.array(*[F.lit(w) for w in wanted]), number + 1).alias("lookup")
    )
    return catalog.match_rules(lookups, catalog.complexity_rules(spark)).select(
        "o_orderkey", "lookup", "pattern_name", "complexity_class"
    )


def _counted_rules(spark, d, rules):
    used = complexity.estimates_table(code(spark, d)).select(F.col("matched_pattern").alias("pattern_name"))
    return used.join(F.broadcast(rules), "pattern_name").groupBy("pattern_name", "category", "complexity_class").agg(
        F.count("*").alias("n")
    )


@query
def c12_rules_by_category(spark, d):
    return _counted_rules(spark, d, catalog.rules_by_category(catalog.complexity_rules(spark), " Iterative"))


@query
def c13_rules_by_class(spark, d):
    return _counted_rules(spark, d, catalog.rules_by_class(catalog.complexity_rules(spark), "O(log n) "))


@query
def c14_severity(spark, d):
    made = catalog.with_severity(complexity.estimates_table(code(spark, d)))
    return made.select("file_id", "function_name", "severity", "class_rank")


@query
def c15_file_summary(spark, d):
    made = complexity.file_summary(code(spark, d).where("language = 'python'"))
    return made.select(
        "file_id", "function_count", "worst_case_complexity", "worst_case_function",
        "recursive_functions", "average_confidence",
        F.size("complexity_distribution").alias("n_classes"),
    )


@query
def c16_worst_first(spark, d):
    return complexity.worst_first(code(spark, d)).select("file_id", "class_rank", "walk_order", "function_name")


@query
def c17_csv_rows(spark, d):
    return complexity.csv_rows(complexity.estimates_table(code(spark, d)))


# ---- security ------------------------------------------------------------------------------


def _rule_counts(spark, d, rules):
    found = security.findings_table(code(spark, d)).groupBy("rule_id").agg(F.count("*").alias("n"))
    joined = rules.join(found, "rule_id", "left").fillna(0, ["n"])
    return joined.select("rule_id", "rule_name", "severity", "cwe_id", "pattern_type", "language", "n")


@query
def v1_rules(spark, d):
    return _rule_counts(spark, d, catalog.security_rules(spark))


@query
def v2_rules_by_severity(spark, d):
    return _rule_counts(spark, d, catalog.rules_by_severity(catalog.security_rules(spark), "high"))


@query
def v3_rules_by_language(spark, d):
    return _rule_counts(spark, d, catalog.rules_by_language(catalog.security_rules(spark), "C"))


@query
def v4_rule_by_cwe(spark, d):
    wanted = ["cwe-89", "CWE-798", "CWE-0", "cwe-22"]
    number = (F.col("o_orderkey") % len(wanted)).cast("int")
    lookups = table(spark, d, "orders").select(
        "o_orderkey", F.element_at(F.array(*[F.lit(w) for w in wanted]), number + 1).alias("cwe_id")
    )
    return catalog.rules_by_cwe(lookups, catalog.security_rules(spark)).select(
        "o_orderkey", "cwe_id", "rule_id", "severity"
    )


@query
def v5_line_findings(spark, d):
    return security.line_findings_table(code(spark, d)).select(
        "file_id", "rule_id", "severity", "line_number", "column", "code_snippet"
    )


@query
def v5_line_findings_text(spark, d):
    return security.line_findings_table(documents(spark, d)).select(
        "file_id", "rule_id", "line_number", "column", "code_snippet"
    )


@query
def v5_custom_rules(spark, d):
    rules = [
        {"rule_id": "X-1", "pattern": r"@\w+\.", "language": "all"},
        {"rule_id": "X-2", "pattern": r"^\w+\s", "language": "python"},
        {"rule_id": "X-3", "pattern": "a", "language": "c"},
    ]
    return security.custom_findings(documents(spark, d), rules).groupBy("rule_id").agg(
        F.count("*").alias("n"), F.sum("column").alias("columns")
    )


@query
def v6_call_findings(spark, d):
    return security.call_findings_table(code(spark, d)).select(
        "file_id", "finding_order", "rule_id", "line_number", "column", "code_snippet", "file_path"
    )


@query
def v7_findings(spark, d):
    return security.findings_table(code(spark, d)).select(
        "file_id", "finding_order", "rule_id", "severity", "line_number", "column", "code_snippet"
    )


def _summary(spark, d, *columns):
    return security.security_summary(code(spark, d)).select("file_id", *columns)


@query
def v8_severity_counts(spark, d):
    return _summary(spark, d, "total_findings", "high_severity", "medium_severity", "low_severity")


@query
def v9_risk_score(spark, d):
    return _summary(spark, d, "risk_score")


@query
def v10_risk_level(spark, d):
    return _summary(spark, d, "risk_level")


@query
def v11_json_reports(spark, d):
    made = security.json_reports(code(spark, d))
    shape = "summary struct<risk_level:string,total_findings:int>, findings array<struct<rule_id:string,line_number:int,severity:string>>"
    report = F.from_json("report", shape)
    listed = F.transform(report["findings"], lambda f: F.concat_ws(":", f["rule_id"], f["line_number"].cast("string"), f["severity"]))
    return made.select(
        "file_id", report["summary"]["risk_level"].alias("risk_level"), report["summary"]["total_findings"].alias("total"),
        F.array_join(F.array_sort(listed), ",").alias("findings"),
    )


# ---- features, labels, datasets ------------------------------------------------------------


def _code_features(spark, d):
    return features.extract_features(code(spark, d).withColumnRenamed("file_id", "id"))


@query
def f1_lexical(spark, d):
    docs = documents(spark, d)
    made = docs.select("file_id", *[c.alias(n) for n, c in features.lexical_columns(F.col("code")).items()])
    return made.withColumn("comment_ratio", F.round("comment_ratio", 9))


@query
def f2_structural(spark, d):
    return _code_features(spark, d).where("NOT error").select(
        "id", "loop_count", "condition_count", "function_count", "avg_function_length",
        "max_nesting_depth", "cyclomatic_complexity", "variable_count",
    )


@query
def f3_rough(spark, d):
    return features.extract_rough_features(documents(spark, d).select("id", "code")).select(
        "id", "loop_count", "condition_count", "function_count", "max_nesting_depth",
        "cyclomatic_complexity", "error",
    )


@query
def f4_text(spark, d):
    return features.extract_rough_features(documents(spark, d).select("id", "code")).select(
        "id", "has_recursion", "import_count", "operator_count", "string_literal_count",
        "numeric_literal_count",
    )


@query
def f5_features(spark, d):
    return _code_features(spark, d).withColumn("comment_ratio", F.round("comment_ratio", 9)).drop("target")


@query
def f6_batch(spark, d):
    samples = table(spark, d, "benchmark").select(F.col("text").alias("code"), F.lit("c").alias("language"))
    placed = features.with_position_ids(samples)
    return features.extract_features(placed).select("id", "line_count", "error")


@query
def f7_valid(spark, d):
    return features.valid_features(_code_features(spark, d)).select("id", "line_count")


@query
def f8_clean(spark, d):
    made = features.extract_rough_features(documents(spark, d).select("id", "code"))
    cleaned = features.clean_features(stored(made, "features"))
    return cleaned.select("id", *[F.round(c, 6).alias(c) for c in FEATURES])


@query
def l1_submission_labels(spark, d):
    return labels.submission_labels(_submissions(spark, d), "o_orderkey")


@query
def l2_code_labels(spark, d):
    orders = table(spark, d, "orders")
    lines = orders.select(
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string"))).alias("project"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("c"), (F.col("o_orderkey") % 1000).cast("string"))).alias("commit_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.when(F.col("o_orderkey") % 97 == 5, "{bad").alias("_corrupt_record"),
        F.col("o_orderkey").alias("line"),
    )
    return labels.code_labels(lines)


@query
def l3_verdict_labels(spark, d):
    verdicts = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("verdict")
    )
    return labels.verdict_labels(verdicts)


@query
def l4_align(spark, d):
    known = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("int").alias("target")
    )
    return labels.align_labels(documents(spark, d).select("id", "lang"), known)


@query
def l5_label_statistics(spark, d):
    known = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("target"))
    return labels.label_statistics(known)


@query
def d1_splits(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("target"))
    return datasets.create_splits(rows)


def _labelled_documents(spark, d):
    return (
        table(spark, d, "documents")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("id"), "lang", "n_chars", "toxic", F.col("quality").alias("target"))
    )


@query
def d2_statistics(spark, d):
    made = datasets.dataset_statistics(_labelled_documents(spark, d))
    return made.select(
        "total_rows", "missing_lang", "missing_toxic", "missing_target",
        F.round("buggy_ratio", 9).alias("buggy_ratio"),
        F.array_join("features", ",").alias("features"),
    )


@query
def d2_class_distribution(spark, d):
    return datasets.class_distribution(_labelled_documents(spark, d))


@query
def d3_validate(spark, d):
    rows = (
        table(spark, d, "documents")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"), "lang", "n_chars", "toxic", (F.col("doc_id") * 0).alias("flat"),
            F.lit(0).alias("target"),
        )
    )
    return datasets.validate_dataset(rows)


# ---- models --------------------------------------------------------------------------------


@query
def e1_preprocess(spark, d):
    from pyspark.ml.functions import vector_to_array

    made = training.preprocess_features(doc_features(spark, d).drop("error"))
    values = vector_to_array("features")
    return made.select(
        "id", "target", F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def _facts(made: DataFrame) -> DataFrame:
    """What SQL can state about predictions (id, y_true, y_pred, y_proba): every labelled row is scored
    once, by a probability, with the class the probability says; and the model ranks its rows well."""
    made = stored(made, "predictions")
    ranks = evaluation.classification_metrics(made).select(F.col("roc_auc") > LEARNED).scalar()
    by_rule = ((F.col("y_pred") == 1) == (F.col("y_proba") > 0.5)) | (F.col("y_proba") == 0.5)
    return made.select(
        "id", "y_true", F.col("y_proba").between(0.0, 1.0).alias("in_range"), by_rule.alias("by_rule"), ranks.alias("learned")
    )


#: Area under the curve on its own rows that a fitted model must pass.
LEARNED = 0.8


@query
def e2_random_forest(spark, d):
    data = training_data(spark, d)
    return _facts(training.predictions(training.train_random_forest(data), data))


@query
def e3_boosted_trees(spark, d):
    data = training_data(spark, d)
    return _facts(training.predictions(training.train_boosted_trees(data), data))


@query
def e4_smote(spark, d):
    """Rows per class, and new rows outside the box of the rows they are made of."""
    from pyspark.ml.functions import vector_to_array

    data = training_data(spark, d)
    made = stored(training.smote(data).withColumn("x", vector_to_array("features")), "balanced")
    width = len(FEATURES)
    new = F.col("id").contains("~")
    sides = made.where(~new).groupBy("target").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("high"),
    )
    inside = F.forall(
        F.arrays_zip("x", "low", "high"), lambda z: (z["x"] >= z["low"] - 1e-9) & (z["x"] <= z["high"] + 1e-9)
    )
    return made.join(F.broadcast(sides), "target").groupBy("target").agg(
        F.count("*").alias("n"), F.count_if(new).alias("new"), F.count_if(~inside).alias("outside"),
        F.count_distinct("id").alias("ids"),
    )


@query
def e4_train_with_smote(spark, d):
    data = training_data(spark, d)
    return _facts(training.predictions(training.train_with_smote(data), data))


@query
def e5_cross_validate(spark, d):
    """Rows and positives of each held-out fold, and whether its five scores are scores."""
    made = training.fold_scores(training_data(spark, d), training.forest(), training.FOLDS)
    fine = F.lit(True)
    for c in training.SCORES:
        fine = fine & F.col(c).between(0.0, 1.0)
    return made.select("fold", "n", "positives", fine.alias("in_range"), (F.col("accuracy") >= 0.5).alias("learned"))


@query
def e6_metrics(spark, d):
    made = evaluation.classification_metrics(predictions(spark, d))
    return made.select(*[F.round(c, 9).alias(c) for c in made.columns])


@query
def e7_confusion_matrix(spark, d):
    return evaluation.confusion_matrix(predictions(spark, d))


@query
def e8_roc_points(spark, d):
    made = evaluation.roc_points(predictions(spark, d))
    return made.select(*[F.round(c, 9).alias(c) for c in made.columns])


@query
def e9_precision_recall(spark, d):
    made = evaluation.precision_recall_points(predictions(spark, d))
    return made.select(*[F.round(c, 9).alias(c) for c in made.columns])


@query
def e10_importances(spark, d):
    """All features with a share, and what the shares add up to."""
    model = training.train_random_forest(training_data(spark, d))
    made = training.feature_importances(model, FEATURES, len(FEATURES))
    total = made.agg(F.round(F.sum("importance"), 6)).scalar()
    return made.select("feature", F.col("importance").between(0.0, 1.0).alias("in_range"), total.alias("total"))


@query
def e11_report(spark, d):
    made = evaluation.classification_report(predictions(spark, d))
    return made.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def e12_compare_models(spark, d):
    rows = predictions(spark, d)
    flipped = rows.withColumns({"y_proba": 1 - F.col("y_proba"), "y_pred": 1 - F.col("y_pred")})
    runs = [
        evaluation.classification_metrics(r).withColumn("model", F.lit(n))
        for n, r in (("score", rows), ("flipped", flipped))
    ]
    made = evaluation.compare_models(runs)
    return made.select("model", F.round("f1", 9).alias("f1"), F.round("roc_auc", 9).alias("roc_auc"))


def _search_facts(trials: DataFrame) -> DataFrame:
    """Trials, different settings among them, and values that are scores."""
    return trials.agg(
        F.count("*").alias("trials"), F.count_distinct("params").alias("settings"),
        F.count_if(F.col("value").between(0.0, 1.0)).alias("in_range"), (F.max("value") > 0.5).alias("learned"),
    )


@query
def e13_grid_search_forest(spark, d):
    return _search_facts(training.grid_search(training_data(spark, d), "rf", parallelism=8)[1])


@query
def e14_grid_search_boosted(spark, d):
    grid = {"maxIter": [3, 5], "maxDepth": [2, 4], "stepSize": [0.1, 0.2]}
    return _search_facts(training.grid_search(training_data(spark, d), "xgb", grid)[1])


@query
def e15_trial_search(spark, d):
    return _search_facts(training.trial_search(training_data(spark, d), "rf", parallelism=8)[1])


@query
def e15_trial_search_boosted(spark, d):
    found = training.trial_search(training_data(spark, d), "xgb", 4, overrides={"maxIter": 5, "maxDepth": 4})
    return _search_facts(found[1])


def _versions(spark, d, label):
    base = shared_dir(spark, label)
    data = training_data(spark, d)
    for day in range(1, 5):
        model = training.train_random_forest(data, {"numTrees": 25 * day, "seed": day})
        registry.version_model(model, base, "forest", {"trees": 25 * day}, f"2024010{day}_000000")
    return base, data


def _agreement(fitted, loaded):
    """How many rows two models score, and score alike."""
    other = loaded.select("id", F.col("y_proba").alias("again"))
    return fitted.join(other, "id").agg(
        F.count("*").alias("n"), F.count_if(F.col("y_proba") == F.col("again")).alias("alike")
    )


@query
def e16_save_and_load(spark, d):
    base = shared_dir(spark, "model")
    data = training_data(spark, d)
    model = training.train_random_forest(data)
    registry.save_model(model, base, {"trees": 100})
    loaded, _ = registry.load_model(spark, base)
    return _agreement(training.predictions(model, data), training.predictions(loaded, data))


@query
def e17_latest(spark, d):
    base, data = _versions(spark, d, "latest")
    latest = training.predictions(registry.load_latest(spark, base, "forest"), data)
    newest, _ = registry.load_model(spark, f"{base}/forest/20240104_000000/model")
    oldest, _ = registry.load_model(spark, f"{base}/forest/20240101_000000/model")
    other = _agreement(latest, training.predictions(oldest, data)).select((F.col("alike") < F.col("n")).alias("older_differs"))
    return _agreement(latest, training.predictions(newest, data)).withColumn("older_differs", other.scalar())


@query
def e18_versions(spark, d):
    base, _ = _versions(spark, d, "versions")
    return registry.retention(registry.list_versions(spark, base, "forest"), 3).select("version", "kept")


# ---- tokens and embeddings -----------------------------------------------------------------


@query
def t1_tokenize(spark, d):
    made = tokens.tokenize(documents(spark, d))
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return made.select("file_id", F.size("input_ids").alias("length"), real.alias("tokens"))


@query
def t2_attention_mask(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("code"))
    widest = talk.agg(F.max(F.size(tokens.default_tokens(F.col("code"))))).first()[0] or 0
    made = tokens.tokenize(talk, widest)
    return made.select("conv_id", "turn", F.array_join("attention_mask", "").alias("mask"))


@query
def t3_truncate(spark, d):
    pages = table(spark, d, "pages")
    cut = tokens.truncate_code(F.replace(F.col("html"), F.lit("<p>"), F.lit("\n<p>")), 150)
    return pages.select("page_id", F.length(cut).alias("chars"), F.md5(cut).alias("digest"))


@query
def t4_token_statistics(spark, d):
    made = tokens.token_statistics(documents(spark, d))
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


def _token_vectors(spark, d):
    """Each stored vector read as four token vectors of sixteen, with a mask from its id."""
    piece = lambda p: F.slice(F.col("embedding").cast("array<double>"), p * 16 + 1, 16)
    vectors = F.array(*[piece(p) for p in range(4)])
    mask = F.array(*[((F.col("vec_id") + p) % 3 != 0).cast("int") for p in range(4)])
    return table(spark, d, "embeddings").select("vec_id", vectors.alias("vectors"), mask.alias("mask"))


def _dims(df, column):
    return df.select("vec_id", F.posexplode(column).alias("d", "v")).withColumn("v", F.round("v", 6))


@query
def t5_cls_embedding(spark, d):
    made = _token_vectors(spark, d).withColumn("e", embeddings.cls_embedding(F.col("vectors")))
    return _dims(made, "e")


@query
def t6_mean_pooled(spark, d):
    pooled = embeddings.mean_pooled_embedding(F.col("vectors"), F.col("mask"))
    return _dims(_token_vectors(spark, d).withColumn("e", pooled), "e")


@query
def t7_extract_embeddings(spark, d):
    made = embeddings.extract_embeddings(documents(spark, d), "mean")
    # Shares of the buckets times the number of tokens: whole counts, whose sum is that of all tokens.
    size = F.size(tokens.default_tokens(F.col("code")))
    counts = X.let(size, lambda n: F.transform("embedding", lambda x: F.round(x * n).cast("long")))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("file_id", F.size("embedding").alias("dims"), total.alias("tokens"))


def _fused(spark, d, reduce_dim=None):
    vectors = _embeddings(spark, d).select("id", "embedding")
    rows = doc_features(spark, d).drop("error").withColumn("id", F.col("id").cast("string"))
    return embeddings.fuse_features(rows, vectors, FEATURES, reduce_dim)


@query
def t8_fuse(spark, d):
    from pyspark.ml.functions import vector_to_array

    base = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("label").cast("double").alias("a"),
        (F.col("vec_id") % 7).cast("double").alias("b"),
    )
    made = embeddings.fuse_features(base, _embeddings(spark, d).select("id", "embedding"), ["a", "b"])
    v = vector_to_array("features")
    return made.select(
        "id", F.size(v).alias("width"), *[F.round(F.get(v, F.lit(i)), 6).alias(f"x{i}") for i in range(4)]
    )


@query
def t8_fuse_reduced(spark, d):
    from pyspark.ml.functions import vector_to_array

    return _fused(spark, d, 8).select("id", F.size(vector_to_array("features")).alias("width"))


def _head_facts(scored: DataFrame, data: DataFrame) -> DataFrame:
    known = data.select("id", F.col("target").cast("int").alias("y_true"))
    return _facts(
        scored.join(known, "id").select("id", "y_true", F.col("predicted").alias("y_pred"), F.col("probability").alias("y_proba"))
    )


@query
def t9_mlp(spark, d):
    data = stored(_fused(spark, d), "fused")
    return _head_facts(embeddings.score(embeddings.train_mlp(data), data), data)


@query
def t9_epoch_log(spark, d):
    """What SQL can state about the epochs of a perceptron: all are logged, one is the best, its F1 is the
    highest and that of the returned model on the validation rows, and the loss falls."""
    split = stored(datasets.create_splits(_fused(spark, d)), "splits")
    train, val, _ = datasets.three_way(split)
    model = embeddings.train_mlp(train, validation=val)
    log = model.epoch_log(spark)
    scored = embeddings.score(model, val).join(val.select("id", F.col("target").cast("int").alias("y_true")), "id")
    f1 = evaluation.classification_metrics(scored.select("y_true", F.col("predicted").alias("y_pred"))).select("f1").scalar()
    top = F.max(F.when(F.col("best"), F.col("val_f1")))
    return log.agg(
        F.count("*").alias("epochs"), F.count_if("best").alias("best_epochs"), (top == F.max("val_f1")).alias("is_highest"),
        (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("loss_falls"), (top >= LEARNED).alias("learned"), (F.abs(top - f1) < 1e-9).alias("returned"),
    )


@query
def t10_fused_boosted(spark, d):
    data = stored(_fused(spark, d), "fused")
    return _head_facts(embeddings.score(embeddings.train_fused_boosted(data), data), data)


@query
def t11_baseline(spark, d):
    rows = predictions(spark, d)
    stricter = rows.withColumn("y_pred", (F.col("y_proba") >= 0.7).cast("int"))
    made = evaluation.compare_with_baseline(
        evaluation.as_long(evaluation.classification_metrics(rows)),
        evaluation.as_long(evaluation.classification_metrics(stricter)),
    )
    return made.select("metric", *[F.round(c, 9).alias(c) for c in ("diff", "percent_improvement")])


@query
def t12_score(spark, d):
    data = training_data(spark, d)
    return _head_facts(embeddings.score(training.train_random_forest(data), data), data)


# ---- reports and streams -------------------------------------------------------------------


@query
def r1_analyze(spark, d):
    made = stored_reports(spark, d)
    return made.select(
        "id", "language", "code_hash", "risk_level", F.round("bug_probability", 9).alias("bug_probability"),
        "metrics.function_count", "metrics.max_nesting_depth", "metrics.total_lines",
        "metrics.avg_function_length", "metrics.cyclomatic_complexity",
        F.size("complexity").alias("n_estimates"), F.size("security_issues").alias("n_issues"),
    )


@query
def r1_rejects(spark, d):
    pages = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), F.repeat("text", 12).alias("code")
    )
    return analysis.split_by_size(pages)[1]


@query
def r2_code_hash(spark, d):
    return documents(spark, d).select("file_id", analysis.code_hash(F.col("code")).alias("code_hash"))


@query
def r3_bug_probability(spark, d):
    return stored_reports(spark, d).select("id", F.round("bug_probability", 9).alias("bug_probability"))


@query
def r4_report_by_id(spark, d):
    path = report_store(spark, d)
    found = [reports.find_report(spark, path, report_id) for report_id in ("13", "17", "21", "none")]
    return functools.reduce(DataFrame.unionByName, found).select("id", "language", "risk_level", "load_id")


@query
def r5_list_reports(spark, d):
    """The second page of Python reports, and the page behind it by its last key."""
    table = reports.read_reports(spark, report_store(spark, d))
    second = stored(reports.list_reports(table, 20, 20, "python"), "page")
    last = second.orderBy("created_at", F.desc("id")).first()
    third = reports.list_reports(table, 0, 20, "python", after=(last.created_at, last.id))
    return second.unionByName(third).select("id", "risk_level", "created_at", "total")


@query
def r6_summary_stats(spark, d):
    made = reports.summary_stats(stored_reports(spark, d))
    return made.withColumn("average_bug_probability", F.round("average_bug_probability", 9))


@query
def r7_delete(spark, d):
    """Reports of twelve loads, some of them deleted before and some after a compaction."""
    path = report_store(spark, d)
    gone = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    odd = F.col("id").cast("bigint") % 2 == 1
    reports.delete_reports(spark, path, gone.where(odd))
    compact(spark, path)
    reports.delete_reports(spark, path, gone.where(~odd))
    return reports.read_reports(spark, path).groupBy("language").agg(F.count("*").alias("n"))


@query
def r8_response(spark, d):
    made = stored_reports(spark, d)
    odd = F.col("id").cast("bigint") % 3 == 0
    stored = made.select(
        "id", "code_hash", "language", "bug_probability", "risk_level", "created_at",
        F.when(odd, "not json").otherwise(F.to_json("complexity")).alias("complexity_json"),
        F.to_json("security_issues").alias("security_issues_json"),
        F.when(odd, "[]").otherwise(F.to_json("metrics")).alias("metrics_json"),
    )
    return reports.to_response(stored).select(
        "analysis_id", F.size("complexity_estimates").alias("n_estimates"),
        F.size("security_issues").alias("n_issues"), "metrics.total_lines",
    )


@query
def r9_languages(spark, d):
    used = code(spark, d).groupBy("language").agg(F.count("*").alias("n"))
    return reports.supported_languages(spark).join(used, "language", "left").fillna(0, ["n"])


@query
def r10_analyze_stream(spark, d):
    path = shared_dir(spark, "streamed")
    shape = table(spark, d, "orders").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "orders.parquet").parquet(d)
    snippets = corpus.templated_corpus(stream)
    submissions.analyze_stream(snippets, path, shared_dir(spark, "progress")).awaitTermination()
    return reports.read_reports(spark, path).select("id", "language", "risk_level")


@query
def r11_stats_stream(spark, d):
    path, out = shared_dir(spark, "reports"), shared_dir(spark, "stats")
    writers.append_reports(stored_reports(spark, d), path, "first")
    arriving = spark.readStream.schema(reports.read_reports(spark, path).schema).parquet(path)

    def keep(stats, number):
        stats.write.mode("overwrite").parquet(out)

    submissions.stats_stream(arriving, keep, shared_dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).withColumn(
        "average_bug_probability", F.round("average_bug_probability", 9)
    )


__all__ = ["Q"]
