"""The SQL each query is checked against (DuckDB dialect).

Text operators are stated again over the same text. Operators on syntax trees are checked
against the expected values of the corpus templates, joined on the key of the row.
"""

from __future__ import annotations

from lintlake import expected as E
from lintlake.functions.text import DIGIT, LINE_END, SPACE, TOKEN, WORD
from lintlake.operators.catalog import CLASS_SEVERITY, COMPLEXITY_RULES, SECURITY_FIELDS, SECURITY_RULES
from lintlake.operators.parse import EXTENSIONS
from lintlake.plans.reports import OFFERED_LANGUAGES
from lintlake.schemas import FEATURES
from lintlake.sources.corpus import BUGGY_BODY, CLEAN_BODY, TEMPLATES

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


N = len(TEMPLATES)
_BODY = " ".join(f"WHEN {i} THEN {quoted(code)}" for i, (_, code) in enumerate(TEMPLATES))
_ENDING = " ".join(f"WHEN {i} THEN '{ext}'" for i, (ext, _) in enumerate(TEMPLATES))
# key, k, m, path and code of each corpus file
CORPUS = f"""corpus AS (
  SELECT key, k, m, 'src/' || (key % 100) || '/f' || key || '.' || CASE k {_ENDING} END AS path,
         replace(replace(CASE k {_BODY} END, '{{k}}', CAST(key AS VARCHAR)), '{{m}}', m) AS code
  FROM (SELECT o_orderkey AS key, o_orderkey % {N} AS k, CAST(o_orderkey % 97 + 3 AS VARCHAR) AS m FROM orders))"""
FILES = f"""ffacts AS (SELECT * FROM {E.FILES}), files AS (
  SELECT c.key, CAST(c.key AS VARCHAR) AS file_id, c.path, c.code, c.m, f.* FROM corpus c JOIN ffacts f ON c.k = f.k)"""
WITH = f"WITH {CORPUS}, {FILES}"


def facts(values: str, columns: str, where: str = "TRUE") -> str:
    """Rows of an expected-values table for every corpus file; ``x`` is the table, ``c`` the file."""
    return f"WITH {CORPUS}, x AS (SELECT * FROM {values}) SELECT CAST(c.key AS VARCHAR) AS file_id, {columns} FROM corpus c JOIN x ON c.k = x.k WHERE {where}"


def named(column: str) -> str:
    return f"replace({column}, '{{k}}', CAST(c.key AS VARCHAR))"


def count(text: str, piece: str) -> str:
    return f"(length({text}) - length(replace({text}, {quoted(piece)}, ''))) // {len(piece)}"


def lines_of(text: str) -> str:
    parts = f"string_split_regex({text}, {quoted(LINE_END)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def volume(text: str) -> str:
    found = f"regexp_extract_all({text}, {quoted(TOKEN)})"
    kinds = f"len(list_distinct({found}))"
    return f"CASE WHEN {kinds} <= 1 THEN 1.0 ELSE greatest(len({found}) * log2({kinds}), 1.0) END"


MI = (
    f"round(least(greatest(171.0::DOUBLE - 5.2::DOUBLE * ln({volume('code')}) - 0.23::DOUBLE * cc - 16.2::DOUBLE * "
    "ln(greatest(code_lines, 1)), 0) * 100.0 / 171.0, 100.0), 2)"
)
AVG = "CASE WHEN n_functions = 0 THEN 0.0 ELSE round(sum_length::DOUBLE / n_functions, 2) END"
RISK = "CASE WHEN cc > 10 OR nesting > 3 THEN 'medium' ELSE 'low' END"
REASONS = (
    "concat_ws('; ', CASE WHEN cc > 10 THEN 'High cyclomatic complexity (' || cc || ')' END, "
    "CASE WHEN nesting > 3 THEN 'Deep nesting (' || nesting || ')' END)"
)
LAST = f"""fns AS (SELECT * FROM {E.FUNCTIONS}), lasts AS (
  SELECT k, name, arg_max(greatest(end_line - start_line + 1, 1), i) AS length, arg_max(cc, i) AS cc FROM fns GROUP BY k, name)"""

# ---- sources and sinks ----
SQL["s1_source_files"] = """
SELECT role, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
FROM (SELECT role, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM conversations)
GROUP BY role"""
_endings = [*EXTENSIONS, ".TXT", ".PY", "", "."]
_pick = " ".join(f"WHEN {i} THEN {quoted(e)}" for i, e in enumerate(_endings))
_lang = " ".join(f"WHEN {quoted(e)} THEN '{v}'" for e, v in EXTENSIONS.items())
SQL["s2_detect_language"] = f"""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % {len(_endings)} {_pick} END AS e FROM orders)
SELECT o_orderkey, 'a.b/f' || o_orderkey || e AS path, CASE lower(e) {_lang} END AS language FROM p"""


def uniform(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_number = "'syn_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END"
_sample = f"""
SELECT 'synthetic' AS project, {_number} AS commit_id, CAST({uniform('bug42')} < 0.3 AS INTEGER) AS target,
  replace(replace(CASE WHEN {uniform('bug42')} < 0.3 THEN {quoted(BUGGY_BODY)} ELSE {quoted(CLEAN_BODY)} END,
    '{{i}}', CAST(o_orderkey AS VARCHAR)), '{{n}}', CAST(CAST(floor({uniform('n42')} * 100) AS INTEGER) + 1 AS VARCHAR)) AS func
FROM orders"""
SQL["s3_labelled_code"] = f"SELECT project, commit_id, target, md5(func) AS func_md5 FROM ({_sample})"
_status = "CASE o_orderstatus WHEN 'O' THEN 'Accepted' WHEN 'F' THEN 'Wrong Answer' END"
SQL["s4_submissions"] = f"SELECT CAST(o_custkey AS VARCHAR) AS submission_id, {_status} AS status, count(*) AS n FROM orders GROUP BY ALL"
SQL["s5_feature_csvs"] = """
SELECT CAST(doc_id AS INTEGER) AS id, CAST(quality AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic FROM labels
UNION ALL SELECT CAST(doc_id AS INTEGER), NULL, CAST(toxic AS INTEGER) FROM labels"""
SQL["s6_load_dataset"] = "SELECT doc_id, quality, toxic FROM labels"


def split_key(column: str) -> str:
    return f"('0x' || substr(md5({column} || '#42'), 1, 15))::BIGINT"


def splits(column: str, stratum: str, source: str) -> str:
    return f"""SELECT *, CASE WHEN r >= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'test' WHEN r >= floor(n * 0.7::DOUBLE) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {split_key(column)}) - 1 AS r,
          count(*) OVER (PARTITION BY {stratum}) AS n FROM {source})"""


SQL["s7_train_and_validation"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, split AS part
FROM ({splits('doc_id', '1', 'labels')}) WHERE split <> 'test'"""
SQL["s8_save_dataset"] = "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name FROM supplier"
SQL["s9_sample_set"] = _sample
SQL["s10_synthetic_labels"] = f"SELECT {_number} AS key, CAST({uniform('label42')} < 0.3 AS INTEGER) AS target FROM orders"
SQL["s11_save_embeddings"] = """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(list_max(embedding) AS DOUBLE), 5) AS peak FROM embeddings"""
SQL["s12_load_embeddings"] = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(d AS INTEGER) AS d, round(CAST(embedding[d + 1] AS DOUBLE), 5) AS v FROM embeddings, range(0, 64) t(d)"
_values = {
    "total_lines": "total_lines", "code_lines": "code_lines", "blank_lines": "blank_lines",
    "comment_lines": "comment_lines", "function_count": "n_functions", "class_count": "n_classes",
    "loop_count": "n_loops", "condition_count": "n_conditions", "variable_count": "n_variables",
    "max_nesting_depth": "nesting", "cyclomatic_complexity": "cc", "avg_function_length": AVG,
    "max_function_length": "max_length", "maintainability_index": MI, "language": "lang",
    "risk_level": RISK, "risk_reasons": REASONS,
}
_texts = ["total_lines", "code_lines", "blank_lines", "comment_lines", "function_count", "class_count", "loop_count", "condition_count",
          "variable_count", "max_nesting_depth", "cyclomatic_complexity", "max_function_length", "language", "risk_level"]
SQL["s13_metrics_json"] = f"{WITH} SELECT file_id, " + ", ".join(f"CAST({_values[n]} AS VARCHAR) AS {n}" for n in _texts) + " FROM files WHERE ok"
_rows = " UNION ALL ".join(
    f"SELECT file_id, '{name}' AS metric, CAST({value} AS VARCHAR) AS value FROM files WHERE ok" for name, value in _values.items()
)
SQL["s14_metrics_rows"] = f"""{WITH}, {LAST}
{_rows} UNION ALL
SELECT CAST(c.key AS VARCHAR), 'per_function_length.' || {named('x.name')}, CAST(x.length AS VARCHAR) FROM corpus c JOIN lasts x ON c.k = x.k UNION ALL
SELECT CAST(c.key AS VARCHAR), 'per_function_complexity.' || {named('x.name')}, CAST(x.cc AS VARCHAR) FROM corpus c JOIN lasts x ON c.k = x.k"""
# Reports: counts of findings by severity, score, level and probability per file.
SCORED = f"""found AS (SELECT k AS fk, count(*) AS n, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
    count(*) FILTER (severity = 'LOW') AS low FROM {E.FINDINGS} GROUP BY k),
  scored AS (SELECT *, CASE WHEN score >= 7 THEN 'CRITICAL' WHEN score >= 4 THEN 'HIGH' WHEN score >= 1.5 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'SECURE' END AS level
    FROM (SELECT files.*, coalesce(n, 0) AS total, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
      least(10.0::DOUBLE, coalesce(high * 3.0 + medium * 1.5 + low * 0.5, 0)::DOUBLE) AS score
      FROM files LEFT JOIN found ON fk = k)),
  reports AS (SELECT *, round(least(0.99::DOUBLE, 0.1::DOUBLE + CASE WHEN cc > 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN nesting > 3 THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN total > 0 THEN 0.3::DOUBLE ELSE 0 END), 9) AS probability FROM scored)"""
REPORTS = f"{WITH}, {SCORED}"
SQL["s15_append_reports"] = f"{REPORTS} SELECT file_id AS id, lang AS language, level AS risk_level, 'first' AS load_id FROM reports"
SQL["s16_reports_table"] = f"{REPORTS} SELECT lang AS language, count(*) AS n FROM reports GROUP BY lang"
PRED = """pred AS (SELECT CAST(quality AS INTEGER) AS y_true, CAST(n_chars % 1000 / 1000.0::DOUBLE >= 0.5 AS INTEGER) AS y_pred, n_chars % 1000 / 1000.0::DOUBLE AS y_proba
  FROM documents JOIN labels USING (doc_id))"""


def scores(source: str) -> str:
    """One row of metrics; AUC counts the pairs won by positives, ties as half."""
    return f"""(SELECT hits / n::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
      coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
      (SELECT CASE WHEN sum(y_true) > 0 AND sum(1 - y_true) > 0 THEN
          (sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / (sum(y_true) * sum(1 - y_true)) ELSE 0.5 END
        FROM (SELECT y_true, avg(rn) OVER (PARTITION BY y_proba) AS r FROM (SELECT *, row_number() OVER (ORDER BY y_proba) AS rn FROM {source}))) AS roc_auc
      FROM (SELECT count(*) AS n, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
        count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = y_pred) AS hits FROM {source}))"""


_five = ", ".join(f"round({c}, 9) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))
SQL["s17_log_experiment"] = f"WITH {PRED} SELECT 8 AS id_digits, 'fixed_score' AS model, round(f1, 9) AS f1 FROM {scores('pred')}"
SQL["s18_save_results"] = f"WITH {PRED} SELECT {_five} FROM {scores('pred')}"
SQL["s19_save_tuning_results"] = f"""
WITH {PRED}, trials AS (SELECT cut, 2 * count(*) FILTER (y_true = 1 AND y_proba >= cut)
    / (count(*) FILTER (y_proba >= cut) + count(*) FILTER (y_true = 1))::DOUBLE AS value
  FROM pred, (SELECT i / 10.0::DOUBLE AS cut FROM range(1, 10) t(i)) GROUP BY cut)
SELECT round(max(value), 9) AS best_value, '{{"cut":' || CAST(arg_max(cut, value) AS VARCHAR) || '}}' AS best_params, count(*) AS n_trials FROM trials"""

# ---- parse and structure ----
SQL["a1_parse"] = f"{WITH} SELECT file_id, ok FROM files WHERE lang = 'python'"
SQL["a1_parse_errors"] = f"{WITH} SELECT file_id, lang AS language, 'SyntaxError' AS kind FROM files WHERE NOT ok"
SQL["a2_brace_languages"] = f"""{WITH}
SELECT file_id, u.kind, CAST(u.n AS BIGINT) AS n FROM (SELECT file_id, unnest([{{'kind': 'function_def', 'n': n_functions}}, {{'kind': 'loop', 'n': n_loops}},
  {{'kind': 'condition', 'n': n_conditions}}, {{'kind': 'variable', 'n': n_variables}}]) AS u FROM files WHERE lang <> 'python') WHERE u.n > 0"""
SQL["a3_walk"] = f"{WITH} SELECT file_id, CAST(n_nodes AS BIGINT) AS n_nodes, height FROM files WHERE ok"
SQL["a4_functions"] = facts(
    E.FUNCTIONS,
    f"{named('x.name')} AS name, start_line, end_line, params AS parameter_count, is_method, decorators, docstring",
)
SQL["a5_loops"] = facts(
    E.LOOPS,
    f"keyword, start_line, end_line, depth AS nesting_depth, {named('fn')} AS parent_function, target AS iteration_target",
)
SQL["a6_conditions"] = facts(
    E.CONDITIONS,
    f"keyword, start_line, end_line, has_else, branches AS branch_count, {named('fn')} AS parent_function",
)
SQL["a7_variables"] = facts(
    E.VARIABLES,
    f"{named('x.name')} AS name, line, scope, annotation AS type_annotation, {named('fn')} AS parent_function",
)
SQL["a8_nesting"] = f"{WITH} SELECT file_id, nesting AS max_nesting_depth FROM files WHERE ok"
SQL["a9_classes"] = f"{WITH} SELECT file_id, n_classes AS class_count FROM files WHERE ok"

# ---- metrics ----
SQL["m1_line_counts"] = f"{WITH} SELECT file_id, total_lines AS total, code_lines AS code, blank_lines AS blank, comment_lines AS comment FROM files"
SQL["m1_line_counts_text"] = f"""
WITH l AS (SELECT doc_id, list_transform({lines_of('text')}, lambda x: regexp_replace(x, '^[{SPACE}]+', '')) AS rows FROM documents),
c AS (SELECT doc_id, CAST(len(rows) AS INTEGER) AS total, CAST(len(list_filter(rows, lambda x: x = '')) AS INTEGER) AS blank,
  CAST(len(list_filter(rows, lambda x: starts_with(x, '#'))) AS INTEGER) AS comment FROM l)
SELECT CAST(doc_id AS VARCHAR) AS file_id, total, greatest(total - blank - comment, 0) AS code, blank, comment FROM c"""
SQL["m2_total_lines"] = f"SELECT page_id, CAST(len({lines_of('html')}) AS INTEGER) AS total_lines FROM pages"
SQL["m3_function_count"] = f"{WITH} SELECT file_id, n_functions AS function_count FROM files WHERE ok"
SQL["m4_average_length"] = f"{WITH} SELECT file_id, {AVG} AS avg_function_length FROM files WHERE ok"
SQL["m5_function_lengths"] = f"""{WITH}, {LAST}
SELECT c.file_id, max_length AS max_function_length, {named('x.name')} AS name, x.length FROM files c LEFT JOIN lasts x ON c.k = x.k WHERE ok"""
SQL["m6_cyclomatic"] = f"{WITH} SELECT file_id, cc AS cyclomatic_complexity FROM files WHERE ok AND lang = 'python'"
SQL["m7_cyclomatic_brace"] = f"{WITH} SELECT file_id, cc AS cyclomatic_complexity FROM files WHERE ok AND lang <> 'python'"
SQL["m8_cyclomatic_by_function"] = f"""WITH {CORPUS}, {LAST}
SELECT CAST(c.key AS VARCHAR) AS file_id, {named('x.name')} AS name, x.cc AS cyclomatic_complexity FROM corpus c JOIN lasts x ON c.k = x.k"""
SQL["m9_nesting"] = SQL["a8_nesting"]
SQL["m10_volume"] = f"WITH {CORPUS} SELECT CAST(key AS VARCHAR) AS file_id, round({volume('code')}, 6) AS volume FROM corpus"
SQL["m10_volume_text"] = f"SELECT CAST(doc_id AS VARCHAR) AS file_id, round({volume('text')}, 6) AS volume FROM documents"
SQL["m11_maintainability"] = f"{WITH} SELECT file_id, {MI} AS maintainability_index FROM files WHERE ok"
SQL["m12_risk"] = f"{WITH} SELECT file_id, {RISK} AS risk_level, {REASONS} AS reasons FROM files WHERE ok"
SQL["m13_file_metrics"] = f"{WITH} SELECT file_id, " + ", ".join(
    f"{value} AS {name}" for name, value in _values.items() if name != "risk_reasons"
) + " FROM files WHERE ok"
SQL["m14_breakdown"] = f"""WITH {CORPUS}, {LAST}
SELECT CAST(c.key AS VARCHAR) AS file_id, {named('x.name')} AS function_name, x.cc AS cyclomatic_complexity, x.length FROM corpus c JOIN lasts x ON c.k = x.k"""

# ---- complexity ----
SQL["c1_loop_nests"] = facts(
    E.NESTS,
    f"{named('x.name')} AS function_name, depth, types AS loop_types, start_line, end_line, has_break, has_return AS has_early_return",
)
SQL["c2_recursive"] = facts(E.ESTIMATES, f"{named('x.name')} AS name, called AS recursive")
SQL["c3_branches"] = facts(E.ESTIMATES, f"{named('x.name')} AS name, branches")
# Templates the whole-file detectors find something in.
for _query, _name, _found in (
    ("c4_binary_search", "binary_search", "6, 14"),
    ("c5_divide_and_conquer", "divide_and_conquer", "8"),
    ("c6_logarithmic_loop", "logarithmic_loop", "5, 6"),
    ("c7_sort_call", "sort_call", "8, 10, 19"),
):
    SQL[_query] = f"{WITH} SELECT file_id, k IN ({_found}) AS {_name} FROM files WHERE ok"
_estimate = f"""{named('x.name')} AS function_name, cls AS complexity_class, sure::DOUBLE AS confidence, pattern AS matched_pattern,
  recursive AS is_recursive, start_line, end_line"""
SQL["c8_estimates"] = facts(E.ESTIMATES, _estimate)
SQL["c9_estimates_in_order"] = facts(E.ESTIMATES, f"i AS walk_order, {named('x.name')} AS function_name")
_classes = list(CLASS_SEVERITY)
RULES = "(VALUES " + ", ".join(
    f"({quoted(r[0])}, {quoted(r[1])}, {r[2]}::DOUBLE, {quoted(r[3])}, {_classes.index(r[1])})" for r in COMPLEXITY_RULES
) + ") AS rules(pattern_name, complexity_class, confidence, category, class_rank)"
SQL["c10_rules"] = f"""WITH {CORPUS}, x AS (SELECT * FROM {E.ESTIMATES}), used AS (SELECT pattern, count(*) AS n FROM corpus c JOIN x ON c.k = x.k GROUP BY pattern)
SELECT pattern_name, complexity_class, confidence, category, class_rank, coalesce(n, 0) AS n FROM {RULES} LEFT JOIN used ON pattern = pattern_name"""
SQL["c11_match_rule"] = f"""
WITH w AS (SELECT o_orderkey, [' Binary_Search ', 'nested_loop', 'efficient', 'sort', 'xx_power_set_xx', 'none', 'MERGE_SORT'][o_orderkey % 7 + 1] AS lookup FROM orders),
r AS (SELECT * FROM {RULES}), looked AS (SELECT DISTINCT lookup, trim(lower(lookup)) AS key FROM w),
exact AS (SELECT lookup, pattern_name FROM looked JOIN r ON key = pattern_name),
near AS (SELECT lookup, min(pattern_name) AS pattern_name FROM looked JOIN r ON contains(pattern_name, key) OR contains(key, pattern_name)
  WHERE lookup NOT IN (SELECT lookup FROM exact) GROUP BY lookup HAVING count(*) = 1),
matched AS (SELECT * FROM exact UNION ALL SELECT * FROM near)
SELECT o_orderkey, w.lookup, matched.pattern_name, complexity_class FROM w LEFT JOIN matched ON w.lookup = matched.lookup LEFT JOIN r ON r.pattern_name = matched.pattern_name"""
_used = f"""WITH {CORPUS}, x AS (SELECT * FROM {E.ESTIMATES})
SELECT pattern_name, category, complexity_class, count(*) AS n FROM corpus c JOIN x ON c.k = x.k JOIN {RULES} ON pattern = pattern_name"""
SQL["c12_rules_by_category"] = f"{_used} WHERE category = 'iterative' GROUP BY ALL"
SQL["c13_rules_by_class"] = f"{_used} WHERE complexity_class = 'O(log n)' GROUP BY ALL"
_severity = " ".join(f"WHEN {quoted(c)} THEN '{s}'" for c, s in CLASS_SEVERITY.items())
_rank = " ".join(f"WHEN {quoted(c)} THEN {i}" for i, c in enumerate(_classes))
SQL["c14_severity"] = facts(
    E.ESTIMATES, f"{named('x.name')} AS function_name, CASE cls {_severity} END AS severity, CASE cls {_rank} END AS class_rank"
)
SQL["c15_file_summary"] = f"""{WITH}, x AS (SELECT * FROM {E.ESTIMATES})
SELECT c.file_id, CAST(count(x.k) AS INTEGER) AS function_count, arg_max(cls, (CASE cls {_rank} END) * 100 - i) AS worst_case_complexity,
  arg_max({named('x.name')}, (CASE cls {_rank} END) * 100 - i) AS worst_case_function,
  CASE WHEN count(x.k) > 0 THEN CAST(count(*) FILTER (recursive) AS INTEGER) END AS recursive_functions, round(avg(sure::DOUBLE), 2) AS average_confidence,
  CASE WHEN count(x.k) > 0 THEN CAST(count(DISTINCT cls) AS INTEGER) END AS n_classes
FROM files c LEFT JOIN x ON c.k = x.k WHERE ok AND lang = 'python' GROUP BY c.key, c.file_id"""
SQL["c16_worst_first"] = facts(
    E.ESTIMATES, f"CASE cls {_rank} END AS class_rank, i AS walk_order, {named('x.name')} AS function_name"
)
_explained = f"""'Function ''' || {named('x.name')} || '''' || CASE pattern
  WHEN 'divide_and_conquer' THEN ' uses a divide-and-conquer pattern: it splits the input and makes ' || branches || ' recursive calls.'
  WHEN 'exponential_recursion' THEN ' makes ' || branches || ' recursive calls without clear input splitting — likely exponential.'
  WHEN 'binary_search' THEN ' contains a binary search pattern (midpoint calculation with bound adjustments).'
  WHEN 'linear_recursion' THEN ' makes a single recursive call — likely linear recursion.'
  WHEN 'logarithmic_loop' THEN ' contains a loop whose counter doubles or halves each iteration.'
  WHEN 'nested_loop_3' THEN ' has ' || depth || '-deep nested loops.'
  WHEN 'nested_loop_2' THEN ' has doubly-nested loops.'
  WHEN 'efficient_sort' THEN ' calls a built-in sort function.'
  WHEN 'single_loop' THEN ' contains a single (non-nested) loop.'
  ELSE ' has no loops or recursion — constant time.' END"""
SQL["c17_csv_rows"] = facts(
    E.ESTIMATES,
    f"""{named('x.name')} AS function_name, cls AS complexity_class, format('{{:.2f}}', sure::DOUBLE) AS confidence, pattern AS matched_pattern,
    recursive AS is_recursive, start_line, end_line, depth AS max_loop_depth, {_explained} AS explanation""",
)

# ---- security ----
_at = {name: i for i, name in enumerate(SECURITY_FIELDS)}
SECURITY = "(VALUES " + ", ".join(
    "(" + ", ".join([str(i), *[quoted(r[_at[c]]) for c in ("rule_id", "rule_name", "severity", "cwe_id", "pattern_type", "language")]]) + ")"
    for i, r in enumerate(SECURITY_RULES)
) + ") AS rules(rule_order, rule_id, rule_name, severity, cwe_id, pattern_type, language)"
_counted = f"""WITH {CORPUS}, x AS (SELECT * FROM {E.FINDINGS}), used AS (SELECT rule_id, count(*) AS n FROM corpus c JOIN x ON c.k = x.k GROUP BY rule_id)
SELECT r.rule_id, rule_name, severity, cwe_id, pattern_type, language, coalesce(n, 0) AS n FROM (SELECT * FROM {SECURITY}) r LEFT JOIN used ON r.rule_id = used.rule_id"""
SQL["v1_rules"] = _counted
SQL["v2_rules_by_severity"] = f"{_counted} WHERE severity = 'HIGH'"
SQL["v3_rules_by_language"] = f"{_counted} WHERE language IN ('all', 'c')"
SQL["v4_rule_by_cwe"] = f"""
WITH w AS (SELECT o_orderkey, ['cwe-89', 'CWE-798', 'CWE-0', 'cwe-22'][o_orderkey % 4 + 1] AS cwe_id FROM orders),
r AS (SELECT upper(cwe_id) AS key, arg_min(rule_id, rule_order) AS rule_id, arg_min(severity, rule_order) AS severity FROM {SECURITY} GROUP BY ALL)
SELECT o_orderkey, w.cwe_id, r.rule_id, r.severity FROM w LEFT JOIN r ON upper(w.cwe_id) = r.key"""
_col = "CAST(col + CASE WHEN c.k = 19 THEN length(m) - 1 ELSE 0 END AS INTEGER) AS \"column\""
_snippet = "replace(snippet, '{m}', m) AS code_snippet"
SQL["v5_line_findings"] = facts(
    E.FINDINGS, f"rule_id, severity, line AS line_number, {_col}, {_snippet}", "rule_id NOT IN ('SEC-002', 'SEC-016')"
)


def re2(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{SPACE}]").replace(r"\w", f"[{WORD}]")


_lines = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents"
_strip = f"regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_scans = [
    f"""SELECT CAST(doc_id AS VARCHAR) AS file_id, '{r[0]}' AS rule_id, CAST(n AS INTEGER) AS line_number,
  CAST(length(regexp_extract(line, {quoted('(?s)^(.*?)(?:' + re2(r[_at['pattern']]) + ')')}, 1)) AS INTEGER) AS "column", {_strip} AS code_snippet
FROM lines WHERE regexp_matches(line, {quoted(re2(r[_at['pattern']]))})"""
    for r in SECURITY_RULES
    if r[_at["pattern_type"]] == "regex" and r[_at["language"]] in ("all", "python")
]
SQL["v5_line_findings_text"] = f"WITH lines AS ({_lines}) " + " UNION ALL ".join(_scans)
SQL["v5_custom_rules"] = f"""WITH lines AS ({_lines})
SELECT 'X-1' AS rule_id, count(*) AS n, CAST(sum(length(regexp_extract(line, '(?s)^(.*?)@[{WORD}]+\\.', 1))) AS BIGINT) AS columns FROM lines WHERE regexp_matches(line, '@[{WORD}]+\\.') HAVING count(*) > 0
UNION ALL SELECT 'X-2', count(*), CAST(0 AS BIGINT) FROM lines WHERE regexp_matches(line, '^[{WORD}]+[{SPACE}]') HAVING count(*) > 0"""
SQL["v6_call_findings"] = facts(
    E.FINDINGS,
    f"CAST(row_number() OVER (PARTITION BY c.key ORDER BY i) - 1 AS INTEGER) AS finding_order, rule_id, line AS line_number, {_col}, {_snippet}, c.path AS file_path",
    "rule_id IN ('SEC-002', 'SEC-016')",
)
SQL["v7_findings"] = facts(E.FINDINGS, f"i AS finding_order, rule_id, severity, line AS line_number, {_col}, {_snippet}")
SQL["v8_severity_counts"] = f"""{REPORTS} SELECT file_id, CAST(total AS INTEGER) AS total_findings, CAST(high AS INTEGER) AS high_severity,
  CAST(medium AS INTEGER) AS medium_severity, CAST(low AS INTEGER) AS low_severity FROM reports"""
SQL["v9_risk_score"] = f"{REPORTS} SELECT file_id, score AS risk_score FROM reports"
SQL["v10_risk_level"] = f"{REPORTS} SELECT file_id, level AS risk_level FROM reports"
SQL["v11_json_reports"] = f"""{REPORTS}, listed AS (SELECT k AS fk1, array_to_string(list_sort(list(rule_id || ':' || line || ':' || severity)), ',') AS findings
  FROM {E.FINDINGS} GROUP BY k)
SELECT file_id, level AS risk_level, CAST(total AS INTEGER) AS total, coalesce(findings, '') AS findings FROM reports LEFT JOIN listed ON fk1 = k"""

# ---- features, labels, datasets ----
_lead = SPACE.replace(r"\t-\r", r"\t\x0b-\r")


def ratio(text: str) -> str:
    return f"round(len(regexp_extract_all({text}, '(?m)^[{_lead}]*(#|//)')) / ({count(text, chr(10))} + 1)::DOUBLE, 9)"


def ints(columns: dict[str, str], stop: str) -> str:
    return ", ".join(f"CAST(CASE WHEN {stop} THEN 0 ELSE {v} END AS INTEGER) AS {n}" for n, v in columns.items())


def text_counts(text: str, functions: str) -> dict[str, str]:
    words = f"string_split_regex({text}, '[{SPACE}]+')"
    operators = " + ".join(count(text, op) for op in ("+", "-", "*", "/", "==", "!=", ">", "<"))
    return {
        "has_recursion": f"CASE WHEN contains({text}, 'return') AND {functions} > 0 THEN 1 ELSE 0 END",
        "import_count": f"{count(text, 'import ')} + {count(text, 'from ')}",
        "operator_count": operators,
        "string_literal_count": f"({count(text, chr(34))}) // 2 + ({count(text, chr(39))}) // 2",
        "numeric_literal_count": f"len(list_filter({words}, lambda w: regexp_full_match(w, '[{DIGIT}]+')))",
    }


SQL["f1_lexical"] = f"""SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST({count('text', chr(10))} + 1 AS INTEGER) AS line_count, {ratio('text')} AS comment_ratio FROM documents"""
_structure = {
    "loop_count": "CASE WHEN lang = 'python' THEN n_loops ELSE 0 END",
    "condition_count": "CASE WHEN lang = 'python' THEN n_conditions ELSE 0 END",
    "function_count": "n_functions",
    "max_nesting_depth": "nesting",
    "cyclomatic_complexity": "cc",
    "variable_count": "CASE WHEN lang = 'python' THEN n_variables ELSE 0 END",
}
_failed = "(NOT ok OR k = 15)"
SQL["f2_structural"] = f"{WITH} SELECT file_id AS id, {ints(_structure, 'FALSE')}, {AVG} AS avg_function_length FROM files WHERE NOT {_failed}"


def added(text: str, *pieces: str) -> str:
    return " + ".join(count(text, p) for p in pieces)


_rough = {
    "loop_count": added("text", "for ", "while "),
    "condition_count": added("text", "if ", "elif "),
    "function_count": added("text", "def ", "function "),
    "max_nesting_depth": f"list_max(list_transform(string_split(text, chr(10)), lambda x: length(x) - length(regexp_replace(x, '^[{SPACE}]+', '')))) // 4",
    "cyclomatic_complexity": added("text", "if ", "for ", "while ") + " + 1",
}
_blank = f"NOT regexp_matches(text, '[^{SPACE}]')"
SQL["f3_rough"] = f"SELECT doc_id AS id, {ints(_rough, _blank)}, {_blank} AS error FROM documents"
_text = text_counts("text", f"({_rough['function_count']})")
SQL["f4_text"] = f"SELECT doc_id AS id, {ints(_text, _blank)} FROM documents"
SQL["f5_features"] = f"""{WITH} SELECT file_id AS id, {ints(_structure, _failed)}, CASE WHEN {_failed} THEN 0.0 ELSE {AVG} END AS avg_function_length,
  {ints({'line_count': count('code', chr(10)) + ' + 1'}, 'k = 15')}, CASE WHEN k = 15 THEN 0.0 ELSE {ratio('code')} END AS comment_ratio,
  {ints(text_counts('code', 'n_functions'), _failed)}, {_failed} AS error FROM files"""
SQL["f6_batch"] = f"""
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS id, {ints({'line_count': count('text', chr(10)) + ' + 1'}, _blank)}, {_blank} AS error FROM benchmark"""
SQL["f7_valid"] = f"{WITH} SELECT file_id AS id, {ints({'line_count': count('code', chr(10)) + ' + 1'}, 'FALSE')} FROM files WHERE NOT {_failed}"
_all = {
    **{n: f"CAST({v} AS DOUBLE)" for n, v in _rough.items()},
    "avg_function_length": "0.0::DOUBLE",
    "line_count": f"CAST({count('text', chr(10))} + 1 AS DOUBLE)",
    "comment_ratio": f"len(regexp_extract_all(text, '(?m)^[{_lead}]*(#|//)')) / ({count('text', chr(10))} + 1)::DOUBLE",
    "variable_count": "0.0::DOUBLE",
    **{n: f"CAST({v} AS DOUBLE)" for n, v in _text.items()},
}
SQL["f8_clean"] = (
    "WITH raw AS (SELECT doc_id AS id, " + ", ".join(f"{v} AS {n}" for n, v in _all.items())
    + f" FROM documents WHERE NOT ({_blank})), lim AS (SELECT " + ", ".join(f"quantile_cont({n}, 0.99) AS {n}" for n in _all)
    + " FROM raw) SELECT raw.id, " + ", ".join(f"round(least(raw.{n}, lim.{n}), 6) AS {n}" for n in _all) + " FROM raw, lim"
)
SQL["l1_submission_labels"] = f"""
SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(CASE WHEN {_status} = 'Accepted' THEN 0 ELSE 1 END, o_orderkey) AS target FROM orders GROUP BY ALL"""
SQL["l2_code_labels"] = """
SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN 'p' || (o_custkey % 50) END, 'unk') || '_' ||
  CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || (o_orderkey % 1000) ELSE CAST(o_orderkey AS VARCHAR) END AS key,
  arg_max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey) AS target
FROM orders WHERE o_orderkey % 97 <> 5 GROUP BY ALL"""
SQL["l3_verdict_labels"] = """
SELECT conv_id || '-' || turn AS key, CASE WHEN regexp_matches(lower(text), 'error|fail|bug|vulnerable|reject|wrong') THEN 1 ELSE 0 END AS target FROM conversations"""
SQL["l4_align"] = "SELECT d.doc_id AS id, lang, coalesce(CAST(quality AS INTEGER), 0) AS target FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SQL["l5_label_statistics"] = """
SELECT count(*) AS total, count(*) FILTER (quality = 1) AS buggy, count(*) FILTER (quality <> 1) AS clean,
  count(*) FILTER (quality = 1) / count(*)::DOUBLE AS buggy_ratio FROM labels"""
SQL["d1_splits"] = f"SELECT doc_id AS id, quality AS target, split FROM ({splits('doc_id', 'quality', 'labels')})"
SQL["d2_statistics"] = """
SELECT count(*) AS total_rows, count(*) FILTER (lang IS NULL) AS missing_lang, count(*) FILTER (toxic IS NULL) AS missing_toxic,
  count(*) FILTER (quality IS NULL) AS missing_target,
  round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 9) AS buggy_ratio, 'lang,n_chars,toxic' AS features
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
SQL["d2_class_distribution"] = "SELECT quality AS target, count(*) AS n FROM labels GROUP BY quality"
SQL["d3_validate"] = """
WITH f AS (SELECT count(*) FILTER (toxic IS NULL) + count(*) FILTER (lang IS NULL) AS nulls FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 0 AS position, 'Only one class present in ''target''. ML models need at least two classes.' AS issue
UNION ALL SELECT 1, 'Found ' || nulls || ' missing values across all columns.' FROM f
UNION ALL SELECT 2, 'Feature ''flat'' has zero variance (constant value).'"""

# ---- models ----
_order = ["loop_count", "condition_count", "function_count", "max_nesting_depth", "cyclomatic_complexity", "line_count",
          "comment_ratio", "has_recursion", "import_count", "operator_count", "string_literal_count", "numeric_literal_count"]
SQL["e1_preprocess"] = (
    "SELECT d.doc_id AS id, CAST(quality AS DOUBLE) AS target, 14 AS width, round(CASE WHEN " + _blank + " THEN 0 ELSE "
    + " + ".join(f"({_all[n]})" for n in _order) + " END, 6) AS total FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)
_learned = "TRUE AS in_range, TRUE AS by_rule, TRUE AS learned"
for _name in ("e2_random_forest", "e3_boosted_trees", "e4_train_with_smote", "t12_score"):
    SQL[_name] = f"SELECT doc_id AS id, CAST(quality AS INTEGER) AS y_true, {_learned} FROM documents JOIN labels USING (doc_id)"
for _name in ("t9_mlp", "t10_fused_boosted"):
    SQL[_name] = f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(quality AS INTEGER) AS y_true, {_learned} FROM embeddings JOIN labels ON vec_id = doc_id JOIN documents USING (doc_id)"
SQL["t9_epoch_log"] = "SELECT CAST(50 AS BIGINT) AS epochs, CAST(1 AS BIGINT) AS best_epochs, true AS is_highest, true AS loss_falls, true AS learned, true AS returned"
SQL["e4_smote"] = """
WITH c AS (SELECT CAST(quality AS DOUBLE) AS target, count(*) AS n FROM labels GROUP BY ALL), m AS (SELECT max(n) AS most FROM c)
SELECT target, most AS n, most - n AS new, CAST(0 AS BIGINT) AS outside, most AS ids FROM c, m"""
SQL["e5_cross_validate"] = f"""
WITH r AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY {split_key('doc_id')}) - 1) % 5 AS fold FROM labels)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, TRUE AS in_range, TRUE AS learned FROM r GROUP BY fold"""
_features = ", ".join(f"('{f}')" for f in FEATURES)
SQL["e10_importances"] = f"SELECT f AS feature, TRUE AS in_range, 1.0::DOUBLE AS total FROM (VALUES {_features}) t(f) WHERE (SELECT count(*) FROM labels) > 0"


def _searched(trials: int) -> str:
    return f"SELECT CAST({trials} AS BIGINT) AS trials, CAST({trials} AS BIGINT) AS settings, CAST({trials} AS BIGINT) AS in_range, TRUE AS learned WHERE (SELECT count(*) FROM labels) > 0"


SQL["e13_grid_search_forest"] = _searched(18)
SQL["e14_grid_search_boosted"] = _searched(8)
SQL["e15_trial_search"] = _searched(20)
SQL["e15_trial_search_boosted"] = _searched(4)
SQL["e6_metrics"] = SQL["s18_save_results"]
SQL["e7_confusion_matrix"] = f"""WITH {PRED}
SELECT t AS y_true, p AS y_pred, count(y_true) AS count FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(t, p)
LEFT JOIN pred ON y_true = t AND y_pred = p GROUP BY ALL"""
_curve = f"""WITH {PRED}, s AS (SELECT y_proba AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred GROUP BY y_proba),
cum AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s WINDOW w AS (ORDER BY threshold DESC))"""
SQL["e8_roc_points"] = f"{_curve} SELECT round(fp / n::DOUBLE, 9) AS fpr, round(tp / p::DOUBLE, 9) AS tpr, round(threshold, 9) AS threshold FROM cum UNION ALL SELECT 0.0, 0.0, 'Infinity'::DOUBLE"
SQL["e9_precision_recall"] = f"""{_curve} SELECT round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall, round(threshold, 9) AS threshold FROM cum
UNION ALL SELECT 1.0, 0.0, NULL"""
SQL["e11_report"] = f"""WITH {PRED}, c AS (SELECT v AS c, CASE v WHEN 0 THEN 'Clean (0)' ELSE 'Buggy (1)' END AS label,
  count(*) FILTER (y_true = v AND y_pred = v) AS tp, count(*) FILTER (y_pred = v) AS predicted, count(*) FILTER (y_true = v) AS support
  FROM pred, (VALUES (0), (1)) t(v) GROUP BY v),
r AS (SELECT label, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, support, tp FROM c), a AS (
SELECT label, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM a"""
SQL["e12_compare_models"] = f"""WITH {PRED}, flipped AS (SELECT y_true, 1 - y_pred AS y_pred, 1 - y_proba AS y_proba FROM pred)
SELECT 'score' AS model, round(f1, 9) AS f1, round(roc_auc, 9) AS roc_auc FROM {scores('pred')}
UNION ALL SELECT 'flipped', round(f1, 9), round(roc_auc, 9) FROM {scores('flipped')}"""
SQL["e16_save_and_load"] = "SELECT count(*) AS n, count(*) AS alike FROM labels"
SQL["e17_latest"] = "SELECT count(*) AS n, count(*) AS alike, TRUE AS older_differs FROM labels"
SQL["e18_versions"] = """SELECT '2024010' || v || '_000000' AS version, v > 1 AS kept FROM (VALUES (1), (2), (3), (4)) t(v) WHERE (SELECT count(*) FROM labels) > 0"""

# ---- tokens and embeddings ----


def token_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(TOKEN)}))"


SQL["t1_tokenize"] = f"SELECT CAST(doc_id AS VARCHAR) AS file_id, 512 AS length, CAST(least({token_count('text')}, 512) AS INTEGER) AS tokens FROM documents"
SQL["t2_attention_mask"] = f"""WITH n AS (SELECT conv_id, turn, {token_count('text')} AS n FROM conversations), w AS (SELECT max(n) AS w FROM n)
SELECT conv_id, turn, repeat('1', CAST(n AS INTEGER)) || repeat('0', CAST(w - n AS INTEGER)) AS mask FROM n, w"""
SQL["t3_truncate"] = f"""
WITH p AS (SELECT page_id, replace(html, '<p>', chr(10) || '<p>') AS t FROM pages),
q AS (SELECT page_id, t, string_split(t, chr(10)) AS rows, len(regexp_extract_all(t, '[^{SPACE}]+')) AS words FROM p),
c AS (SELECT page_id, CASE WHEN words * 1.5 > 150 AND len(rows) > 10 THEN array_to_string(rows[1:6], chr(10)) || chr(10) || '... [TRUNCATED] ...' || chr(10)
  || array_to_string(rows[-4:], chr(10)) ELSE t END AS cut FROM q)
SELECT page_id, CAST(length(cut) AS INTEGER) AS chars, md5(cut) AS digest FROM c"""
SQL["t4_token_statistics"] = f"""WITH l AS (SELECT CAST({token_count('text')} AS DOUBLE) AS n FROM documents)
SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90,
  round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM l"""
SQL["t5_cls_embedding"] = """
SELECT vec_id, CAST(d - 1 AS INTEGER) AS d, round(CAST(embedding[d] AS DOUBLE), 6) AS v FROM embeddings, range(1, 17) t(d)"""
SQL["t6_mean_pooled"] = """
SELECT vec_id, CAST(d AS INTEGER) AS d, round(sum(CASE WHEN (vec_id + p) % 3 <> 0 THEN CAST(embedding[p * 16 + d + 1] AS DOUBLE) ELSE 0 END)
  / greatest(count(*) FILTER ((vec_id + p) % 3 <> 0), 1e-9), 6) AS v
FROM embeddings, range(0, 16) t(d), range(0, 4) u(p) GROUP BY vec_id, d"""
SQL["t7_extract_embeddings"] = f"SELECT CAST(doc_id AS VARCHAR) AS file_id, 64 AS dims, {token_count('text')} AS tokens FROM documents"
SQL["t8_fuse"] = """
WITH b AS (SELECT *, CAST(label AS DOUBLE) AS a, CAST(vec_id % 7 AS DOUBLE) AS b FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS id, 66 AS width, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS x0, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS x1,
  round(CAST(embedding[1] AS DOUBLE), 6) AS x2, round(CAST(embedding[2] AS DOUBLE), 6) AS x3 FROM b"""
SQL["t8_fuse_reduced"] = "SELECT CAST(vec_id AS VARCHAR) AS id, 22 AS width FROM embeddings JOIN labels ON vec_id = doc_id"
SQL["t11_baseline"] = f"""WITH {PRED}, strict AS (SELECT y_true, CAST(y_proba >= 0.7 AS INTEGER) AS y_pred, y_proba FROM pred),
o AS (SELECT * FROM {scores('pred')}), s AS (SELECT * FROM {scores('strict')}),
j AS (SELECT 'accuracy' AS metric, o.accuracy AS base, s.accuracy AS new FROM o, s UNION ALL SELECT 'precision', o.precision, s.precision FROM o, s
  UNION ALL SELECT 'recall', o.recall, s.recall FROM o, s UNION ALL SELECT 'f1', o.f1, s.f1 FROM o, s UNION ALL SELECT 'roc_auc', o.roc_auc, s.roc_auc FROM o, s)
SELECT metric, round(new - base, 9) AS diff, round(CASE WHEN base > 0 THEN (new - base) / base * 100 ELSE 0 END, 9) AS percent_improvement FROM j"""

# ---- reports and streams ----
_total = "CASE WHEN ok THEN total_lines ELSE " + count("code", chr(10)) + " + 1 END"
SQL["r1_analyze"] = f"""{REPORTS}, est AS (SELECT k AS ek, count(*) AS n_est FROM {E.ESTIMATES} GROUP BY k)
SELECT file_id AS id, lang AS language, sha256(code) AS code_hash, level AS risk_level, probability AS bug_probability,
  CAST(coalesce(n_functions, 0) AS INTEGER) AS function_count, CAST(coalesce(nesting, 0) AS INTEGER) AS max_nesting_depth, CAST({_total} AS INTEGER) AS total_lines,
  CASE WHEN ok THEN {AVG} ELSE 0.0 END AS avg_function_length, CAST(coalesce(cc, 0) AS INTEGER) AS cyclomatic_complexity,
  CAST(coalesce(n_est, 0) AS INTEGER) AS n_estimates, CAST(total AS INTEGER) AS n_issues FROM reports LEFT JOIN est ON ek = k"""
SQL["r1_rejects"] = """SELECT CAST(doc_id AS VARCHAR) AS file_id, 'Code too large. Maximum 100,000 characters.' AS reason FROM documents WHERE length(text) * 12 > 100000"""
SQL["r2_code_hash"] = "SELECT CAST(doc_id AS VARCHAR) AS file_id, sha256(text) AS code_hash FROM documents"
SQL["r3_bug_probability"] = f"{REPORTS} SELECT file_id AS id, probability AS bug_probability FROM reports"
_loads = "SELECT file_id, key, level, CASE WHEN key % 12 <> 5 THEN lang END AS lang FROM reports"
SQL["r4_report_by_id"] = f"{REPORTS} SELECT file_id AS id, lang AS language, level AS risk_level, 'load-' || key % 12 AS load_id FROM ({_loads}) WHERE file_id IN ('13', '17', '21')"
SQL["r5_list_reports"] = f"""{REPORTS} SELECT file_id AS id, level AS risk_level, make_timestamp(key * 1000000) AS created_at,
  (SELECT count(*) FROM ({_loads}) WHERE lang = 'python') AS total FROM ({_loads}) WHERE lang = 'python' ORDER BY key DESC, file_id LIMIT 40 OFFSET 20"""
SQL["r6_summary_stats"] = f"""{REPORTS} SELECT level AS risk_level, count(*) AS analyses, round(avg(probability), 9) AS average_bug_probability FROM reports GROUP BY ROLLUP (level)"""
SQL["r7_delete"] = f"{REPORTS} SELECT lang AS language, count(*) AS n FROM ({_loads}) WHERE key NOT IN (SELECT s_suppkey FROM supplier) GROUP BY lang"
SQL["r8_response"] = f"""{REPORTS}, est AS (SELECT k AS ek, count(*) AS n_est FROM {E.ESTIMATES} GROUP BY k)
SELECT file_id AS analysis_id, CAST(CASE WHEN key % 3 = 0 THEN 0 ELSE coalesce(n_est, 0) END AS INTEGER) AS n_estimates, CAST(total AS INTEGER) AS n_issues,
  CAST(CASE WHEN key % 3 = 0 THEN 0 ELSE {_total} END AS INTEGER) AS total_lines FROM reports LEFT JOIN est ON ek = k"""
_offered = ", ".join(f"('{name}')" for name in OFFERED_LANGUAGES)
SQL["r9_languages"] = f"""{WITH} SELECT l AS language, count(files.k) AS n FROM (VALUES {_offered}) o(l) LEFT JOIN files ON files.lang = l GROUP BY l"""
SQL["r10_analyze_stream"] = f"{REPORTS} SELECT file_id AS id, lang AS language, level AS risk_level FROM reports"
SQL["r11_stats_stream"] = f"""{REPORTS} SELECT level AS risk_level, count(*) AS analyses, round(avg(probability), 9) AS average_bug_probability FROM reports GROUP BY level"""
