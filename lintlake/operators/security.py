"""Security findings by line patterns and by calls, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import nodes as N
from lintlake.functions import text as X
from lintlake.operators.catalog import SECURITY_FIELDS, SECURITY_RULES
from lintlake.operators.parse import with_nodes

# Points per finding, the cap, and the lowest score of each level.
POINTS = {"HIGH": 3.0, "MEDIUM": 1.5, "LOW": 0.5}
SCORE_CAP = 10.0
LEVELS = [("CRITICAL", 7.0), ("HIGH", 4.0), ("MEDIUM", 1.5)]
# Text that any match of a rule contains, so that most lines and files are passed
# over by a literal search. Upper and lower case are told apart where the pattern does.
LITERALS = {
    "SEC-001": ["+"],
    "SEC-003": [".."],
    "SEC-004": ["strcpy"],
    "SEC-005": ["free"],
    "SEC-006": ["NULL;"],
    "SEC-007": ["="],
    "SEC-008": ["random()", "rand()"],
    "SEC-009": ["request."],
    "SEC-010": ["innerHTML"],
    "SEC-011": ["pickle.loads", "yaml.load"],
    "SEC-012": ["while"],
    "SEC-013": ["print", "console.error"],
    "SEC-014": ["except"],
    "SEC-015": ["gets", "tempnam", "mktemp"],
}

RULE_COLUMNS = ["rule_id", "rule_name", "severity", "cwe_id", "description", "remediation"]
EMPTY = "array<struct<rule_order:int,line_number:int,column:int,code_snippet:string>>"


def java_pattern(pattern: str) -> str:
    """The pattern with Python's meaning of white space, word characters and line ends."""
    return "(?Ud)" + pattern.replace(r"\s", f"[{X.SPACE}]").replace(r"\w", f"[{X.WORD}]")


def _rules(kind: str):
    for order, values in enumerate(SECURITY_RULES):
        rule = dict(zip(SECURITY_FIELDS, values))
        if rule["pattern_type"] == kind:
            yield order, rule


def _place(order: int, line: Column, column: Column, text: Column) -> Column:
    return F.struct(
        F.lit(order).alias("rule_order"),
        line.cast("int").alias("line_number"),
        column.cast("int").alias("column"),
        X.strip(text).alias("code_snippet"),
    )


def _with_rules(places: Column) -> Column:
    """Add the columns of its rule to each place."""
    catalogue = F.array(
        *[
            F.struct(*[F.lit(rule[n]).alias(n) for n in RULE_COLUMNS])
            for rule in (dict(zip(SECURITY_FIELDS, values)) for values in SECURITY_RULES)
        ]
    )

    def full(p: Column) -> Column:
        rule = F.get(catalogue, p["rule_order"])
        return F.struct(
            *[rule[n].alias(n) for n in RULE_COLUMNS[:4]],
            *[p[n].alias(n) for n in ("line_number", "column", "code_snippet")],
            *[rule[n].alias(n) for n in RULE_COLUMNS[4:]],
        )

    return F.transform(places, full)


def _holds_any(text: Column, literals: list[str]) -> Column:
    found = text.contains(literals[0])
    for literal in literals[1:]:
        found = found | text.contains(literal)
    return found


def _rule_places(numbered: Column, order: int, rule: dict) -> Column:
    pattern, literals = java_pattern(rule["pattern"]), LITERALS[rule["rule_id"]]
    hits = F.filter(
        numbered, lambda x: _holds_any(x["text"], literals) & x["text"].rlike(pattern)
    )
    return F.transform(
        hits,
        lambda x: _place(
            order, x["i"] + 1, F.regexp_instr(x["text"], F.lit(pattern)) - 1, x["text"]
        ),
    )


def _line_places(code: Column, language: Column) -> Column:
    """First match of each rule on each line, in rule order.

    Patterns are literals, so each is compiled once per task. A file is split into lines once, and
    only when it holds the literal text of some rule.
    """
    none = F.array().cast(EMPTY)
    applying = []
    for order, rule in _rules("regex"):
        applies = _holds_any(code, LITERALS[rule["rule_id"]])
        if rule["language"] != "all":
            applies = (F.lower(language) == rule["language"]) & applies
        applying.append((order, rule, applies))

    def over(numbered: Column) -> Column:
        found = [F.when(a, _rule_places(numbered, o, r)).otherwise(none) for o, r, a in applying]
        return F.flatten(F.array(*found))

    some = applying[0][2]
    for _, _, a in applying[1:]:
        some = some | a
    numbered = F.transform(X.lines(code), lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    return F.when(some, X.let(numbered, over)).otherwise(none)


def line_findings(code: Column, language: Column) -> Column:
    return _with_rules(_line_places(code, language))


def _call_places(code: Column, language: Column, nodes: Column) -> Column:
    """Calls of ``eval`` and ``os.system`` in walk order; none when the file does not parse."""
    rules = {rule["pattern"]: order for order, rule in _rules("ast")}

    def is_eval(n: Column) -> Column:
        return n["name"] == "eval"

    def is_system(n: Column) -> Column:
        return (n["base"] == "os") & (n["attr"] == "system")

    def locate(rows: Column) -> Column:
        def describe(n: Column) -> Column:
            text = F.coalesce(F.get(rows, n["lineno"] - 1), F.lit(""))
            place = (n["lineno"], n["col"], text)
            return F.when(is_eval(n), _place(rules["eval_call"], *place)).otherwise(
                _place(rules["os_system_call"], *place)
            )

        return F.transform(
            F.filter(nodes, lambda n: (n["kind"] == "Call") & (is_eval(n) | is_system(n))), describe
        )

    listed = F.exists(nodes, lambda n: (n["kind"] == "Call") & (is_eval(n) | is_system(n)))
    return F.when((F.lower(language) == "python") & listed, X.let(X.lines(code), locate)).otherwise(
        F.array().cast(EMPTY)
    )


def may_call(code: Column, language: Column) -> Column:
    """Whether a file can hold a call that the rules look for; most need not be parsed to know.

    A name stands in the text as it is, unless it is written in other than ASCII characters, which
    Python takes for their plain forms.
    """
    named = code.contains("eval") | code.contains("system")
    return (F.lower(language) == "python") & (named | (F.length(code) != F.octet_length(code)))


def with_call_nodes(files: DataFrame) -> DataFrame:
    """Files with the nodes of those that may hold a call finding."""
    return with_nodes(files, needed=may_call(F.col("code"), F.col("language")))


def call_findings(code: Column, language: Column, nodes: Column) -> Column:
    return _with_rules(_call_places(code, language, nodes))


def add_findings(parsed: DataFrame) -> DataFrame:
    """Add ``findings``: line findings in rule order, then call findings in walk order."""
    code, language = F.col("code"), F.col("language")
    places = F.concat(_line_places(code, language), _call_places(code, language, F.col("nodes")))
    return parsed.withColumn("findings", _with_rules(places))


def _rows(found: DataFrame) -> DataFrame:
    rows = N.unnest(found, ["file_id", "path"], "findings", "finding_order")
    return rows.withColumn("file_path", F.coalesce("path", F.lit("unknown"))).drop("path")


def findings_table(files: DataFrame) -> DataFrame:
    """Every finding of every file; ``finding_order`` is the order within the file."""
    return _rows(add_findings(with_call_nodes(files)))


def line_findings_table(files: DataFrame) -> DataFrame:
    """Line findings only: no parse, stays in the JVM."""
    return _rows(files.withColumn("findings", line_findings(F.col("code"), F.col("language"))))


def call_findings_table(files: DataFrame) -> DataFrame:
    """Call findings; files that cannot hold any are not parsed."""
    files = files.where(may_call(F.col("code"), F.col("language")))
    found = call_findings(F.col("code"), F.col("language"), F.col("nodes"))
    return _rows(with_nodes(files).withColumn("findings", found))


def custom_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Line scan with the caller's own regex rules (``rule_id``, ``pattern``, ``language``)."""
    numbered = files.select("file_id", "language", F.posexplode(X.lines(F.col("code"))).alias("i", "text"))
    hits = []
    for rule in rules:
        pattern = java_pattern(rule["pattern"])
        applies = F.col("text").rlike(pattern)
        if rule.get("language", "all") != "all":
            applies = applies & (F.lower("language") == rule["language"].lower())
        hits.append(
            F.when(
                applies,
                F.struct(
                    F.lit(rule["rule_id"]).alias("rule_id"),
                    (F.regexp_instr("text", F.lit(pattern)) - 1).alias("column"),
                ),
            )
        )
    matched = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return numbered.select(
        "file_id",
        (F.col("i") + 1).alias("line_number"),
        X.strip(F.col("text")).alias("code_snippet"),
        F.inline(matched),
    )


def risk_score(findings: Column) -> Column:
    def points(f: Column) -> Column:
        value = F.lit(0.0)
        for severity, worth in POINTS.items():
            value = F.when(f["severity"] == severity, worth).otherwise(value)
        return value

    return F.least(
        F.aggregate(findings, F.lit(0.0), lambda total, f: total + points(f)), F.lit(SCORE_CAP)
    )


def risk_level(score: Column) -> Column:
    level = F.when(score > 0, "LOW").otherwise("SECURE")
    for name, lowest in reversed(LEVELS):
        level = F.when(score >= lowest, name).otherwise(level)
    return level


def add_summary(found: DataFrame) -> DataFrame:
    """Counts by severity, score and level of each file's findings."""

    def of(severity: str) -> Column:
        return N.count_if(F.col("findings"), lambda f: f["severity"] == severity)

    counts = {f"{severity.lower()}_severity": of(severity) for severity in POINTS}
    return (
        found.withColumns({"total_findings": F.size("findings"), **counts})
        .withColumn("risk_score", risk_score(F.col("findings")))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )


SUMMARY_COLUMNS = [
    "total_findings",
    "high_severity",
    "medium_severity",
    "low_severity",
    "risk_score",
    "risk_level",
]


def security_summary(files: DataFrame) -> DataFrame:
    return add_summary(add_findings(with_call_nodes(files))).select("file_id", *SUMMARY_COLUMNS)


def json_reports(files: DataFrame) -> DataFrame:
    """One JSON document per file: summary and findings in order."""
    fields = [
        "rule_id", "rule_name", "severity", "cwe_id", "file_path", "line_number", "column",
        "code_snippet", "description", "remediation",
    ]
    path = F.coalesce("path", F.lit("unknown"))
    listed = F.transform(
        "findings",
        lambda f: F.struct(*[path.alias(n) if n == "file_path" else f[n].alias(n) for n in fields]),
    )
    return add_summary(add_findings(with_call_nodes(files))).select(
        "file_id",
        F.to_json(
            F.struct(F.struct(*SUMMARY_COLUMNS).alias("summary"), listed.alias("findings"))
        ).alias("report"),
    )
