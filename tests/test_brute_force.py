"""Jobs against direct answers: templates, edge cases, this repository and the standard library."""

import ast
import glob
import os

import pytest

from lintlake.operators import complexity, metrics, security, structure
from lintlake.operators.parse import with_nodes
from lintlake.sources.corpus import LANGUAGE_OF, TEMPLATES
from tests import brute

EDGES = [
    ("python", ""),
    ("python", "x = 1\r\ny = 2\r# c\n\x0c\nz = 3\u2028# d\n"),
    ("python", "def größe(α, *, β=1):\n    é = [α for ε in β if ε if α]\n    return größe(α)\n"),
    ("python", "if a:\n    x, (y, *z) = f()\nelif b:\n    x = x.y = 3\nelif c:\n    (q): int = 1\n    w: 'str' = 2\nelse:\n    pass\n"),
    ("python", "def f():\n    def g():\n        for i in a:\n            for j in b:\n                pass\n    while x:\n        def h():\n            break_ = 1\n            for k in c:\n                return k\n        break\n"),
    ("python", "for a in b:\n    if c:\n        break\nelse:\n    for d in e:\n        for f in g:\n            pass\n"),
    ("python", "def f(n):\n    for a in b:\n        for c in d:\n            pass\n        else:\n            while e:\n                n >>= True\n    else:\n        while n:\n            n = n / 2.0\n"),
    ("python", "class A:\n    if x:\n        def m(self): return self.m()\n    @property\n    def p(self): return sorted(self.x)\n    @a.b\n    @c(1)\n    async def q(self, a, /, *b, c, **d):\n        async with x: pass\n        async for y in z: pass\n"),
    ("python", "def f(a):\n    def inner(b):\n        half = b\n        if not b: return 0\n        return inner(b[1:]) + inner(b[:1])\n    return f(a)\n"),
    ("python", "def f(a):\n    self.f(a)\n    while a:\n        m = 1\n        hi = m - 1\n    try:\n        with a as b, c: pass\n    except* E:\n        assert a and b or c\n"),
    ("python", "def f(x):\n    match x:\n        case [1, *r] if r and x:\n            for i in r: pass\n        case {'a': None}: pass\n    return lambda y: [eval(z) for z in os.system(y) if z]\n"),
    ("python", "def f(): return 1\ndef f():\n    a = 1\n    b = 2\n    return a\nf(); eval('1'); import os; os.system('x')\n"),
    ("python", "def f(n):\n    i: int\n    i *= 2\n    while i:\n        i = 2 * i\n        i **= 2\n        i = i * 2 + 1\n"),
    ("python", "password = 'ſecret'; ſecret = 'a'\nTOKEN='x' # token = \"y\"\nprint ( Exception )\nselect a + b\nupdate x ++\n..\\a ../b\n"),
    ("c", "int main ( ) { /* { */ char *s = \"}\"; if (s) { free(s); p->x = 1; } }\n\n\nint other(int a) {\n  int a = 0;\n"),
    ("c", "// c\n/* a */ int x;\n/* b\n\n c */\nstatic int f(void) {\n  do { gets(x); } while (1);\n  else if (x) switch (y) {}\n}\nint f(void) {\n  int k;\n}\n p = NULL; *p\n"),
    ("java", "class A { public List<String> get(int a) throws E, F { for(;;) { return x; } }\n  int y = 1;\n String z;\n}\n"),
    ("javascript", "const f = async (a, b) => a + b;\nlet g = function() { if (a) { innerHTML = 'it\\'s'; } }\nasync function h() {\n  while (True) { console.error(err) }\n}\nvar q;\n"),
    ("javascript", "function a() { var s = `}`; for (;;) {} }\nfunction b() { var s = `}`; for (;;) {} }\nvar s;\n"),
]
STDLIB = [
    p for p in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))
    if os.path.basename(p)[0] in "abcdhijqrst"
][:60]


def plain_sum(values):
    """Left to right; newer Pythons compensate in sum()."""
    total = 0.0
    for value in values:
        total += value
    return total


def snippets():
    filled = [(LANGUAGE_OF[e], t.replace("{k}", "77").replace("{m}", "5")) for e, t in TEMPLATES]
    own = glob.glob(os.path.join(os.path.dirname(os.path.dirname(__file__)), "lintlake", "**", "*.py"), recursive=True)
    files = [("python", open(p, encoding="utf-8", errors="replace").read()) for p in [*own, *STDLIB]]
    return filled + EDGES + files


@pytest.fixture(scope="module")
def cases():
    return snippets()


@pytest.fixture(scope="module")
def code(make_code, cases):
    return make_code(*cases).repartition(8)


def parses(language, text):
    try:
        brute.structure(text, language)
        return True
    except SyntaxError:
        return False


def by_file(df):
    found = {}
    for row in df.collect():
        found.setdefault(int(row.file_id), []).append(row)
    return found


def test_structure(code, cases):
    parsed = with_nodes(code)
    functions = by_file(structure.functions_table(parsed))
    loops = by_file(structure.loops_table(parsed))
    conditions = by_file(structure.conditions_table(parsed))
    variables = by_file(structure.variables_table(parsed))
    nesting = by_file(structure.nesting_table(parsed))
    for i, (language, text) in enumerate(cases):
        if not parses(language, text):
            assert i not in nesting
            continue
        want = brute.structure(text, language)
        assert [
            (r.name, r.start_line, r.end_line, r.parameter_count, r.is_method, ",".join(r.decorators), r.docstring)
            for r in functions.get(i, [])
        ] == [(f["name"], f["start"], f["end"], f["params"], f["method"], f["decorators"], f["doc"]) for f in want["functions"]] or any(
            "Call" in f["decorators"] for f in want["functions"]
        ), i
        assert sorted(
            (r.keyword, r.start_line, r.end_line, r.nesting_depth, str(r.parent_function), r.iteration_target) for r in loops.get(i, [])
        ) == sorted((x["keyword"], x["start"], x["end"], x["depth"], str(x["fn"]), x["target"]) for x in want["loops"]), i
        assert sorted(
            (r.keyword, r.start_line, r.end_line, r.has_else, r.branch_count, str(r.parent_function)) for r in conditions.get(i, [])
        ) == sorted((x["keyword"], x["start"], x["end"], x["has_else"], x["branches"], str(x["fn"])) for x in want["conditions"]), i
        assert sorted(
            (r.name, r.line, str(r.type_annotation), str(r.parent_function), r.scope) for r in variables.get(i, [])
        ) == sorted(
            (x["name"], x["line"], str(x["annotation"]), str(x["fn"]), "local" if x["fn"] else "global") for x in want["variables"]
        ), i
        assert (nesting[i][0].max_nesting_depth, nesting[i][0].class_count) == (want["nesting"], want["classes"]), i


def test_full_walk(code, cases):
    every = by_file(structure.walk(with_nodes(code.where("language = 'python' AND length(code) < 20000"), full=True)))
    for i, rows in every.items():
        rows.sort(key=lambda r: r.pre)
        tree = ast.parse(cases[i][1])
        order = []

        def down(node):
            order.append(type(node).__name__)
            for child in ast.iter_child_nodes(node):
                down(child)

        down(tree)
        assert [r.kind for r in rows] == order
        # A loop's body and its else part must not disturb the order of the walk.
        breadth = [r.kind for r in sorted(rows, key=lambda r: (r.depth, r.pre))]
        assert breadth == [type(n).__name__ for n in ast.walk(tree)]
        for r in rows:
            assert r.pre <= r.last < len(rows) and (r.parent is None or rows[r.parent].pre < r.pre <= rows[r.parent].last)


def test_metrics(code, cases):
    rows = {i: r[0] for i, r in by_file(metrics.file_metrics(code)).items()}
    for i, (language, text) in enumerate(cases):
        if not parses(language, text):
            assert i not in rows
            continue
        want, row = brute.structure(text, language), rows[i]
        assert (row.total_lines, row.code_lines, row.blank_lines, row.comment_lines) == brute.line_counts(text, language), i
        lengths = {f["name"]: f["length"] for f in want["functions"]}
        assert row.per_function_length == lengths, i
        assert row.per_function_complexity == {f["name"]: f["cc"] for f in want["functions"]}, i
        assert row.max_function_length == max(lengths.values(), default=0), i
        mean = sum(f["length"] for f in want["functions"]) / len(want["functions"]) if want["functions"] else 0.0
        assert row.avg_function_length == round(mean, 2), i
        assert row.cyclomatic_complexity == want["cc"], i
        assert (row.loop_count, row.condition_count, row.variable_count) == (
            len(want["loops"]), len(want["conditions"]), len(want["variables"])), i
        assert abs(row.maintainability_index - brute.maintainability(text, language, want["cc"])) < 1e-9, i


def test_estimates(code, cases):
    rows = by_file(complexity.estimates_table(code))
    total = 0
    for i, (language, text) in enumerate(cases):
        if language != "python" or not parses(language, text):
            assert i not in rows
            continue
        got = sorted(rows.get(i, []), key=lambda r: r.walk_order)
        want = brute.estimates(text)
        total += len(want)
        assert [
            (r.function_name, r.complexity_class, r.confidence, r.matched_pattern, r.is_recursive, r.start_line, r.end_line)
            for r in got
        ] == [(e["name"], e["cls"], e["sure"], e["pattern"], e["recursive"], e["start"], e["end"]) for e in want], i
        assert [
            [(n.depth, ",".join(n.loop_types), n.start_line, n.end_line, n.has_break, n.has_early_return) for n in r.loop_nests]
            for r in got
        ] == [[tuple(c.values()) for c in e["nests"]] for e in want], i
    assert total > 1000


def test_findings(code, cases):
    rows = by_file(security.findings_table(code))
    for i, (language, text) in enumerate(cases):
        got = sorted(rows.get(i, []), key=lambda r: r.finding_order)
        assert [(r.rule_id, r.severity, r.line_number, r.column, r.code_snippet) for r in got] == brute.findings(text, language), i


def test_summary(code, cases):
    rows = {i: r[0] for i, r in by_file(complexity.file_summary(code)).items()}
    for i, (language, text) in enumerate(cases):
        if language != "python" or not parses(language, text):
            continue
        want = brute.estimates(text)
        worst = brute.worst(want)
        assert rows[i].function_count == len(want)
        if worst:
            assert (rows[i].worst_case_complexity, rows[i].worst_case_function) == (worst["cls"], worst["name"])
            assert rows[i].average_confidence == round(plain_sum([e["sure"] for e in want]) / len(want), 2)
            classes = [e["cls"] for e in want]
            assert rows[i].complexity_distribution == {c: classes.count(c) for c in classes}
