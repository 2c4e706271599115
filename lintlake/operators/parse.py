"""Parse stage: source text -> array of syntax nodes, the only Python stage of the analysis.

The helper only lists nodes with their position, attributes and running counters. Every metric,
estimate, finding and feature is computed from the array by Spark.
"""

from __future__ import annotations

import ast
import gc
import re
import sys
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lintlake.schemas import NODE, PARSED

# The helper travels inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Languages, and the language of a file extension.
LANGUAGES = ("python", "c", "java", "javascript")
EXTENSIONS = {
    ".py": "python",
    ".pyw": "python",
    ".c": "c",
    ".h": "c",
    ".java": "java",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
}

# The patterns that find structure in brace languages.
FUNCTION_PATTERN = {
    "c": (
        r"^\s*(?:(?:static|inline|extern|unsigned|signed|const|volatile)\s+)*"
        r"(?:void|int|float|double|char|long|short|bool|size_t|\w+\s*\*?)\s+"
        r"(\w+)\s*\([^)]*\)\s*\{"
    ),
    "java": (
        r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*"
        r"(?:void|int|float|double|char|long|short|boolean|byte|String|\w+(?:<[^>]+>)?)\s+"
        r"(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:\s*,\s*\w+)*)?\s*\{"
    ),
    "javascript": (
        r"(?:^\s*(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*\{"
        r"|^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)\s*)"
    ),
}
LOOP_PATTERN = r"\b(for|while|do)\s*[\(\{]"
CONDITION_PATTERN = r"\b(if|else\s+if|else|switch)\b"
VARIABLE_PATTERN = {
    "c": r"^\s*(?:int|float|double|char|long|short|unsigned|signed|bool|size_t|void\s*\*)\s+(\w+)\s*[;=]",
    "java": r"^\s*(?:int|float|double|char|long|short|byte|boolean|String|\w+(?:<[^>]+>)?)\s+(\w+)\s*[;=]",
    "javascript": r"^\s*(?:const|let|var)\s+(\w+)\s*[;=]",
}

FUNCTION_NODES = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOP_NODES = (ast.For, ast.While)
NEST_NODES = (ast.If, ast.For, ast.While, ast.With, ast.Try)
# Kinds some operator reads; a full walk lists every kind.
READ_NODES = (
    *FUNCTION_NODES,
    ast.ClassDef,
    *NEST_NODES,
    ast.ExceptHandler,
    ast.Assert,
    ast.BoolOp,
    ast.comprehension,
    ast.Assign,
    ast.AnnAssign,
    ast.AugAssign,
    ast.Call,
    ast.Break,
    ast.Return,
)

FUNCTION_TYPES, LOOP_TYPES = frozenset(FUNCTION_NODES), frozenset(LOOP_NODES)
NEST_TYPES, READ_TYPES = frozenset(NEST_NODES), frozenset(READ_NODES)
# What a lean walk never has to enter: leaves, and fields that hold no expression or statement.
LEAF_TYPES = frozenset(
    {ast.Name, ast.Constant, ast.Pass, ast.Continue, ast.Import, ast.ImportFrom, ast.Global}
    | {ast.Nonlocal, type(None), str}
)
PLAIN_FIELDS = frozenset(
    "ctx op ops id attr arg name names level module kind conversion is_async simple type_comment "
    "rest kwd_attrs tag type_ignores".split()
)
NODE_TYPES = [
    kind
    for kind in vars(ast).values()
    if isinstance(kind, type)
    and issubclass(kind, ast.AST)
    # Old names of Constant are left out.
    and (kind is ast.Constant or not issubclass(kind, ast.Constant))
]
# Fields a lean walk and a full one look into, last first, and types that are no node to a full one.
NODE_FIELDS = {
    kind: ()
    if kind in LEAF_TYPES or kind is ast.MatchSingleton
    else tuple(f for f in reversed(kind._fields) if f not in PLAIN_FIELDS)
    for kind in NODE_TYPES
}
ALL_FIELDS = {kind: tuple(reversed(kind._fields)) for kind in NODE_TYPES}
PLAIN_TYPES = frozenset({type(None), str, bytes, bool, int, float, complex, type(...)})
PLACED_TYPES = frozenset(kind for kind in NODE_TYPES if "end_lineno" in kind._attributes)
# Points of a node that are marked on the walk's stack.
END, BODY, ORELSE = -1, -2, -3

FIELDS = NODE.fieldNames()
# Positions of the fields in a row.
PRE, LAST, PARENT, DEPTH, KIND, NAME, ATTR, BASE, OP, NUM, COUNT, NAMES = range(12)
DIRECT, TEXT, SCOPE, LINE, END_LINE, COL, NEST, LOOP_PATH = range(12, 20)
BODY_FIRST, BODY_LAST, BODY_LOOPS, N_FNS = range(20, 24)
BLANK = [None] * len(FIELDS)
# Text handled before the rows collected so far are packed into Arrow memory.
CHUNK_CHARS = 1 << 20


def _new_row(rows: list[list], kind: str, depth: int, parent: int | None) -> list:
    row = BLANK.copy()
    row[PRE] = row[LAST] = len(rows)
    row[KIND] = kind
    row[DEPTH] = depth
    row[PARENT] = parent
    rows.append(row)
    return row


def _bound_names(target: ast.AST) -> Iterator[str]:
    if isinstance(target, ast.Name):
        yield target.id
    elif isinstance(target, (ast.Tuple, ast.List)):
        for part in target.elts:
            yield from _bound_names(part)
    elif isinstance(target, ast.Starred):
        yield from _bound_names(target.value)


def _number(value: ast.AST) -> float | None:
    constant = getattr(value, "value", None) if isinstance(value, ast.Constant) else None
    if not isinstance(constant, (int, float, complex)):
        return None
    try:
        return float(constant.real) if not constant.imag else None
    except OverflowError:
        return None


def _decorator(node: ast.AST) -> str | None:
    target = node.func if isinstance(node, ast.Call) else node
    if isinstance(target, ast.Name):
        return target.id
    return ast.dump(target) if isinstance(node, (ast.Attribute, ast.Call)) else None


def _function(node, row: list, branches: dict) -> None:
    a = node.args
    row[NAME] = node.name
    row[COUNT] = (
        len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
    )
    row[NAMES] = [d for d in map(_decorator, node.decorator_list) if d is not None]
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant):
        if isinstance(first.value.value, str):
            row[TEXT] = first.value.value


def _call(node, row: list, branches: dict) -> None:
    func = node.func
    if isinstance(func, ast.Name):
        row[NAME] = func.id
    elif isinstance(func, ast.Attribute):
        row[ATTR] = func.attr
        if isinstance(func.value, ast.Name):
            row[BASE] = func.value.id


def _assign(node, row: list, branches: dict) -> None:
    row[NAMES] = [n for t in node.targets for n in _bound_names(t)]
    row[DIRECT] = [t.id for t in node.targets if isinstance(t, ast.Name)]
    if isinstance(node.value, ast.BinOp):
        row[OP] = type(node.value.op).__name__
        row[NUM] = _number(node.value.right)


def _augmented(node, row: list, branches: dict) -> None:
    row[OP] = type(node.op).__name__
    row[NUM] = _number(node.value)


def _annotated(node, row: list, branches: dict) -> None:
    if isinstance(node.target, ast.Name):
        row[NAMES] = [node.target.id]
        if isinstance(node.annotation, ast.Name):
            row[TEXT] = node.annotation.id
        elif isinstance(node.annotation, ast.Constant):
            row[TEXT] = str(node.annotation.value)


def _condition(node, row: list, branches: dict) -> None:
    if id(node) not in branches:
        # The whole elif chain is numbered from its head, once.
        chain = [node]
        while len(chain[-1].orelse) == 1 and isinstance(chain[-1].orelse[0], ast.If):
            chain.append(chain[-1].orelse[0])
        tail = 2 if chain[-1].orelse else 1
        for back, link in enumerate(reversed(chain)):
            branches[id(link)] = tail + back
    row[COUNT] = branches[id(node)]
    test = node.test
    row[OP] = type(test.op if isinstance(test, ast.UnaryOp) else test).__name__


def _choice(node, row: list, branches: dict) -> None:
    row[COUNT] = len(node.values) - 1


def _filters(node, row: list, branches: dict) -> None:
    row[COUNT] = len(node.ifs)


def _class(node, row: list, branches: dict) -> None:
    row[NAME] = node.name


def _loop(node, row: list, branches: dict) -> None:
    row[NAME] = node.target.id if isinstance(node.target, ast.Name) else ""


# How the attributes of a Python node are filled in, by its type.
DESCRIBE = {
    ast.FunctionDef: _function,
    ast.AsyncFunctionDef: _function,
    ast.ClassDef: _class,
    ast.For: _loop,
    ast.If: _condition,
    ast.Call: _call,
    ast.Assign: _assign,
    ast.AugAssign: _augmented,
    ast.AnnAssign: _annotated,
    ast.BoolOp: _choice,
    ast.comprehension: _filters,
}


def python_nodes(code: str, full: bool) -> list[list]:
    """Rows of a Python file. The walk keeps its own stack, so deep trees do not recurse."""
    rows: list[list] = []
    branches: dict[int, int] = {}
    loops_seen = fns_seen = 0
    fields_of, skipped = (ALL_FIELDS, PLAIN_TYPES) if full else (NODE_FIELDS, LEAF_TYPES)
    # (position, scope, loop path, nesting) of the listed nodes around the current one
    around: list[tuple] = [(None, None, (), 0)]
    # A row on the stack marks a point of a listed node: start or end of its body, or its end.
    todo: list = [(ast.parse(code), 0)]
    push = todo.append
    while todo:
        item, depth = todo.pop()
        kind = type(item)
        if kind is list:
            if depth == END:
                item[LAST] = len(rows) - 1
                around.pop()
                if item[N_FNS] is not None:
                    item[N_FNS] += fns_seen
            elif depth == BODY:
                item[BODY_FIRST] = len(rows)
                item[BODY_LOOPS] = -loops_seen
            else:
                item[BODY_LAST] = len(rows) - 1
                item[BODY_LOOPS] += loops_seen
            continue
        below = depth + 1
        sliced = kind is ast.Subscript and type(item.slice) is ast.Slice
        if full or kind in READ_TYPES or sliced:
            parent, scope, path, nest = around[-1]
            row = _new_row(rows, kind.__name__, depth, parent)
            row[SCOPE] = scope
            if kind in PLACED_TYPES:
                row[LINE], row[END_LINE], row[COL] = item.lineno, item.end_lineno, item.col_offset
            if sliced:
                row[OP] = "Slice"
            elif kind in DESCRIBE:
                DESCRIBE[kind](item, row, branches)
            if kind in NEST_TYPES:
                nest += 1
            row[NEST] = nest
            if kind in LOOP_TYPES:
                loops_seen += 1
                path = (*path, row[PRE])
                row[LOOP_PATH] = list(path)
                around.append((row[PRE], scope, path, nest))
                push((row, END))
                head = [item.target, item.iter] if kind is ast.For else [item.test]
                todo += [(child, below) for child in reversed(item.orelse)]
                push((row, ORELSE))
                todo += [(child, below) for child in reversed(item.body)]
                push((row, BODY))
                todo += [(child, below) for child in reversed(head)]
                continue
            if kind in FUNCTION_TYPES:
                scope = item.name
                row[N_FNS] = -fns_seen
                fns_seen += 1
            if not fields_of[kind]:
                # Nothing below it: it ends where it starts.
                continue
            around.append((row[PRE], scope, path, nest))
            push((row, END))
        # Children in reverse, so that the first is taken next.
        for field in fields_of[kind]:
            value = getattr(item, field, None)
            if type(value) is list:
                for child in reversed(value):
                    if type(child) not in skipped:
                        push((child, below))
            elif type(value) not in skipped:
                push((value, below))
    return rows


_BRACES = re.compile(r"[\"'`{}]")


def _closing_brace(code: str, start: int) -> int:
    """Position of the brace closing the one at ``start``; quoted text is skipped."""
    quote, depth = "", 0
    for mark in _BRACES.finditer(code, start):
        char = mark.group()
        if quote:
            if char == quote and code[mark.start() - 1] != "\\":
                quote = ""
        elif char == "{":
            depth += 1
        elif char == "}":
            depth -= 1
            if not depth:
                return mark.start()
        else:
            quote = char
    return -1


_COMPILED = {
    language: (
        re.compile(FUNCTION_PATTERN[language], re.MULTILINE),
        (
            ("loop", re.compile(LOOP_PATTERN)),
            ("condition", re.compile(CONDITION_PATTERN)),
            ("variable", re.compile(VARIABLE_PATTERN[language], re.MULTILINE)),
        ),
    )
    for language in VARIABLE_PATTERN
}


def brace_nodes(code: str, language: str, full: bool) -> list[list]:
    """Rows of a C, Java or JavaScript file: each function with its contents, then the whole
    text again as top-level contents."""
    function, parts = _COMPILED[language]
    rows: list[list] = []
    owner: dict[tuple, str] = {}
    if full:
        root = _new_row(rows, "module", 0, None)
        root[LINE], root[END_LINE] = 1, code.count("\n") + 1
        root[NEST] = 0
    top = 0 if full else None

    def contents(text: str, first_line: int, depth: int, parent: int | None, scope: str | None):
        for kind, pattern in parts:
            line, seen = first_line, 0
            for match in pattern.finditer(text):
                line += text.count("\n", seen, match.start())
                seen = match.start()
                row = _new_row(rows, kind, depth, parent)
                word = match.group(1).strip()
                row[NAME if kind == "variable" else ATTR] = word
                row[LINE] = row[END_LINE] = line
                row[NEST] = int(kind != "variable")
                row[SCOPE] = scope
                if kind == "loop":
                    row[LOOP_PATH] = [row[PRE]]
                elif scope is not None:
                    owner.setdefault((kind, word, line), scope)

    line = 1
    seen = 0
    for match in function.finditer(code):
        line += code.count("\n", seen, match.start())
        seen = match.start()
        name = next(filter(None, match.groups()), "anonymous")
        opening = code.find("{", match.end() - 1)
        if opening < 0:
            opening = code.find("{", match.start())
        closing = _closing_brace(code, opening) if opening >= 0 else -1
        row = _new_row(rows, "function_def", 1, top)
        row[NAME] = name
        row[LINE] = line
        row[END_LINE] = line
        row[TEXT] = ""
        row[NEST] = 0
        row[COUNT] = 0
        row[NAMES] = []
        row[N_FNS] = 1
        if closing >= 0:
            row[END_LINE] = code.count("\n", 0, closing) + 1
            row[TEXT] = code[opening : closing + 1]
            contents(row[TEXT], line, 2, row[PRE], name)
        row[LAST] = len(rows) - 1
    contents(code, 1, 1, top, None)
    for row in rows:
        # Equal conditions and variables belong to the first function that has one.
        if row[KIND] in ("condition", "variable"):
            word = row[ATTR] or row[NAME]
            row[SCOPE] = owner.get((row[KIND], word, row[LINE]))
    if full:
        rows[0][LAST] = len(rows) - 1
    return rows


def parse_text(code: str | None, language: str | None, full: bool = False):
    """(error, rows) of one file; never raises."""
    language = (language or "").lower().strip()
    if language not in LANGUAGES:
        return f"unsupported language: {language}", None
    try:
        if language == "python":
            return None, python_nodes(code or "", full)
        return None, brace_nodes(code or "", language, full)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return f"{type(problem).__name__}: {problem}", None


_NODE_TYPE = to_arrow_type(NODE)
_KINDS = [_NODE_TYPE.field(i).type for i in range(len(FIELDS))]


def _pack(errors: list, parsed: list, wanted: frozenset) -> pa.StructArray:
    offsets, flat = [0], []
    for rows in parsed:
        flat.extend(rows or ())
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(FIELDS)
    nodes = pa.StructArray.from_arrays(
        [
            pa.array(c, kind) if name in wanted else pa.nulls(len(c), kind)
            for name, kind, c in zip(FIELDS, _KINDS, columns)
        ],
        fields=[_NODE_TYPE.field(i) for i in range(len(FIELDS))],
    )
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()),
        nodes,
        mask=pa.array([rows is None for rows in parsed], pa.bool_()),
    )
    return pa.StructArray.from_arrays([pa.array(errors, pa.string()), lists], names=["error", "nodes"])


def _parser(full: bool, fields: Iterable[str]):
    wanted = frozenset(fields)

    def parse(code: pa.Array, language: pa.Array) -> pa.Array:
        chunks, errors, parsed, size = [], [], [], 0
        warnings.simplefilter("ignore", SyntaxWarning)
        # Trees and rows hold no cycles: looking for some among them is a fifth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for text, name in zip(code.to_pylist(), language.to_pylist()):
                error, rows = parse_text(text, name, full)
                errors.append(error)
                parsed.append(rows)
                size += len(text or "")
                if size > CHUNK_CHARS:
                    chunks.append(_pack(errors, parsed, wanted))
                    errors, parsed, size = [], [], 0
            chunks.append(_pack(errors, parsed, wanted))
            return pa.concat_arrays(chunks)
        finally:
            if collecting:
                gc.enable()

    # Declared non-deterministic so that the optimizer never evaluates the parse twice.
    return F.arrow_udf(parse, PARSED).asNondeterministic()


def parsed_column(code: Column, language: Column, full: bool = False, fields: Iterable[str] = FIELDS) -> Column:
    return _parser(full, fields)(code, language)


def with_nodes(
    files: DataFrame, full: bool = False, needed: Column | None = None, fields: Iterable[str] = FIELDS
) -> DataFrame:
    """Add ``parse_error`` and ``nodes`` to a table with ``code`` and ``language``.

    Narrow: only the two text columns go through Python, the others stay in the JVM. Files that are
    not ``needed`` are kept without being parsed: both columns are null. Fields of nodes other than
    ``fields`` are left null.
    """
    text = [F.col(c) if needed is None else F.when(needed, F.col(c)) for c in ("code", "language")]
    parsed = files.withColumn("parsed", parsed_column(*text, full, fields))
    error = F.col("parsed.error") if needed is None else F.when(needed, F.col("parsed.error"))
    return parsed.withColumns({"parse_error": error, "nodes": F.col("parsed.nodes")}).drop("parsed")


def parse_errors(files: DataFrame) -> DataFrame:
    return with_nodes(files).filter("parse_error IS NOT NULL").drop("nodes", "code")


def language_of_path(path: Column) -> Column:
    """Language by extension, null when the extension is unknown.

    Leading dots of the base name do not start an extension.
    """
    extension = F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, extension)
