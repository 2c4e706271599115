"""Big-O estimates of Python functions from their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import nodes as N
from lintlake.functions import text as X
from lintlake.operators import catalog
from lintlake.operators.parse import with_nodes

# Variable names that mark a midpoint, a search bound or a split.
MIDPOINTS = ("mid", "middle", "m")
BOUNDS = ("lo", "low", "left", "l", "start", "hi", "high", "right", "r", "end")
SPLITS = ("mid", "middle", "half", "pivot")
HALVING_IN_PLACE = ("Mult", "FloorDiv", "Div", "RShift")
HALVING = ("Mult", "FloorDiv", "Div")
BREAK_FACTOR = 0.7

NESTS = (
    "array<struct<depth:int,loop_types:array<string>,start_line:int,end_line:int,"
    "has_break:boolean,has_early_return:boolean>>"
)


def _assigns_to(n: Column, names: tuple[str, ...]) -> Column:
    targets = F.array(*[F.lit(name) for name in names])
    return (n["kind"] == "Assign") & F.arrays_overlap(n["direct"], targets)


def loop_nests(nodes: Column, f: Column, inside: Column) -> Column:
    """Chains of nested loops in a function, one per loop without a loop in its body.

    What hangs on the ``else`` of such a loop is not looked at, so a chain may not pass
    through another loop with a loop-free body.
    """

    def chain(loop: Column) -> Column:
        return F.filter(loop["loop_path"], lambda p: p > f["pre"])

    def counted(n: Column) -> Column:
        outer = F.filter(chain(n), lambda p: p < n["pre"])
        return (
            n["kind"].isin(*N.LOOP_KINDS)
            & (n["body_loops"] == 0)
            & F.forall(outer, lambda p: N.node(nodes, p)["body_loops"] > 0)
        )

    def describe(leaf: Column) -> Column:
        inner = N.body(nodes, leaf)
        return F.struct(
            F.size(chain(leaf)).alias("depth"),
            F.transform(chain(leaf), lambda p: F.lower(N.node(nodes, p)["kind"])).alias("loop_types"),
            N.node(nodes, F.element_at(chain(leaf), 1))["lineno"].alias("start_line"),
            leaf["end_lineno"].alias("end_line"),
            F.exists(inner, lambda n: n["kind"] == "Break").alias("has_break"),
            F.exists(inner, lambda n: n["kind"] == "Return").alias("has_early_return"),
        )

    return F.transform(F.filter(inside, counted), describe)


def _halves(n: Column) -> Column:
    in_place = (
        (n["kind"] == "AugAssign") & n["op"].isin(*HALVING_IN_PLACE) & n["num"].isin(1.0, 2.0)
    )
    assigned = (n["kind"] == "Assign") & n["op"].isin(*HALVING) & (n["num"] == 2.0)
    return F.coalesce(in_place | assigned, F.lit(False))


def _searches(nodes: Column, loop: Column) -> Column:
    """A while body that computes a midpoint and moves a bound."""
    return X.let(
        N.body(nodes, loop),
        lambda inner: F.exists(inner, lambda n: _assigns_to(n, MIDPOINTS))
        & F.exists(inner, lambda n: _assigns_to(n, BOUNDS) & n["op"].isin("Add", "Sub")),
    )


def function_facts(nodes: Column) -> Column:
    """What the rules ask about each function, in pre-order."""

    def facts(f: Column) -> Column:
        def over(inside: Column) -> Column:
            calls = N.of_kind(inside, "Call")
            by_name = N.count_if(calls, lambda c: c["name"] == f["name"])
            called = (by_name > 0) | F.exists(calls, lambda c: c["attr"] == f["name"])
            mid = F.exists(inside, lambda n: _assigns_to(n, MIDPOINTS))
            split = F.exists(
                inside,
                lambda n: ((n["kind"] == "Subscript") & (n["op"] == "Slice")) | _assigns_to(n, SPLITS),
            )
            base = F.exists(inside, lambda n: (n["kind"] == "If") & n["op"].isin("Compare", "Not"))
            whiles = N.of_kind(inside, "While")
            return F.struct(
                f["depth"].alias("depth"),
                f["pre"].alias("pre"),
                f["name"].alias("name"),
                f["lineno"].alias("start_line"),
                f["end_lineno"].alias("end_line"),
                f["n_fns"].alias("n_fns"),
                F.coalesce(called, F.lit(False)).alias("recursive"),
                by_name.alias("branches"),
                F.coalesce((by_name >= 2) & split & base, F.lit(False)).alias("divides"),
                F.coalesce(mid & called, F.lit(False)).alias("halves_by_call"),
                F.coalesce(F.exists(whiles, lambda w: _searches(nodes, w)), F.lit(False)).alias(
                    "searches"
                ),
                F.exists(whiles, lambda w: F.exists(N.body(nodes, w), _halves)).alias("halves"),
                F.coalesce(
                    F.exists(calls, lambda c: (c["name"] == "sorted") | (c["attr"] == "sort")),
                    F.lit(False),
                ).alias("sorts"),
                loop_nests(nodes, f, inside).alias("loop_nests"),
            )

        return X.let(N.subtree(nodes, f), over)

    return F.transform(N.of_kind(nodes, "FunctionDef", "AsyncFunctionDef"), facts)


def _decide(f: Column, around: Column) -> Column:
    """First rule that fits; ``around`` holds the function and those nested in it."""
    depth = F.coalesce(F.array_max(f["loop_nests"]["depth"]), F.lit(0))
    searches = f["searches"] | F.exists(around, lambda g: g["halves_by_call"])
    return (
        F.when(f["recursive"] & F.exists(around, lambda g: g["divides"]), "divide_and_conquer")
        .when(f["recursive"] & (f["branches"] >= 2), "exponential_recursion")
        .when(searches, "binary_search")
        .when(f["recursive"] & (f["branches"] == 1), "linear_recursion")
        .when(f["halves"], "logarithmic_loop")
        .when(depth >= 3, "nested_loop_3")
        .when(depth == 2, "nested_loop_2")
        .when(f["sorts"], "efficient_sort")
        .when(depth == 1, "single_loop")
        .otherwise("constant_operation")
    )


def _explain(pattern: Column, f: Column, depth: Column) -> Column:
    # The wording of each rule.
    wording = {
        "divide_and_conquer": (
            " uses a divide-and-conquer pattern: it splits the input and makes ",
            f["branches"],
            " recursive calls.",
        ),
        "exponential_recursion": (
            " makes ",
            f["branches"],
            " recursive calls without clear input splitting — likely exponential.",
        ),
        "binary_search": (
            " contains a binary search pattern (midpoint calculation with bound adjustments).",
        ),
        "linear_recursion": (" makes a single recursive call — likely linear recursion.",),
        "logarithmic_loop": (" contains a loop whose counter doubles or halves each iteration.",),
        "nested_loop_3": (" has ", depth, "-deep nested loops."),
        "nested_loop_2": (" has doubly-nested loops.",),
        "efficient_sort": (" calls a built-in sort function.",),
        "single_loop": (" contains a single (non-nested) loop.",),
        "constant_operation": (" has no loops or recursion — constant time.",),
    }
    text = F.lit(None).cast("string")
    for name, parts in wording.items():
        pieces = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
        sentence = F.concat(F.lit("Function '"), f["name"], F.lit("'"), *pieces)
        text = F.when(pattern == name, sentence).otherwise(text)
    return text


def estimate_structs(facts: Column) -> Column:
    """One estimate per function in breadth-first order."""
    classes = F.create_map(*[F.lit(x) for r in catalog.COMPLEXITY_RULES for x in (r[0], r[1])])
    sureness = F.create_map(*[F.lit(x) for r in catalog.COMPLEXITY_RULES for x in (r[0], r[2])])

    def estimate(f: Column, i: Column) -> Column:
        depth = F.coalesce(F.array_max(f["loop_nests"]["depth"]), F.lit(0))
        broken = F.exists(f["loop_nests"], lambda nest: nest["has_break"])

        def result(pattern: Column) -> Column:
            sure = F.element_at(sureness, pattern)
            nested = pattern.isin("nested_loop_2", "nested_loop_3")
            return F.struct(
                f["depth"],
                f["pre"],
                f["name"].alias("function_name"),
                F.element_at(classes, pattern).alias("complexity_class"),
                F.when(nested & broken, F.round(sure * BREAK_FACTOR, 2))
                .otherwise(sure)
                .alias("confidence"),
                pattern.alias("matched_pattern"),
                _explain(pattern, f, depth).alias("explanation"),
                F.when(pattern == "constant_operation", F.array().cast(NESTS))
                .otherwise(f["loop_nests"])
                .alias("loop_nests"),
                F.when(
                    pattern.isin("divide_and_conquer", "exponential_recursion", "linear_recursion"), True
                )
                .otherwise((pattern == "binary_search") & f["recursive"])
                .alias("is_recursive"),
                f["start_line"],
                f["end_line"],
            )

        return X.let(_decide(f, F.slice(facts, i + 1, f["n_fns"])), result)

    return N.breadth_first(F.transform(facts, estimate))


def add_estimates(parsed: DataFrame) -> DataFrame:
    """Add ``estimates``; empty for brace languages and files that do not parse."""
    nodes = F.col("nodes")
    facts = parsed.withColumn("function_facts", function_facts(nodes))
    return facts.withColumn("estimates", estimate_structs(F.col("function_facts"))).drop(
        "function_facts"
    )


def estimates_table(files: DataFrame) -> DataFrame:
    """One row per Python function; ``walk_order`` numbers the functions of a file. Files of other
    languages have none and are not parsed."""
    made = add_estimates(with_nodes(python_only(files)))
    return N.unnest(made, ["file_id"], "estimates", "walk_order").drop("depth", "pre")


def python_only(files: DataFrame) -> DataFrame:
    """Before the parse, because a filter is not moved below it."""
    return files.where(F.lower(X.strip(F.col("language"))) == "python")


def facts_table(files: DataFrame) -> DataFrame:
    """The rule inputs of every Python function; other languages are not parsed."""
    made = with_nodes(python_only(files)).select("file_id", function_facts(F.col("nodes")).alias("facts"))
    return N.unnest(made, ["file_id"], "facts", "position")


def loop_nests_table(files: DataFrame) -> DataFrame:
    """The loop chains of every Python function."""
    facts = facts_table(files).withColumnRenamed("name", "function_name")
    return N.unnest(facts.select("file_id", "function_name", "loop_nests"), ["file_id", "function_name"], "loop_nests", "chain")


def module_searches(files: DataFrame) -> DataFrame:
    """Detectors applied to whole files: search, division, halving loop, sort call."""
    nodes = F.col("nodes")
    whiles = N.of_kind(nodes, "While")
    calls = N.of_kind(nodes, "Call")
    facts = F.col("facts")
    no = F.lit(False)
    return (
        with_nodes(files)
        .where("nodes IS NOT NULL")
        .withColumn("facts", function_facts(nodes))
        .select(
            "file_id",
            (
                F.coalesce(F.exists(whiles, lambda w: _searches(nodes, w)), no)
                | F.exists(facts, lambda f: f["halves_by_call"])
            ).alias("binary_search"),
            F.exists(facts, lambda f: f["divides"]).alias("divide_and_conquer"),
            F.exists(whiles, lambda w: F.exists(N.body(nodes, w), _halves)).alias("logarithmic_loop"),
            F.coalesce(
                F.exists(calls, lambda c: (c["name"] == "sorted") | (c["attr"] == "sort")), no
            ).alias("sort_call"),
        )
    )


def file_summary(files: DataFrame) -> DataFrame:
    """Per parsed file: count, worst class and its first function, recursion, mean confidence.

    The distribution stays a map in the row. No shuffle: a file's estimates are in its row.
    """
    parsed = with_nodes(files).where("nodes IS NOT NULL")
    ranks = F.create_map(*[F.lit(x) for pair in zip(catalog.CLASSES, range(8)) for x in pair])
    estimates = F.col("estimates")

    def worst_first(e: Column, i: Column) -> Column:
        return F.struct(
            (-F.element_at(ranks, e["complexity_class"])).alias("rank"),
            i.alias("i"),
            e["complexity_class"].alias("complexity_class"),
            e["function_name"].alias("function_name"),
        )

    present = F.array_distinct(estimates["complexity_class"])
    distribution = F.map_from_arrays(
        present,
        F.transform(
            present, lambda c: N.count_if(estimates, lambda e: e["complexity_class"] == c)
        ),
    )
    total = F.aggregate(estimates["confidence"], F.lit(0.0), lambda t, x: t + x)
    some = F.size("estimates") > 0
    return (
        add_estimates(parsed)
        .withColumn("worst", F.array_min(F.transform(estimates, worst_first)))
        .select(
            "file_id",
            F.size("estimates").alias("function_count"),
            F.col("worst.complexity_class").alias("worst_case_complexity"),
            F.col("worst.function_name").alias("worst_case_function"),
            F.when(some, N.count_if(estimates, lambda e: e["is_recursive"])).alias(
                "recursive_functions"
            ),
            F.when(some, X.let(total / F.size("estimates"), X.round_half_even)).alias(
                "average_confidence"
            ),
            F.when(some, distribution).alias("complexity_distribution"),
        )
    )


def worst_first(files: DataFrame) -> DataFrame:
    """Estimates of each file from worst to best class, ties in walk order. They are sorted in the file's
    row, so nothing is shuffled; the rows of a file follow each other in ``place``."""
    rank = F.create_map(*[F.lit(x) for pair in zip(catalog.CLASSES, range(len(catalog.CLASSES))) for x in pair])

    def keyed(e: Column, i: Column) -> Column:
        return F.struct((-F.coalesce(F.element_at(rank, e["complexity_class"]), F.lit(catalog.UNKNOWN_RANK))).alias("_rank"), i.alias("walk_order"), e.alias("_e"))

    made = add_estimates(with_nodes(python_only(files)))
    made = made.select("file_id", F.array_sort(F.transform("estimates", keyed)).alias("sorted"))
    rows = N.unnest(made, ["file_id"], "sorted", "place").select("file_id", "place", "walk_order", "_e.*").drop("depth", "pre")
    return catalog.with_severity(rows)


def csv_rows(estimates: DataFrame) -> DataFrame:
    return estimates.select(
        "file_id",
        "function_name",
        "complexity_class",
        F.format_string("%.2f", "confidence").alias("confidence"),
        "matched_pattern",
        "is_recursive",
        "start_line",
        "end_line",
        F.coalesce(F.array_max("loop_nests.depth"), F.lit(0)).alias("max_loop_depth"),
        "explanation",
    )
