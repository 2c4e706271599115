"""Trims and splits without patterns give what Python gives, for every character."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators.parse import with_nodes


def test_strip_of_every_character(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["\ufeff", "\U0001f600"]
    rows = spark.createDataFrame([(f"{c} {c}a{c}b \t{c}", ) for c in chars], "t string")
    made = rows.select("t", X.strip(F.col("t")).alias("s"))
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in made.collect() if r.s != r.t.strip()] == []


def test_lines_of_every_boundary(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\x1f", " ", "\t"]
    texts = ["", "a", *(f"a{e}b{f}" for e in ends for f in ends), *(f"{e}{e}a" for e in ends)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.boundary_lines(F.col("t")).alias("l"))
    assert [r.t for r in rows.collect() if r.l != r.t.splitlines()] == []


def test_only_wanted_fields_are_packed(spark, make_code):
    files = make_code(("python", "for x in y:\n    f(x)\n"))
    full = with_nodes(files, full=True).select(F.inline("nodes")).collect()
    some = with_nodes(files, full=True, fields=["depth"]).select(F.inline("nodes")).collect()
    assert [r.depth for r in full] == [r.depth for r in some] and len(some) > 5
    assert {v for r in some for k, v in r.asDict().items() if k != "depth"} == {None}
