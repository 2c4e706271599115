"""Only files that may hold a call finding are parsed for findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import security
from lintlake.operators.parse import with_nodes


def test_files_without_calls_are_not_parsed(spark):
    texts = [
        ("named", "eval(x)\n"),
        ("system", "import os\nos.system(x)\n"),
        # Python reads these letters as e, v, a and l.
        ("wide", "ｅｖａｌ(x)\n"),
        ("broken", "eval(\n"),
        ("other", "print(x)\n"),
        ("none", None),
    ]
    files = spark.createDataFrame([(i, t, "python", i) for i, t in texts], "file_id string, code string, language string, path string")
    files = files.unionByName(files.withColumns({"file_id": F.concat("file_id", F.lit("-c")), "language": F.lit("c")}))
    kept = security.with_call_nodes(files).select("file_id", F.col("nodes").isNotNull().alias("parsed")).collect()
    assert {r.file_id for r in kept if r.parsed} == {"named", "system", "wide"}
    assert len(kept) == 12
    every = security._rows(security.add_findings(with_nodes(files)))
    assert sorted(every.collect(), key=str) == sorted(security.findings_table(files).collect(), key=str)
    assert {r.file_id for r in security.call_findings_table(files).collect()} == {"named", "system", "wide"}
