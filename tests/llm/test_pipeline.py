"""The pipeline's stages, held against brute force and the operators' own results."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from lintlake.llm import op8_mixing, op9_quadratic
from tests.llm.test_dedup import brute_components, brute_print
from tests.llm.test_mix_and_shard import brute_targets

SF = "/root/testdata/sf0.001"


def test_entry_lists_the_pipeline():
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in op9_quadratic.score(whole, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    first = steps["quality classifier"]
    assert {r.doc_id for r in first} == good
    last = {}
    for r in first:
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    second = steps["exact dedup"]
    assert sorted(r.doc_id for r in second) == sorted(last.values())
    prints = [(r.doc_id, brute_print(r.text)) for r in second]
    names = brute_components(prints)
    third = steps["SimHash near-dedup"]
    assert sorted(r.doc_id for r in third) == sorted({names[f] for _, f in prints})
    sizes, largest = Counter(), Counter()
    for r in third:
        sizes[r.source] += len(r.text.split())
        largest[r.source] = max(largest[r.source], len(r.text.split()))
    fourth = steps["mixing sources"]
    got = Counter()
    for r in fourth:
        got[r.source] += len(r.text.split())
    aims = brute_targets(sizes)
    assert all(abs(got[s] - aims[s]) <= largest[s] / 2 + 1 for s in aims)
    assert max(Counter(r.doc_id for r in fourth).values()) <= 2 and {tuple(r) for r in fourth} <= {tuple(r) for r in third}
    pieces = defaultdict(int)
    for r in steps["packing"]:
        pieces[r.doc_id] += r.length
        tokens = r.doc_tokens
        assert tokens > 0
    assert set(pieces) == {r.doc_id for r in fourth}
    assert op8_mixing.mix(whole, carry=False).count() == whole.count()


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("rows", [[], [(1, None)], "odd"])
def test_odd_and_empty_tables(spark, make_docs, tmp_path, rows):
    """Every stage on its predecessor's output, with nulls, repeated rows and clashing columns."""
    from tests.llm.conftest import ODD

    folder = str(tmp_path)
    prose = [(100 + i, f"the {i} of a plain and quiet day went by as the people of town {i % 7} had said it would " * 6, f"s{i % 3}") for i in range(40)]
    rows = [*ODD, *prose] if rows == "odd" else rows
    docs = make_docs(rows)
    marks = [(i, int(i % 4 > 0), 0) for i, *_ in prose] if len(rows) > 1 else []
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert docs.count() <= (2 if name.startswith("mixing") else 1) * before
    kept = docs.collect()
    assert all((r.text or "").split() for r in kept)
    pieces = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept}
    assert len(kept) > 0 or len(rows) < 2
