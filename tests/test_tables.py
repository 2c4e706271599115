"""Ranks, quantiles, labels, splits, cleaning and checks against direct answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.functions.ranks import exact_quantiles, running_totals, with_scan_index
from lintlake.operators import datasets, embeddings, features, labels, tokens


def test_round_half_even(spark):
    dice = random.Random(3)
    values = [k / 8 for k in range(-40, 80)] + [2.675, 2.665, 0.285, 1.005, 0.29, 99.995, 0.0, 1e-9]
    values += [dice.randint(0, 20000) / dice.randint(1, 400) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, r in df.select("v", X.round_half_even(F.col("v"))).collect():
        assert r == round(v, 2), v


def test_text_classes(spark):
    odd = "a b\x1cc 　²x ٣ 12 1２ ⑤​ é_1 \x85"
    df = spark.createDataFrame([(odd,), ("",), ("\n",), ("a\r\nb\n\n",), (" 1 22\t3a 4",)], "v string")
    rows = df.select(
        "v", F.size(X.boundary_lines(F.col("v"))), X.word_count(F.col("v")), X.digit_words(F.col("v")),
        X.strip(F.col("v")), X.tokens(F.col("v")), X.is_blank(F.col("v")),
    ).collect()
    import re

    for v, n, words, digits, stripped, found, blank in rows:
        assert n == len(v.splitlines())
        assert words == len(v.split())
        assert digits == sum(w.isdigit() for w in v.split())
        assert stripped == v.strip()
        assert found == re.findall(r"[A-Za-z_]\w*|[^\s\w]", v)
        assert blank == (not v.strip())


def skewed(n=4000):
    dice = random.Random(5)
    return [(7.0 if dice.random() < 0.35 else round(dice.gauss(0, 50), 1), dice.choice("ab")) for _ in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rows = skewed()
    df = spark.createDataFrame(rows, "v double, k string")
    counted = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in running_totals(counted, ["k"], "v", ["n"], descending, block_rows=40).collect():
        mine = [v for v, k in rows if k == r.k]
        assert r.n_before == sum(v > r.v if descending else v < r.v for v in mine)
        assert r.n_total == len(mine)


def test_exact_quantiles(spark):
    rows = [(v, float(i % 13)) for i, (v, _) in enumerate(skewed(1501))]
    df = spark.createDataFrame(rows, "x double, y double")
    got = {(r.name, r.q): r.value for r in exact_quantiles(df, ["x", "y"], [0.0, 0.5, 0.99, 1.0]).collect()}
    for j, name in enumerate("xy"):
        for q in (0.0, 0.5, 0.99, 1.0):
            assert abs(got[name, q] - np.quantile([r[j] for r in rows], q)) < 1e-9


def test_scan_index(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    read = spark.read.option("maxPartitionBytes", 2000).parquet(str(tmp_path / "t"))
    rows = with_scan_index(read, "i").collect()
    assert sorted(r.i for r in rows) == list(range(1000))


def test_clean_features(spark):
    pd = pytest.importorskip("pandas")
    dice = random.Random(1)
    rows = [(i, dice.choice([None, float("nan"), dice.gauss(0, 1)]), dice.randint(0, 400), dice.random() < 0.1, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, a double, b int, error boolean, target int")
    want = pd.DataFrame(rows, columns=["id", "a", "b", "error", "target"])
    want = want[~want.error].drop(columns="error").fillna(0)
    for c in ("a", "b"):
        want[c] = want[c].clip(upper=want[c].quantile(0.99))
    got = features.clean_features(df).toPandas().sort_values("id")
    assert np.allclose(got[["a", "b"]].to_numpy(float), want[["a", "b"]].to_numpy(float))
    assert list(got["target"]) == list(want["target"])


def test_splits(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), "x") for i in range(2000)], "id int, target int, v string")
    split = datasets.create_splits(df)
    counts = {(r.target, r.split): r["count"] for r in split.groupBy("target", "split").count().collect()}
    assert counts == {(0, "train"): 1260, (0, "val"): 270, (0, "test"): 270, (1, "train"): 140, (1, "val"): 30, (1, "test"): 30}
    assert split.select("id").distinct().count() == 2000 == split.count()
    with pytest.raises(ValueError):
        datasets.create_splits(df, 0.5, 0.1, 0.1)


def test_splits_without_target_and_hot_id(spark):
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, "x") for i in range(900)], "id int, v string")
    split = datasets.create_splits(df)
    assert split.count() == 900
    assert split.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_splits_keep_rows_without_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(400)], "id int, target int")
    assert datasets.create_splits(df).count() == 400


def test_many_classes_and_no_rows(spark):
    rows = spark.range(6000).select(F.col("id"), (F.col("id") % 2000).alias("target"))
    made = datasets.create_splits(rows)
    assert made.count() == 6000 and made.groupBy("target").count().where("count <> 3").count() == 0
    none = datasets.dataset_statistics(rows.where("false")).first()
    assert (none.total_rows, none.buggy_ratio) == (0, None)


def test_curves_of_one_class(spark):
    from lintlake.operators import evaluation

    rows = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.4)], "y_true int, y_pred int, y_proba double")
    assert {(r.fpr, r.tpr) for r in evaluation.roc_points(rows).collect()} == {(0.5, None), (1.0, None), (0.0, 0.0)}
    assert {(r.precision, r.recall) for r in evaluation.precision_recall_points(rows).collect()} == {(0.0, None), (1.0, 0.0)}


def test_pooling_without_tokens(spark):
    from lintlake.operators import embeddings

    rows = spark.createDataFrame([(1, [], []), (2, [[1.0, 3.0], [3.0, 5.0]], [1, 1])], "id int, v array<array<double>>, m array<int>")
    made = rows.select("id", embeddings.cls_embedding(F.col("v")).alias("c"), embeddings.mean_pooled_embedding(F.col("v"), F.col("m")).alias("p"))
    assert {r.id: (r.c, r.p) for r in made.collect()} == {1: (None, None), 2: ([1.0, 3.0], [2.0, 4.0])}


def test_validation(spark):
    empty = spark.createDataFrame([], "id int, a double, target int")
    assert [r.issue for r in datasets.validate_dataset(empty).collect()] == ["Dataset is empty."]
    odd = spark.createDataFrame([(i, 1.0, None if i else "x", int(i == 0)) for i in range(50)], "id int, a double, s string, target int")
    assert [r.issue for r in datasets.validate_dataset(odd).orderBy("position").collect()] == [
        "Severe class imbalance: 'buggy' class is < 5%. Consider SMOTE.",
        "Found 49 missing values across all columns.",
        "Feature 'a' has zero variance (constant value).",
    ]
    bare = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, a double")
    assert [r.issue for r in datasets.validate_dataset(bare).collect()] == ["Missing 'target' column for labels."]


def test_labels(spark):
    rows = [("a", "Accepted", 1), ("a", "Wrong", 2), ("b", None, 1), ("c", "Accepted", 1)]
    df = spark.createDataFrame(rows, "submission_id string, status string, line int")
    assert dict(labels.submission_labels(df, "line").collect()) == {"a": 1, "b": 1, "c": 0}
    words = spark.createDataFrame([("1", "Runtime ERROR"), ("2", "ok"), ("3", None)], "key string, verdict string")
    assert dict(labels.verdict_labels(words).collect()) == {"1": 1, "2": 0, "3": 0}
    numbers = spark.createDataFrame([("1", 1), ("2", 7)], "key string, verdict int")
    assert dict(labels.verdict_labels(numbers).collect()) == {"1": 1, "2": 7}
    known = spark.createDataFrame([("1", 1)], "key string, target int")
    ids = spark.createDataFrame([(1, 9), (2, 9)], "id int, target int")
    assert sorted(tuple(r) for r in labels.align_labels(ids, known).select("id", "target").collect()) == [(1, 1), (2, 0)]
    assert labels.align_labels(known, known) is known
    none = labels.label_statistics(known.where("false")).first()
    assert tuple(none) == (0, 0, 0, 0.0)


def test_good_rows_behind_a_bad_line_count(spark, tmp_path):
    from lintlake.sources import readers

    path = tmp_path / "l.jsonl"
    path.write_text('{"project":"p","commit_id":"c","target":1,"func":"x"}\n{"target":1}\n{"project":"p","commit_id":"c","target":0}\n{bad\n{"project":"q","commit_id":"d","target":1}\n')
    lines = readers.labelled_code(spark, str(path))
    assert dict(labels.code_labels(lines).collect()) == {"p_c": 0, "unk_1": 1, "q_d": 1}
    assert [tuple(r) for r in labels.bad_lines(lines).collect()] == [(3, "{bad")]


def truncate(code, limit):
    if not code or len(code.split()) * 1.5 <= limit or len(code.split("\n")) <= int(limit / 15):
        return code or ""
    rows, keep = code.split("\n"), int(limit / 15)
    head = int(keep * 0.6)
    return "\n".join([*rows[:head], "... [TRUNCATED] ...", *rows[head - keep :]])


def test_tokens(spark):
    texts = ["\n".join(f"line {i} a b c" for i in range(n)) for n in (0, 3, 10, 11, 60)] + [None, "x " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    for limit in (150, 512):
        got = [r[0] for r in df.select(tokens.truncate_code(F.col("code"), limit)).collect()]
        assert got == [truncate(t, limit) for t in texts]
    ids = tokens.tokenize(df, 16).collect()
    assert all(len(r.input_ids) == 16 == len(r.attention_mask) for r in ids)
    assert [sum(r.attention_mask) for r in ids] == [0, 12, 16, 16, 16, 0, 16]


def test_token_ids_by_value(spark):
    """Ids are the tokens' XXH64 with Spark's seed; the rest is padding."""
    xxhash = pytest.importorskip("xxhash")
    texts = ["def f(a):\n    return a + 1", "", None, "x = 'é' # ü", "a " * 700]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, code string")
    made = tokens.tokenize(df, 20).withColumn("t", tokens.default_tokens(F.col("code")))
    for r in made.collect():
        signed = [xxhash.xxh64_intdigest(t.encode(), 42) for t in r.t[:20]]
        signed = [h - (1 << 64) if h >> 63 else h for h in signed]
        want = [h % tokens.VOCABULARY + tokens.FIRST_ID for h in signed]
        assert r.input_ids == want + [tokens.PAD_ID] * (20 - len(want))
        assert r.attention_mask == [1] * len(want) + [0] * (20 - len(want))


def test_reduced_vectors_by_value(spark):
    """Principal components of centred vectors, up to the sign of each."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(200, 6)) * np.array([9, 5, 3, 1, 0.5, 0.1]) + 4
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    made = {int(r.id): r.embedding for r in embeddings.reduce_dimensions(df, 3).collect()}
    found = np.array([made[i] for i in range(200)])
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-8)
    assert np.allclose(np.abs((found * want).sum(axis=0)), (want * want).sum(axis=0), rtol=1e-8)


def test_ranks_are_selected_in_rounds(spark):
    """The same values when every interval must be narrowed, with hot values, ties, NaN and nulls."""
    from lintlake.functions import ranks

    dice = random.Random(9)
    values = [dice.choice([7.0, 7.0, dice.gauss(0, 1e6), dice.random(), float("inf"), -3.0]) for _ in range(9000)]
    rows = [("a", v) for v in values] + [("b", float(i)) for i in range(101)] + [("c", float("nan")), ("c", 1.0), ("d", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99]

    def rank(total, i):
        return int(shares[i] * (total - 1))

    for few in (100_000, 40):
        found = ranks.select_ranks(df, "g", "v", shares, rank, few)
        assert set(found) == {"a", "b", "c", None}
        for g in ("a", "b"):
            own = sorted(v for k, v in rows if k == g)
            for i, x in enumerate(found[g]):
                value = own[rank(len(own), i)]
                assert x == (value, own.index(value), own.count(value), len(own))
        assert found["c"][0].value == 1.0 and found["c"][0].total == 2


def test_quantiles_of_counts(spark):
    from lintlake.functions import ranks

    counted = spark.createDataFrame([(float(v), n) for v, n in ((3, 5), (1, 4), (10, 1), (4, 90))], "value double, n bigint")
    flat = np.repeat([1, 3, 4, 10], [4, 5, 90, 1])
    got = {r.q: r.value for r in ranks.quantiles_of_counts(counted, [0.0, 0.05, 0.5, 0.99, 1.0]).collect()}
    assert got == {q: pytest.approx(np.quantile(flat, q)) for q in got} and len(got) == 5
    assert ranks.quantiles_of_counts(counted.limit(0), [0.5]).count() == 0


def test_scan_index_follows_files(spark, tmp_path):
    """Rows count in the order of the names of their files, however the scan packs them."""
    for name, n in (("b", 10), ("a", 400), ("c", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    read = spark.read.option("maxPartitionBytes", 300).text(str(tmp_path))
    rows = {r.i: r.value for r in with_scan_index(read, "i").collect()}
    assert [rows[i] for i in range(413)] == [f"a{i}" for i in range(400)] + [f"b{i}" for i in range(10)] + [f"c{i}" for i in range(3)]
    plan = with_scan_index(read, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
