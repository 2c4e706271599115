"""The learned operators: held-out accuracy, the grammar, rules against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm import op2_toxicity as op2
from lintlake.llm import op4_maxent as op4
from lintlake.llm import op5_divergence as op5
from lintlake.llm import op9_quadratic as op9
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def no_marks(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def held_out(found, marks, column, fold):
    rows = found.join(marks, "doc_id").select("doc_id", "held_out", "predicted", column).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    return Counter((r[column], r.predicted) for r in rows if r.held_out)


def test_quality_held_out(labelled):
    found = op9.score(*labelled)
    c = held_out(found, labelled[1], "quality", (3, 1))
    assert c[1, 1] > 0.99 * (c[1, 0] + c[1, 1]) and c[0, 0] > 0.95 * (c[0, 0] + c[0, 1])
    docs, marks = labelled
    kept = op9.accepted(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in found.where("predicted = 1").collect()}


def test_toxicity_held_out(labelled):
    c = held_out(op2.score(*labelled), labelled[1], "toxic", (4, 2))
    assert c[1, 1] > 0.85 * (c[1, 0] + c[1, 1]) and c[0, 0] > 0.98 * (c[0, 0] + c[0, 1])


@pytest.mark.parametrize("op, label", [(op9, "quality"), (op2, "toxic")])
def test_odd_documents_get_scores(spark, make_docs, no_marks, op, label):
    marks = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (8, None, None), (None, 1, 1), (777, 0, 1), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    for m in (marks, no_marks):
        rows = op.score(make_docs(ODD), m).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= op.THRESHOLD) for r in rows)
    assert op.score(make_docs([]), marks).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, labelled):
    docs, marks = labelled[0].limit(600), labelled[1]
    from pyspark.sql import functions as F

    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in op9.score(docs, m).collect()} for m in (marks, flipped))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_grammar_weighs_clauses():
    s = op2.Scorer([("idiot", False, 3.0), ("blork", True, 2.0)])

    def heaviest(text):
        return max(s.clauses(text), default=0)

    assert heaviest("an idiot came in") == 3.0
    assert heaviest("you are an idiot") == 4.5
    assert heaviest("idiot, you") > 3.0
    assert heaviest("not an idiot") == 0.5
    assert heaviest("the sign said idiot") < 3.0
    assert heaviest('"idiot" was on the wall') < 3.0
    assert heaviest("blorkish words") == 2.0 and heaviest("idiots ablork") == 0
    assert heaviest("I will kill you") == 4.0
    assert heaviest("kill the process") == 0
    assert len(s.clauses("idiot. A pause. Idiot!")) == 2


def test_composition_is_the_cascade():
    import itertools

    parts = [op2.negation(), op2.reported(), op2.target(), op2.threat(), op2.insult()]
    whole = op2.grammar()
    for run in itertools.product("xIYNT", repeat=5):
        symbols, weights = list(run), [0.0] * 5
        for part in parts:
            state = part.start
            for k, s in enumerate(symbols):
                state, symbols[k], w = part.step(state, s)
                weights[k] += w
        want = []
        for s, w in zip(symbols, weights):
            if s == op2.MATCH:
                want.append(w)
            elif w and want:
                want[-1] += w
        assert whole.weights(list(run)) == want


def test_denied_and_told_threats():
    s = op2.Scorer([("idiot", False, 3.0)])
    threat, denied, told = 4.0, -2.5, -1.5
    for text, weight in {
        "I will kill you": threat,
        "I will not kill you": threat + denied,
        "he said he will hurt you": threat + told,
        'the wall read "I will kill you"': threat + told,
        "kill you": 2.0, "he said kill you": 2.0 + told, "she says I will kill all you": threat - 1 + told,
        "I will not kill but of course beat you": 2.0,
        'he wrote "I will kill" then said he will hurt you': threat + told,
        '"I will kill" or hurt you': threat - 1,
    }.items():
        assert s.clauses(text) == [weight], text
    assert s.clauses("do not kill you") == [] and s.clauses("he said he will not kill you") == []
    # the insult's own weight stays, the penalty goes to the threat behind it
    weights = lambda run: op2.grammar().weights(list(run))
    assert weights("IxFNTY") == [0.0, threat + denied] and weights("IRxFTY") == [0.0, threat + told]
    assert weights("IxQFTYQ") == [0.0, threat + told] and weights("IxFTY") == [0.0, threat] and weights("IxNT") == [0.0]
    assert s.clauses("idiot he does not kill") == s.clauses("idiot he does kill") == [3.75]


def test_quotations_go_on_over_full_stops():
    s = op2.Scorer([("idiot", False, 3.0), ("loser", False, 3.0)])
    one = s.clauses('he wrote: "you are an idiot"')
    assert s.clauses('he wrote: "Listen. you are an idiot. you are a loser." You are an idiot.') == [3.0, 3.0, 4.5] and one == [3.0]
    assert s.clauses("„Hör. you are an idiot.“ you are a loser") == [3.0, 4.5]
    assert s.clauses("«Oui. you are an idiot. Non» you are a loser") == [3.0, 4.5]
    assert s.clauses("“So. you are an idiot!” you are a loser. you are a loser") == [3.0, 4.5, 4.5]
    # a mark without its other half ends with the line
    assert s.clauses('5" wide. you are an idiot\nyou are a loser') == [3.0, 4.5]
    assert s.clauses("isn't he an idiot") == s.clauses("is not he an idiot") and s.clauses("he can’t be an idiot")[0] < 3.0


def test_clauses_are_found_in_one_walk():
    """The time of a long text grows with its length, with and without separators."""
    import time

    s = op2.Scorer([("idiot", False, 3.0)])
    for piece in ("an idiot came in. some other words stand here, and more of them ", "idiot, ", 'he said "x. an idiot '):
        took = []
        for n in (400_000, 3_200_000):
            text = piece * (n // len(piece))
            start = time.process_time()
            assert len(s.clauses(text)) >= 1
            took.append(time.process_time() - start)
        assert took[1] < 20 * max(took[0], 0.02)


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed


def check_rules(rows, found):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted([(repr(i), *brute_rules(t)) for i, t in rows]) == sorted((repr(r.doc_id), *[r[n] for n in names]) for r in found)
    assert not any(r.kept for r in found if r.base_failed)


def test_rules(make_docs, small):
    odd = [(i, t) for i, t in ODD if i not in (7, 11)] + [(50, "a b c a b c x"), (51, " \n \n \n \n"), (52, "l\r\nl\r\nl"), (53, "a b c d e f " * 30)]
    check_rules(odd, op5.judge(make_docs(odd)).collect())
    check_rules([(r.doc_id, r.text) for r in small.collect()], op5.judge(small).collect())
    assert op5.judge(make_docs([])).count() == 0


def test_long_texts_pass_the_rules_code(make_docs):
    rows = [(i, t) for i, t in ODD if i in (7, 11)]
    found = {r.doc_id: r for r in op5.judge(make_docs(rows)).collect()}
    assert found[7].n_words == 60_000 and found[7].n_repeat_words == 60_000 and found[7].base_failed
    assert found[11].n_words == 1 and found[11].word_chars == 200_000


def test_divergence_keeps_clean_documents(labelled):
    found = op5.judge(labelled[0]).join(labelled[1], "doc_id").where("NOT base_failed").collect()
    clean = [r.kept for r in found if r.quality == 1]
    junk = [r.kept for r in found if r.quality == 0]
    assert np.mean(clean) > 0.995 and np.mean(junk) < 0.15


def test_distance():
    a, b = np.array([1.0, 1, 0]), np.array([0.0, 0, 5])
    assert op5.distance(a, a * 7) == 0 and abs(op5.distance(a, b) - 1) < 1e-12
    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = sum(x * np.log2(x / y) / 2 for u in (p, q) for x, y in zip(u, m) if x)
    assert abs(op5.distance(p, q) - want**0.5) < 1e-12


def brute_base(rows):
    train, docs = Counter(), []
    for i, t in rows:
        words = [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        docs.append((i, held, words))
        if not held:
            train.update(words)
    n, v = sum(train.values()), len(train)
    return [
        (repr(i), held, len(w), sum(train[x] > 0 for x in w), n, float(sum(np.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
        for i, held, w in docs
    ]


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_language_model_base(make_docs, small, which):
    rows = {"odd": ODD, "none": []}.get(which)
    docs = small if rows is None else make_docs(rows)
    rows = [(r.doc_id, r.text) for r in small.collect()] if rows is None else rows
    found = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in op4.score(docs).collect())
    want = sorted(brute_base(rows))
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5] for f in found], [w[5] for w in want], rtol=1e-9)


def test_language_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = op4.score(docs).groupBy("held_out").sum("score", "base_score", "n_tokens").collect()
    for x in r:
        assert x["sum(score)"] > x["sum(base_score)"] + 0.1 * x["sum(n_tokens)"]


def test_language_model_has_its_full_tables(labelled):
    # 16,384 x 52 weights and two rounds gain 0.698 a held-out token
    r = {x.held_out: x for x in op4.score(labelled[0]).groupBy("held_out").sum("score", "base_score", "n_tokens").collect()}[True]
    assert r["sum(score)"] > r["sum(base_score)"] + 0.71 * r["sum(n_tokens)"]


def test_probabilities_sum_to_one():
    """Over all words and rare kinds, in any context, for any weights; without weights a word has its count share."""
    words = ["the", "of", *[f"w{i}" for i in range(500)]]
    counts = np.arange(len(words), 0, -1).astype(float) ** 1.5 + 2
    v = op4.Vocabulary(words, counts, np.arange(len(words)) % op4.HASHED_KINDS)
    rare = np.arange(op4.KINDS + 1) * 10.0
    v.grow(rare)
    reader = op4.Reader(v)
    _, keys = op4.contexts([np.arange(6).astype(np.uint64)])
    leaves = np.arange(len(words) + op4.KINDS + 1)
    weights = op4.new_weights()
    share = np.concatenate([counts, rare + 0.5])
    for seed in (None, 1, 2):
        if seed:
            weights[:] = np.random.default_rng(seed).normal(size=weights.shape)
        for context in range(keys.shape[1]):
            p = np.exp(op4.token_logs(reader, weights, leaves, np.repeat(keys[:, [context]], len(leaves), axis=1)))
            assert abs(p.sum() - 1) < 1e-4
            if seed is None:
                assert np.allclose(p, share / share.sum(), rtol=1e-4)


def test_tree_of_classes():
    """Every leaf has one way, nodes have at most FAN children, and frequent words lie near the root."""
    draw = np.random.default_rng(5)
    for n in (1, 2, 16, 17, 40, 5000):
        for weights in (np.ones(n), 1e6 / np.arange(1, n + 1) ** 1.2, draw.integers(1, 9, n).astype(float), np.r_[1e9, np.ones(n - 1)]):
            tree = op4.Tree(draw.integers(0, 3, n), weights)
            ways = [tuple(zip(tree.nodes[s : s + d].tolist(), tree.children[s : s + d].tolist())) for s, d in zip(tree.start, tree.depth)]
            assert len(set(ways)) == n and all(0 <= c < op4.FAN for w in ways for _, c in w)
            logs = np.array([sum(tree.bias[node, child] for node, child in w) for w in ways])
            assert np.allclose(np.exp(logs), weights / weights.sum(), rtol=1e-3)
            order = np.argsort(-weights, kind="stable")
            if n == 5000:
                bits = -(weights / weights.sum() * np.log2(weights / weights.sum())).sum()
                assert (tree.depth * weights).sum() / weights.sum() <= bits / 4 + 2.1
                assert weights.max() < 100 * weights.min() or tree.depth[order[0]] < tree.depth[order[-1]]


def test_split_is_the_split_of_bytes():
    texts = ["", " ", "a", " A  b\tC\nd\x0be\x0cf\rg ", "É ÀÖ x\u00a0y z\u2003w", "a\x1cb", "\n\n", "word " * 300]
    distinct, at, sizes = op4.split(pa.array(texts))
    words = [w.encode() for w in distinct.to_pylist()]
    assert [words[i] for i in at] == [w for t in texts for w in op4.tokens(t)]
    assert sizes.tolist() == [len(op4.tokens(t)) for t in texts]


def test_training_step_follows_the_slope(spark):
    """One step of one task against the same step written out choice by choice."""
    words = [f"w{i}" for i in range(40)]
    v = op4.Vocabulary(words, np.arange(60, 20, -1).astype(float), np.arange(40) % 3)
    v.grow(np.full(op4.KINDS + 1, 4.0))
    start = op4.new_weights()
    start[:] = np.random.default_rng(3).normal(0, 0.1, start.shape)
    text = " ".join(words[i * 7 % 40] for i in range(90)) + " unseen words"
    made = op4.train_round(spark.createDataFrame([(text,)], "text string"), spark.sparkContext.broadcast((v, start))).collect()
    reader = op4.Reader(v)
    y, keys = op4.contexts([np.array(reader.ids(op4.tokens(text)))])
    slopes, met = {}, Counter()
    for table, rows, bias, child, _ in reader.choices(reader.leaves(y), keys):
        for k in range(len(child)):
            z = bias[k].astype(float) + sum(start[table][t, rows[t, k]] for t in range(len(rows)))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            for t in range(len(rows)):
                at = (table.start + t) * op4.ROWS + int(rows[t, k])
                slopes[at] = slopes.get(at, 0) + np.eye(op4.FAN)[child[k]] - p
                met[at] += 1
    assert {r.row: r.seen for r in made} == dict(met)
    for r in made:
        g = slopes[r.row]
        want = op4.RATE * g / np.sqrt(1e-3 + (g * g).sum()) * r.seen
        assert np.allclose([r[f"d{c}"] for c in range(op4.FAN)], want, atol=2e-3)


def brute_statistics(text):
    """The classifier's statistics from their definitions, character by character."""
    import unicodedata

    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    kinds = Counter()
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace():
            kinds["space"] += 1
        elif kind[0] == "L":
            kinds["upper" if kind in ("Lu", "Lt") else "lower"] += 1
        elif kind[0] == "N":
            kinds["digit"] += 1
        elif c in ".,;:'\"!?-()" or kind in ("Pd", "Pi", "Pf"):
            kinds["prose"] += 1
        elif kind[0] in "PS":
            kinds["symbol"] += 1
    n, size, letters = max(len(words), 1), max(len(text), 1), max(kinds["upper"] + kinds["lower"], 1)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    log = np.log
    return [
        log(len(words) + 5), log(sum(map(len, words)) / n + 1), log(sum(text.count(c) for c in "#*$%&|<>") / n + 0.002),
        log(kinds["upper"] / letters + 0.002), log(kinds["digit"] / size + 0.002), log(kinds["prose"] / n + 0.002),
        log(kinds["symbol"] / size + 0.002), log(kinds["space"] / size + 0.002), log((len(lines) - len(set(lines))) / max(len(lines), 1) + 0.02),
        log(len(again) / n + 0.02), log(max(Counter(words).values(), default=0) / n + 0.02), log((len(set(words)) + 5) / (n + 5) ** 0.75),
        log(sum(len(w.encode()) == 1 and not w.isalnum() for w in words) / n + 0.01), log(text.count("!") / n + 0.01),
    ]


def test_quadratic_discriminant_by_the_textbook(small, make_docs, spark):
    """Statistics, class covariances and log densities made anew, for every document."""
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(10_000 + k, t) for k, (_, t) in enumerate(ODD) if k not in (6, 13)]
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    x = {i: np.array(brute_statistics(t or "")) for i, t in rows}
    own = {k: np.array([x[i] for i, q in marks if q == k and i in x and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)}
    total = sum(map(len, own.values()))
    covs = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(len(own[k]) * covs[k] for k in own) / total
    scale = np.sqrt(np.diag(pooled))
    logs = {k: {} for k in own}
    for k, v in own.items():
        lam = max(op9.POOLED, 14 / (len(v) + 14))
        c = ((1 - lam) * covs[k] + lam * pooled) / np.outer(scale, scale)
        c = np.where(np.eye(14) > 0, c, (1 - op9.DIAGONAL) * c) + op9.RIDGE * np.eye(14)
        for i, a in x.items():
            z = (a - v.mean(axis=0)) / scale
            logs[k][i] = np.log(len(v) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * z @ np.linalg.solve(c, z)
    table = spark.createDataFrame(marks, "doc_id bigint, quality int")
    found = op9.score(make_docs(rows), table).collect()
    assert len(found) == len(rows)
    for r in found:
        want = 1 / (1 + np.exp(min(700, logs[0][r.doc_id] - logs[1][r.doc_id])))
        assert abs(r.score - want) < 1e-6 and (abs(want - 0.5) < 1e-6 or r.predicted == int(want >= 0.5)), (r, want)


def test_words_are_looked_up_all_at_once_as_one_by_one(monkeypatch):
    words = ["a", "zwölf", "漢字x", "of", "\n", "🙂"]
    v = op4.Vocabulary(words, np.arange(60, 54, -1).astype(float), np.arange(6) % 3)
    v.grow(np.full(op4.KINDS + 1, 4.0))
    reader = op4.Reader(v)
    names = [*words, "", "b", "zz", "ünd", "漢", "🙂🙂", "longer-word", "nul\0", "a"]
    alone = [reader.id_of(w.encode()) for w in names]
    assert min(alone[6:14]) >= op4.WORDS and alone[14] == 0

    def refused(self, word):
        raise AssertionError("a word was looked up by itself")

    monkeypatch.setattr(op4.Reader, "id_of", refused)
    assert reader.ids_of(pa.array(["x", *names])[1:]).tolist() == alone
    _, ids, at, sizes = op4.Reader(v).batch(pa.array(["A of zwölf ünd", "", "  b "]))
    assert ids[at].tolist() == [alone[0], alone[3], alone[1], alone[9], 4, 4, alone[7], 4] and sizes.tolist() == [5, 1, 2]


def test_sums_by_row_are_those_of_each_row():
    draw = np.random.default_rng(3)
    for n, rows in ((1, 5), (40, 5), (4000, 700), (4000, 4)):
        r, x = draw.integers(0, rows, n).astype(np.uint16), draw.normal(size=(n, op4.FAN)).astype(np.float32)
        at, times, sums = op4.sums_by_row(r, x)
        assert sorted(at.tolist()) == np.unique(r).tolist() and times.tolist() == [int((r == a).sum()) for a in at]
        assert np.allclose(sums, [x[r == a].sum(axis=0) for a in at], atol=1e-3)


def test_changes_are_not_summed_before_they_meet(spark):
    v = op4.Vocabulary(["a", "b"], np.array([5.0, 3.0]), np.arange(2))
    v.grow(np.full(op4.KINDS + 1, 4.0))
    docs = spark.createDataFrame([("a b a",), ("b a",)], "text string").repartition(2)
    made = op4.train_round(docs, spark.sparkContext.broadcast((v, op4.new_weights())))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert made.count() == made.select("row").distinct().count()
