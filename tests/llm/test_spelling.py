"""Spelling variants against every pair of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import op11_spelling as op11
from tests.llm.conftest import ODD


def distance(a, b):
    """Levenshtein distance by the textbook."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_words(rows, least=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in op11.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


CHAIN = "aaaabbbb " * 2 + "aaaabbbc " * 20 + "aaaabbcc " * 300 + "aaaabbccd " * 4 + "ÀÉîõüÿß Àéîõüÿß àéîõüÿß " * 5 + "bbbbaaaa " * 2
LONG = [(20, f"{'q' * 40}x{'z' * 40} {'q' * 40}{'z' * 40} {'q' * 41}{'z' * 40} {'q' * 39}y{'z' * 40} " * 3)]


@pytest.mark.parametrize("rows", [[(1, CHAIN)], ODD, ODD + LONG + [(30 + i, CHAIN) for i in range(40)], []])
def test_variants(make_docs, rows):
    assert found(make_docs(rows)) == brute(brute_words(rows))


def test_small_table(small):
    rows = [(r.doc_id, r.text) for r in small.collect()][:40]
    docs = small.where(small.doc_id.isin([i for i, _ in rows]))
    made, want = found(docs), brute(brute_words(rows))
    assert made == want and sum(r[4] for r in want) > 20


def test_opened_and_dealt_nodes(spark):
    """The same links when every node is opened and words with equal counts are dealt to a grid."""
    words = {a + b + c: 2 for a in ("ab", "ba", "e", "", "xx") for b in ("nnt", "ntn", "tnn", "nn") for c in ("oooo", "ooro", "orooo", "wwww", "wkvy")}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = sorted((v, w) for v in words for w in words if distance(v, w) == 1)
    for blocks, most in (((4, 3, 3, 3), 10**6), ((4, 3, 3, 3), 4), ((1, 12), 1), ((13,), 2)):
        links = op11.links(table, blocks, most).collect()
        assert sorted((r.word, r.near) for r in links) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60))
def test_one_edit(a, b):
    assert op11.one_edit(a.encode(), b.encode()) == (distance(a, b) == 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abehÀ", min_size=1, max_size=40), min_size=2, max_size=12, unique=True))
def test_near_and_earlier(words):
    """Every pair at one edit is near both ways and looked for once."""
    import numpy as np

    letters = op11.Letters(words)
    a, b = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    a, b = a[a != b], b[a != b]
    assert letters.near(a, b).tolist() == [distance(words[i], words[j]) == 1 for i, j in zip(a, b)]
    assert (letters.earlier(a, b) ^ letters.earlier(b, a)).all()
    every = np.arange(len(words))
    pairs = {(i, j) for q, w in op11.search(letters.counts, every, every, few=1) for i, j in zip(q.tolist(), w.tolist())}
    near = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if distance(words[i], words[j]) == 1}
    assert all((i, j) in pairs or (j, i) in pairs for i, j in near)
