"""Repeated passages against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import op12_repeats as op12
from tests.llm.conftest import ODD


def brute(rows, window=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if counts[t[k : k + window]] > 1:
                gone[k : k + window] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **options):
    made = op12.removed(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in made.collect()), key=repr)


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 9))) for _ in range(n))


PASSAGE, OTHER = words(1, 60), words(2, 45)
PLANTED = [
    (1, words(3, 80) + PASSAGE + words(4, 70)), (2, words(5, 10) + PASSAGE), (3, PASSAGE[5:] + words(6, 50)), (4, words(7, 90)),
    (5, words(8, 30) + OTHER + words(9, 3) + OTHER + words(8, 30)),  # inside one text
    (6, words(10, 20) + PASSAGE[:199]), (7, PASSAGE[:200]), (8, PASSAGE[1:200]), (9, "ab" * 300), (10, "x" * 199), (11, "x" * 200), (12, "y" * 201),
    (13, words(11, 500)), (14, words(11, 500).replace("a", "é", 1)), (15, words(11, 500)), (15, words(11, 500)), (None, words(11, 250)), (None, words(11, 250)),
]


@pytest.mark.parametrize("rows", [PLANTED, ODD, PLANTED + ODD, []])
def test_removed(make_docs, rows):
    rows = [(i, t if len(t or "") < 100_000 else t[:3000]) for i, t in rows]
    assert found(make_docs(rows)) == brute(rows)


def test_small_table(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = brute(rows)
    assert found(small) == want and sum(r[2] for r in want) > 0


def test_very_long_text(make_docs):
    """A text of several stretches: what repeats across their borders is found."""
    own = words(20, 400_000)
    text = own + PASSAGE + own[: op12.HASHED + 5000] + PASSAGE
    assert len(text) > 2 * op12.HASHED
    (row,) = found(make_docs([(1, text)]))
    n = len(text.encode())
    assert row[1] == n and row[3] == 2
    assert row[2] >= len((own[: op12.HASHED + 5000] + PASSAGE + PASSAGE).encode())


def test_keys_dealt_to_many_tasks(make_docs, monkeypatch):
    """Pieces of one key that do not fit a task meet by their classes; so do rows of hot keys."""
    rows = [(i, words(100 + i % 30, 12) + PASSAGE + words(200 + i, 12 + i % 3)) for i in range(60)]
    monkeypatch.setattr(op12, "MOST_OF_KEY", 1500)
    monkeypatch.setattr(op12, "SORTED", 1000)
    monkeypatch.setattr(op12, "HOT_SHARE", 20)
    assert found(make_docs(rows)) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(8, 14))
def test_interval_expansion(found_, window):
    """Windows that occur twice, and classes of equal windows."""
    offsets, whole, again, number = op12.repeats(found_, window)
    counts = Counter(p[i : i + window] for p in found_ for i in range(len(p) - window + 1))
    of: dict = {}
    for o, p in zip(offsets.tolist(), found_):
        for i in range(len(p)):
            w = p[i : i + window]
            assert whole[o + i] == (len(w) == window)
            if whole[o + i]:
                assert again[o + i] == (counts[w] > 1)
                assert of.setdefault(w, number[o + i]) == number[o + i]
    assert len(set(of.values())) == len(of)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=400).map(lambda b: bytes(x % 5 for x in b)), min_size=1, max_size=4))
def test_pieces(texts):
    """Every window lies in exactly one piece, whose key depends on the window alone."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(x) for x in texts])]
    made = list(zip(*(x.tolist() for x in op12.pieces_of(t, offsets, 50, 12, op12._powers(len(t) + 1)))))
    seen = {}
    for text, start, count, key, times in made:
        for k in range(start, start + count):
            assert seen.setdefault((text, k), key) == key
            assert len(texts[text][k : k + 50]) == 50
    assert len(seen) == sum(max(0, len(x) - 49) for x in texts) == sum(m[2] for m in made)
    by_window = {}
    for (text, k), key in seen.items():
        assert by_window.setdefault(texts[text][k : k + 50], key) == key
