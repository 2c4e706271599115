"""Packing: ids against the tokenizer itself, every id in one piece, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lintlake.llm import op3_packing as op3
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = ["a  b", "a\n b", "a \nb", "a   b", " ", "  ", " \n x", " x  ", "it 's it's", "x  y", "x　y z", "\n\n a", "end\n", "é́ à", "a <|endoftext|> b"]


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, found, ids_of, window=2048):
    want = sorted((repr(i), len(ids_of(t)), tuple(ids_of(t))) for i, t in rows)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        assert 0 < r.length <= window
        pieces[(repr(r.doc_id), r.doc_tokens)].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for (name, n), own in pieces.items():
        texts = [w[2] for w in want if w[:2] == (name, n)]
        assert sum(p.length for p in own) == n * len(texts)
        parts = sorted((p.start, p.length, p.ids_crc32) for p in own)
        if len(texts) == 1:
            at = 0
            for start, length, crc in parts:
                assert start == at and crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4").tobytes())
                at += length
    assert {(w[0], w[1]) for w in want} == set(pieces)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return sum(window - sum(n for _, n in own) for own in places.values())


def test_odd_documents(make_docs, ids_of):
    rows = ODD + [(100 + i, t) for i, t in enumerate(SPACES)]
    check(rows, op3.pack(make_docs(rows), PATH).collect(), ids_of)
    assert op3.pack(make_docs([]), PATH).count() == 0


def test_small_table(small, ids_of):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    found = op3.pack(small, PATH).collect()
    padding = check(rows, found, ids_of)
    assert padding < 2048 + 0.01 * sum(r.length for r in found)


def test_encoder_equals_the_tokenizer(small, ids_of):
    encode = op3.Encoder(PATH)
    for text in [*SPACES, "", *[r.text for r in small.limit(40).collect()]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_batches_equal_single_texts(small, ids_of):
    """Parts that several texts share, as their first and as a later one, and a cache that is too small."""
    texts = [*SPACES, "", "a b a", "b a", "b", "a", *[r.text for r in small.limit(60).collect()], "x\u00a0 y", "x\u2003 y z"] * 2
    for cached in (5, op3.CACHED):
        encode = op3.Encoder(PATH)
        encode.cache.update(dict.fromkeys([f"filler {i}" for i in range(op3.CACHED - cached)], b""))
        for _ in range(2):
            assert [x.tolist() for x in encode.batch(pa.array(texts))] == [ids_of(t)[:-1] for t in texts]


def test_best_fill_is_the_closest():
    random.seed(3)
    for _ in range(200):
        counts = {random.randint(1, 60): random.randint(1, 5) for _ in range(random.randint(0, 6))}
        capacity = random.randint(0, 120)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        fill = op3.best_fill(counts, capacity)
        assert all(0 < v <= counts[k] for k, v in fill.items())
        assert sum(k * v for k, v in fill.items()) == max(s for s in sums if s <= capacity)


def test_windows_are_full_but_the_last():
    random.seed(5)
    pieces = [(i, 0, random.randint(1, 2047)) for i in range(5000)]
    windows = list(op3.pack_block(pieces, 2048))
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert sum(sizes) == sum(p[2] for p in pieces)
    assert sum(2048 - s for s in sizes) < 2048 + 16 * len(sizes)
    got = defaultdict(list)
    for w in windows:
        for item, start, n in w:
            got[item].append((start, n))
    for item, _, n in pieces:
        at = 0
        for start, k in sorted(got[item]):
            assert start == at
            at += k
        assert at == n
