"""Mixing and sharding: brute force where results are fixed, laws where they are not."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lintlake.llm import op8_mixing as op8
from lintlake.llm import op10_sharding as op10
from tests.llm.conftest import ODD

SOURCES = ["b", None, "a", "é", "A", "z"]
MANY = [(i, "w " * (i % 37), SOURCES[min(i % 11, 5)]) for i in range(3000)]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(2 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def brute_taken(rows, aims, sizes):
    def key(i, t):
        own = ("" if i is None else str(i)) + "#" + hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(own.encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        plain = sum(c not in "#$%&*|<>{}[]=+\\^~_@!" for c in t or "")
        return -math.log(u) / (max(0.05, plain / len(t)) if t else 0.05)

    out = []
    for s in sizes:
        own = sorted(((key(i, t), -1 if i is None else i, n, i) for i, t, src, n in rows if src == s), key=lambda x: x[:3])
        epochs = int(aims[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(aims[s] + 0.5) - epochs * sizes[s]
        for _, _, n, i in own:
            part = max(0, min(n, left))
            left -= part
            out.append((i, n, s, epochs * n + part))
    return out


@pytest.mark.parametrize("rows", [MANY, [(*r, "s") for r in ODD], []])
def test_mix(make_docs, rows):
    docs = make_docs(rows)
    found = op8.mix(docs, carry=False).collect()
    sized = [(i, t, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, _, s, n in sized:
        sizes[s] += n
    aims = brute_targets(sizes)
    want = [(i, n, sizes[s], aims[s], taken) for i, n, s, taken in brute_taken(sized, aims, sizes)]
    assert sorted([tuple(r) for r in found], key=repr) == sorted(want, key=repr)


def test_mixed_documents(make_docs):
    docs = make_docs(MANY)
    out = op8.mixed(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.select("doc_id").collect())
    sizes, got, largest = Counter(), Counter(), Counter()
    for i, t, s in MANY:
        n = len(t.split())
        sizes[s] += n
        got[s] += n * times[i]
        largest[s] = max(largest[s], n)
    assert max(times.values()) <= 2
    aims = brute_targets(sizes)
    assert all(abs(got[s] - aims[s]) <= largest[s] / 2 + 1 for s in aims)


def check_shards(rows, found, shards=16):
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == Counter(
        (r.doc_id, r["size"], r.text_crc32) for r in found
    )
    slots = defaultdict(list)
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_documents(make_docs):
    check_shards(ODD, op10.shard(make_docs(ODD)).collect())
    assert op10.shard(make_docs([])).count() == 0


def test_shards_are_even_and_keep_texts_together(make_docs):
    rows = [(i, "copy " * 20 if i < 1500 else f"text {i} " * (i % 50)) for i in range(30_000)]
    found = op10.shard(make_docs(rows)).collect()
    check_shards(rows, found)
    loads, homes = Counter(), defaultdict(set)
    for r in found:
        loads[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
    mean = sum(loads.values()) / 16
    assert len(loads) == 16 and max(abs(n - mean) for n in loads.values()) < 0.02 * mean
    assert all(len(s) == 1 for s in homes.values())


def test_a_text_heavier_than_a_shard_is_split(make_docs):
    rows = [(i, "hot text " * 9 if i % 3 else f"own {i} " * 10) for i in range(6000)]
    found = op10.shard(make_docs(rows)).collect()
    check_shards(rows, found)
    loads = Counter()
    for r in found:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 16


def test_ranges_and_deal_against_brute_force(make_docs, spark):
    """Boundaries, sizes of ranges, the deal of ranges to shards and the slots, made anew in Python."""
    import xxhash

    rows = [(i, f"text {i} " * (i % 23)) for i in range(6000)]
    key = {i: float((xxhash.xxh64_intdigest(t.encode(), 42)) >> 12) for i, t in rows}
    size = {i: len(t.encode()) + 1 for i, t in rows}
    table = spark.createDataFrame([(i, key[i], size[i]) for i, _ in rows], "doc_id bigint, key double, size bigint")
    cuts = op10.splitters(table, sum(size.values()), 64, 32)
    assert cuts == sorted(set(cuts)) and 32 < len(cuts) <= 65
    own = {i: bisect.bisect_right(cuts, key[i]) - 1 for i, _ in rows}
    weight = Counter()
    for i, r in own.items():
        weight[r] += size[i]
    mean = sum(size.values()) / 64
    assert 0.4 * mean < sum(weight.values()) / len(weight) and max(weight.values()) < 8 * mean
    found = {r.doc_id: r for r in op10.shard(make_docs(rows), ranges=4).collect()}
    homes = defaultdict(set)
    for i, r in own.items():
        homes[r].add(found[i].shard)
    even = [r for r, n in weight.items() if n <= 2 * mean]
    assert all(len(homes[r]) == 1 for r in even) and len(even) > 32
    loads = Counter()
    for r in found.values():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 2.5 * mean
    for r in even:  # rows of a range of few rows follow each other in the order of their keys
        members = sorted((i for i in own if own[i] == r), key=lambda i: (key[i], i))
        if len(members) <= 2 * len(rows) // 64:
            slots = [found[i].slot for i in members]
            assert slots == list(range(slots[0], slots[0] + len(slots)))
    sizes = [(n, r) for r, n in sorted(weight.items())]
    want, light = {}, [0] * 16
    for n, r in sorted(sizes, reverse=True):
        k = min(range(16), key=lambda s: (light[s], s))
        want[r] = k
        light[k] += n
    assert op10.deal([(r, n) for n, r in sizes], 16) == want


def test_many_rows_of_one_short_text(make_docs, spark):
    """A third of the rows empty, half of them without an id: one shard, but no task sorts them whole."""
    rows = [((None if i % 2 else i), "") if i % 3 == 0 else (i, f"text {i} " * (i % 9 + 1)) for i in range(20_000)]
    made = op10.shard(make_docs(rows))
    found = made.collect()
    check_shards(rows, found)
    assert len({r.shard for r in found if r["size"] == 1}) == 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan
    loads = Counter()
    for r in found:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.02 * sum(loads.values()) / 16


def test_rows_without_an_id_are_drawn_as_others(make_docs):
    """Half of the ids null: they get their share of the words, and a repeated id is drawn by its texts."""
    rows = [(None if i % 2 else i % 5000, "w " * (1 + i % 7) + str(i), "s") for i in range(12_000)]
    found = op8.mix(make_docs(rows), carry=False, share=0.5).collect()
    share = {null: sum(r.taken for r in found if (r.doc_id is None) == null) / sum(r["size"] for r in found if (r.doc_id is None) == null) for null in (True, False)}
    assert abs(share[True] - 0.5) < 0.03 and abs(share[False] - 0.5) < 0.03
