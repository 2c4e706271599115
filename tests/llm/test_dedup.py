"""Exact and near deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from lintlake.llm import op6_simhash as op6
from lintlake.llm import op7_exact_dedup as op7
from tests.llm.conftest import ODD


def brute_decisions(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        spent = False
        for i in ids:
            kept = i == keep and not spent
            spent |= kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ODD, [], [(i, "copy" if i % 3 else f"own {i}") for i in range(4000)]])
def test_exact_decisions(spark, make_docs, rows):
    docs = make_docs(rows)
    found = op7.decisions(docs, op7.new_index(spark), "b").collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute_decisions(rows)
    kept = op7.survivors(docs, op7.new_index(spark), "b")
    assert kept.columns == docs.columns
    want = [(r[0], r[4]) for r in brute_decisions(rows) if r[3]]
    got = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_index_lasts_over_batches(spark, make_docs):
    index = op7.new_index(spark)
    first, second = make_docs([(1, "a"), (2, "b"), (3, "a")]), make_docs([(4, "b"), (5, "c"), (6, "c")])
    assert {r.doc_id for r in op7.survivors(first, index, "one").collect()} == {2, 3}
    again = {r.doc_id: r.kept for r in op7.decisions(first, index, "one").collect()}  # a repeated job
    assert again == {1: False, 2: True, 3: True}
    later = {r.doc_id: (r.keep_id, r.kept) for r in op7.decisions(second, index, "two").collect()}
    assert later == {4: (2, False), 5: (6, False), 6: (6, True)}
    assert index.rows().count() == 3


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """{fp: smallest id reachable} from (id, fp) rows, by comparing all pairs."""
    least = {}
    for i, f in prints:
        least[f] = i if least.get(f) is None else min(least[f], i if i is not None else least[f])
    fps = list(least)
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[top(fps[a])] = top(fps[b])
    best = {}
    for f in fps:
        ids = [x for x in (best.get(top(f)), least[f]) if x is not None]
        best[top(f)] = min(ids, default=None)
    return {f: best[top(f)] for f in fps}


def check_components(found, rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    names = brute_components(prints)
    assert sorted([tuple(r) for r in found], key=repr) == sorted([(i, f"{f:016x}", names[f]) for i, f in prints], key=repr)


def test_components_of_odd_documents(make_docs):
    check_components(op6.components(make_docs(ODD)).collect(), ODD)
    assert op6.components(make_docs([])).count() == 0


def test_components_of_the_small_table(small):
    check_components(op6.components(small).collect(), [(r.doc_id, r.text) for r in small.collect()])


def planted_prints():
    import random

    random.seed(7)
    base = [random.getrandbits(64) for _ in range(40)]
    out = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            x = b
            for bit in random.sample(range(64), n):
                x ^= 1 << bit
            out.add(x)
    dense = base[0]
    for _ in range(1500):  # many prints that meet in one variant, linked and not
        x = dense
        for bit in random.sample(range(22), random.randint(0, 11)):
            x ^= 1 << bit
        out.add(x)
    return sorted(out)


def test_links_are_whole(spark):
    fps = planted_prints()
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = {r.node & op6.FULL: r.name & op6.FULL for r in op6.connected(op6.links(rows)).collect()}
    want = brute_components([(f, f) for f in fps])
    mine, theirs = defaultdict(set), defaultdict(set)
    for f in fps:
        mine[found.get(f, f)].add(f)
        theirs[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_groups_are_not_gathered(spark):
    """The same components when groups of over a few fingerprints meet again in whole variants."""
    draw = random.Random(11)
    family = draw.getrandbits(64)
    prints = {family ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(150)}
    for _ in range(60):  # chains that link at exactly three bits, and strangers
        a = draw.getrandbits(64)
        prints |= {a, a ^ 7 << draw.randrange(61), a ^ sum(1 << b for b in draw.sample(range(64), 3)), a ^ sum(1 << b for b in draw.sample(range(64), 4))}
    rows = spark.createDataFrame([(op6._signed(p),) for p in prints], "fp bigint")
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(prints)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = Counter(frozenset(p for p in prints if top(p) == r) for r in {top(p) for p in prints})
    for most in (50_000, 5, 1):
        parts = defaultdict(set)
        for r in op6.connected(op6.links(rows, most)).collect():
            parts[r.name].add(r.node & op6.FULL)
        # the smallest node names a component and is not among the others
        got = Counter(frozenset(v | {k & op6.FULL}) for k, v in parts.items())
        assert got == Counter({k: n for k, n in want.items() if len(k) > 1})


def test_dense_groups_do_not_emit_pairs():
    fps = sorted({i for i in range(1 << 11)})
    assert len(op6._forest(fps, 0)) == len(fps) - 1


def test_near_survivors(make_docs):
    long = " ".join(f"w{i}" for i in range(400))
    docs = make_docs([(5, long), (3, long + " end"), (9, "quite another text of its own"), (4, long)])
    kept = op6.survivors(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_near_survivors_one_per_component(make_docs):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [
        (None, "one text without an id"), (None, "quite another text that has none"), (None, None), (None, long),  # null ids
        (5, long + " end"), (7, long), (6, "one text under a used id"), (6, "its id names something else again"),
        (6, "its id names something else again"), (5, "the fifth of something apart from all"),
    ]
    names = brute_components([(k, brute_print(t)) for k, (_, t) in enumerate(rows)])
    components = defaultdict(list)
    for i, t in rows:
        components[names[brute_print(t)]].append((i, t))
    assert len(components) == 7
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = [min(c, key=order) for c in components.values()]
    kept = [(r.doc_id, r.text) for r in op6.survivors(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
