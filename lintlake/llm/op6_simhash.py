"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Two of them at distance 2 or less meet in
a variant that differs from each in one bit at most: half the radius, rounded down. The odd third bit
is taken care of by blocks: the 64 bits are cut into three, and whichever way three differing bits
fall, leaving out the block with most of them leaves two at most. So every distinct fingerprint emits,
for each left-out block, all variants of the other bits within one flip (3 * (1 + about 43) rows, against
2,081 for a ball of radius two), variants are shuffled, and what meets in one is verified in full.

Copies count once: fingerprints are made distinct (with their smallest id) before anything is emitted.
In a group of m fingerprints that meet, links are found by lookups in the left-out block, at most
1,562 * m of them and never m * m, and only a spanning forest of the verified links, at most m - 1,
leaves the task. A group of over ``MOST_MET`` is not gathered: its fingerprints emit their flips inside the
left-out block as well and meet again in whole variants, where there is room for a bounded number. Components are joined up with large-star/small-star rounds on stored tables.

Defined results: null text is empty; a text without words has fingerprint zero, one of fewer than three
words has its whole sequence as the only shingle; a null id is never the component's name unless all its
ids are null; repeated rows give repeated results; an empty table gives no rows; other columns are
ignored by ``components`` and carried by ``survivors``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.llm.common import give_back, narrow, scalar_row, stored
from lintlake.llm.op7_exact_dedup import digest

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints whose variants one task emits, and fingerprints of a variant that a task verifies at once.
EMITTED, MOST_MET = 20_000, 50_000
#: First bit and width of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
FULL = (1 << 64) - 1


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words of the text with A-Z lowered."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(slice, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED))
    return np.fromiter(hashes, np.uint64, len(words) - size + 1)


def fingerprint(text: str) -> int:
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def make(batches):
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])
            give_back()

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def variants(distinct: DataFrame) -> DataFrame:
    """(block, variant, fp): the ball of radius one around what is outside each block."""
    flips = []
    for k, (first, width) in enumerate(BLOCKS):
        outside = [b for b in range(64) if not first <= b < first + width]
        keep = sum(1 << b for b in outside)
        flips += [(k, keep, 0), *[(k, keep, 1 << b) for b in outside]]
    ball = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(_signed(keep)).alias("keep"), F.lit(_signed(bit)).alias("bit")) for k, keep, bit in flips])
    out = distinct.select("fp", F.explode(ball).alias("v"))
    return out.select(F.col("v.block").alias("block"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.bit")).alias("variant"), "fp")


def _forest(fps: list[int], block: int) -> list[tuple[int, int]]:
    """Verified links, as a spanning forest, among distinct fingerprints that meet in a variant."""
    if len(fps) == 2:
        return [(fps[0], fps[1])] if (fps[0] ^ fps[1]).bit_count() <= RADIUS else []
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []

    def link(a, b):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((min(a, b), max(a, b)))

    if len(fps) <= 1000:
        values = np.array(fps, np.uint64)
        for i, f in enumerate(fps[:-1]):
            for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ np.uint64(f)) <= RADIUS):
                link(f, fps[i + 1 + int(j)])
        return links
    first, width = BLOCKS[block]
    inside = ((1 << width) - 1) << first
    outer: dict[int, set[int]] = {}
    for f in fps:
        outer.setdefault(f & (FULL ^ inside), set()).add(f & inside)
    bits = [1 << (first + b) for b in range(width)]
    for (p, own), (q, other) in [*((x, x) for x in outer.items()), *combinations(outer.items(), 2)]:
        free = RADIUS - (p ^ q).bit_count()
        masks = [sum(c) for n in range(free + 1) for c in combinations(bits, n)]
        small, large, s, t = (own, other, p, q) if len(own) <= len(other) else (other, own, q, p)
        for a in small:
            for m in masks:
                if (a ^ m) in large and (s | a) != (t | (a ^ m)):
                    link(s | a, t | (a ^ m))
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_in(groups, block_of) -> tuple[list[int], list[int]]:
    """Verified links among the fingerprints of each group, smaller end first."""
    low, high = [], []
    for key, fps in groups:
        for u, v in _forest(sorted(int(f) & FULL for f in fps), block_of(key)):
            u, v = sorted((_signed(u), _signed(v)))
            low.append(u)
            high.append(v)
    return low, high


def _verify(batches, most: int):
    """Links of sorted rows (block, variant, fp). Groups of over ``most`` fingerprints are handed on as they
    come, row by row, as (fp, null, block)."""
    key, held, large = None, [], False
    for b in batches:
        block, variant, fp = (b.column(c).to_numpy() for c in ("block", "variant", "fp"))
        if not len(fp):
            continue
        starts = np.flatnonzero(np.r_[True, (variant[1:] != variant[:-1]) | (block[1:] != block[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        # what lies alone between others has nothing to link with
        seen = (ends - starts > 1) | (starts == 0) | (ends == len(fp))
        low, high, of, whole = [], [], [], []
        for i, j in zip(starts[seen].tolist(), ends[seen].tolist()):
            if i == 0 and (int(block[0]), int(variant[0])) == key:
                part = fp[i:j]
            else:
                if held and not large and sum(map(len, held)) > 1:
                    whole.append((key, np.concatenate(held)))
                if j < len(fp) and j - i == 1:
                    key, held, large = None, [], False
                    continue
                key, held, large, part = (int(block[i]), int(variant[i])), [], False, fp[i:j]
            held.append(part)
            if large or sum(map(len, held)) > most:
                large = True
                out = np.concatenate(held)
                held = []
                low += out.tolist()
                high += [None] * len(out)
                of += [key[0]] * len(out)
        u, v = _links_in(whole, lambda k: k[0])
        yield pa.RecordBatch.from_arrays([pa.array(low + u, pa.int64()), pa.array(high + v, pa.int64()), pa.array(of + [None] * len(u), pa.int32())], ["u", "v", "block"])
    if held and not large and sum(map(len, held)) > 1:
        u, v = _links_in([(key, np.concatenate(held))], lambda k: k[0])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([None] * len(u), pa.int32())], ["u", "v", "block"])
    give_back()


def narrower(large: DataFrame) -> DataFrame:
    """(block, variant, fp) for fingerprints of groups too large for a task: whole 64-bit variants, with two
    flips inside the left-out block, or with one inside and one outside of it. Two that link differ in two
    bits outside at most and meet in one of these (none or one flip outside on either side), and no more than a
    fixed number of fingerprints, the ball around a variant, can meet in one."""
    out = None
    for k, (first, width) in enumerate(BLOCKS):
        inside = [1 << b for b in range(first, first + width)]
        outside = [1 << b for b in range(64) if not first <= b < first + width]
        two, one = ([_signed(sum(c)) for n in range(m) for c in combinations(inside, n)] for m in (3, 2))
        pick = F.when(F.col("o") == 0, F.array(*map(F.lit, two))).otherwise(F.array(*map(F.lit, one)))
        part = large.where(F.col("block") == k).select("block", "fp").distinct()
        part = part.select("block", "fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(o)) for o in outside])).alias("o"))
        part = part.select("block", "fp", "o", F.explode(pick).alias("f"))
        part = part.select("block", F.col("fp").bitwiseXOR(F.col("o")).bitwiseXOR(F.col("f")).alias("variant"), "fp")
        out = part if out is None else out.unionByName(part)
    return out


def links(distinct: DataFrame, most: int = MOST_MET) -> DataFrame:
    """(u, v) with u < v: verified links whose components are those of all links."""
    # A row grows to 132, so the narrow table is spread first.
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() // EMITTED)

    def met(rows: DataFrame, bound: int) -> DataFrame:
        rows = rows.select("block", "variant", "fp").repartition("block", "variant").sortWithinPartitions("block", "variant")
        return rows.mapInArrow(lambda batches: _verify(batches, bound), "u bigint, v bigint, block int")

    found = stored(met(variants(distinct.repartition(n, "fp")), most), "links-found")
    large = found.where("v IS NULL").select("block", F.col("u").alias("fp"))
    out = found.where("v IS NOT NULL").select("u", "v")
    if not large.isEmpty():
        out = out.unionByName(met(narrower(large), FULL).select("u", "v"))
    return out.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, name): the smallest node of every component of a graph given as links (u, v), by
    large-star and small-star rounds; each round is a stored table."""
    edges = stored(edges, "links")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub has as many links as its component has nodes
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = salted_join(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        edges = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "stars",
        )
        s = scalar_row(edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")))
        if (s.n, s.h) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("name"))
        state = (s.n, s.h)


def components(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    made = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    named = connected(links(distinct.select("fp")))
    joined = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("name", F.coalesce("name", "fp"))
    parts = joined.groupBy("name").agg(F.min("least").alias("component_id"))
    known = joined.join(parts, "name").select("fp", "n", "component_id")
    # Fingerprints of over a thousandth of the rows (at most 1,000) are looked up by broadcast.
    known = stored(known, "components")
    total = scalar_row(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).n
    hot = F.col("n") * 1000 > total
    tagged = made.join(F.broadcast(known.where(hot).select("fp", F.struct("component_id").alias("hot"))), "fp", "left")
    rest = tagged.where("hot IS NULL").drop("hot").join(known.where(~hot).select("fp", "component_id"), "fp")
    whole = tagged.where("hot IS NOT NULL").select("doc_id", "fp", "hot.component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay, with all their columns: one row of every component, that with the smallest
    id, null last, and among rows of one id that with the smallest SHA-256 of its text. Rows of one id and
    text are one fingerprint, so id and digest lead from a component back to one row and to no other's."""
    rows = narrow(docs, id_col, text_col)
    made = fingerprints(rows.select(F.struct("doc_id", digest(F.col("text")).alias("digest")).alias("key"), "text"), "key")
    made = made.select("fp", F.struct(F.col("doc_id.doc_id").isNull().alias("none"), "doc_id.doc_id", "doc_id.digest").alias("own"))
    distinct = stored(made.groupBy("fp").agg(F.min("own").alias("own")), "distinct")
    named = connected(links(distinct.select("fp")))
    joined = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("name", F.coalesce("name", "fp"))
    kept = joined.groupBy("name").agg(F.min("own").alias("own"))
    kept = kept.select(F.col("own.doc_id").alias("_kept"), F.col("own.digest").alias("_kept_digest"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), digest(docs[text_col].cast("string")).alias("_digest"))
    found = whole.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    return found.dropDuplicates(["_id", "_digest"]).select("_row.*")
