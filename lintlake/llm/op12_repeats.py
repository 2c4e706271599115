"""Repeated passages: bytes covered by a string of ``WINDOW`` bytes that starts anywhere else too.

Texts are distinct by digest first: a text that occurs twice is covered from end to end if it holds one
window at all, and one copy of it stands for all in what follows.

1. Every window has a key: the least hash of its ``GRAM``-byte strings. Equal windows have equal keys.
   Windows that follow each other with one key are a piece, about one for 75 bytes.
2. Keys that occur once anywhere are done. Of a key's pieces only distinct ones go on (copies of a piece
   are counted, not moved): a piece that occurs twice is covered, a key whose pieces are all alike is done.
3. What is left (pieces alike in part, mostly the ends of passages) meets by key in tasks. A task joins its
   pieces into one text, sorts its suffixes to the length of a window, and takes the Burrows-Wheeler
   transform. Common prefixes of neighbouring suffixes then follow by increasing value: intervals of
   strings of length l are extended backward, breadth first, and the end of an extended interval whose
   value is not known yet has l. Intervals without news are not followed, and the expansion stops at the
   window's length. Neighbours without a value by then share a whole window.
4. The pieces of a key that outgrow a task are dealt to several. Each names the windows that it holds by
   digest, once for each class of equal windows, and the counts of all tasks are put together.

Texts lie in a table bucketed by their key, so that bytes are fetched, and removed, without moving texts
again. Pieces leave as spans, spans are merged for each text, and the rest of the text is hashed.

Defined results: null text is empty; texts shorter than a window lose nothing; rows that repeat each other
are copies like any other; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import narrow, scalar_row, stored
from lintlake.session import shared_dir

WINDOW, GRAM = 200, 48
#: Bytes hashed at a time; bytes of pieces whose suffixes a task sorts at a time; and the most of one key.
HASHED, SORTED, MOST_OF_KEY = 1 << 20, 1 << 20, 4 << 20
#: A key is salted if it has more than 1/HOT_SHARE of the rows.
HOT_SHARE = 1_000
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
KEY = ["k1", "k2"]


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, joined, and the offsets of its rows."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    return made[0], made[1]


def gram_hashes(t: np.ndarray, gram: int, powers) -> np.ndarray:
    """A hash of each ``gram`` bytes, by sums of powers that wrap at 64 bits."""
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers[0][: len(t)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers[1][: len(t) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks both ways."""
    n = len(h)
    blocks = np.concatenate([h, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pieces_of(t: np.ndarray, offsets: np.ndarray, window: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """Pieces of joined texts: (text's number, start in it, windows, key, how often the key's string occurs)."""
    n, width = len(t), window - gram + 1
    if n < window:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = gram_hashes(t, gram, powers)
    least = sliding_least(h, width)
    last = len(least)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:last] == owner[window - 1 :]
    cut = np.ones(last, bool)
    cut[1:] = (least[1:] != least[:-1]) | (owner[1:last] != owner[: last - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.r_[first, last])
    first, count = first[whole[first]], count[whole[first]]
    end = first + count - 1
    starts_at = np.r_[0, np.cumsum(h[:last] == least)]
    times = starts_at[end] - starts_at[first]
    for i in range(0, len(first), 8192):
        rows = end[i : i + 8192]
        times[i : i + 8192] += (h[rows[:, None] + np.arange(width)] == least[rows][:, None]).sum(axis=1)
    return owner[first], first - offsets[owner[first]], count, least[first].view(np.int64), times


def parts(t: np.ndarray, offsets: np.ndarray, most: int, window: int):
    """(first row, start in it, bytes, offsets) of a batch, in parts of about ``most`` bytes: whole texts, or
    stretches of one long text that share all but one byte of a window."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        size = int(offsets[to] - offsets[row])
        if to == row + 1 and size > most:
            for at in range(0, size - window + 1, most):
                part = t[offsets[row] + at : offsets[row] + min(size, at + most + window - 1)]
                yield row, at, part, np.array([0, len(part)])
        else:
            yield row, 0, t[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def pieces(texts: DataFrame, window=WINDOW, gram=GRAM) -> DataFrame:
    """(k1, k2, start, windows, key, times, digest): the pieces of every text (k1, k2, text)."""

    def run(batches):
        powers = _powers(HASHED + window)
        for b in batches:
            t, offsets = binary(b.column("text"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for row, at, part, cuts in parts(t, offsets, HASHED, window):
                number, start, count, key, times = pieces_of(part, cuts, window, gram, powers)
                view = memoryview(part)
                from_ = start + cuts[number]
                spans = map(slice, from_.tolist(), (from_ + count + window - 1).tolist())
                digest = np.fromiter(map(xxhash.xxh3_64_intdigest, map(view.__getitem__, spans)), np.uint64, len(start))
                number = number + row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k1[number], k2[number], start + at, count, key, times, digest.view(np.int64))],
                    ["k1", "k2", "start", "windows", "key", "times", "digest"],
                )

    rows = texts.select(*KEY, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "k1 bigint, k2 bigint, start bigint, windows bigint, key bigint, times bigint, digest bigint")


def salted(rows: DataFrame, known: DataFrame, keys: list[str], n: str, by: list[str]) -> DataFrame:
    """Inner join with ``known``, unique by ``keys``, whose column ``n`` says how many rows a key has. Rows of
    keys with over a thousandth of all rows are dealt to as many salts as thousandths, and what is known of
    them is repeated for each (at most 2,000 rows more)."""
    total = scalar_row(known.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))).n
    salts = F.ceil(F.col(n) * HOT_SHARE / F.lit(max(total, 1))).cast("int")
    hot = known.where(F.col(n) * HOT_SHARE > total).select(*[F.col(k).alias(f"_{k}") for k in keys], salts.alias("_salts"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) if same is None else same & (F.col(k) == F.col(f"_{k}"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", salt).drop("_salts", *[f"_{k}" for k in keys])
    each = F.when(F.col(n) * HOT_SHARE > total, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return left.join(known.withColumn("_salt", F.explode(each)), [*keys, "_salt"]).drop("_salt")


def suffix_order(s: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``s[:n]`` in the order of their next ``depth`` symbols or more, and their first seven
    symbols, packed, in that order. Lengths double; only what is still tied is sorted again."""
    packed = np.zeros(n, np.int64)
    for j in range(7):
        packed = (packed << 9) | s[j : n + j]
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    first = np.r_[True, packed[1:] != packed[:-1]]
    rank = np.zeros(n + 2 * depth + 8, np.int64)  # what lies behind the end ranks lowest
    known = 7
    while known < depth:
        group = np.cumsum(first)
        rank[order] = group
        tied = ~first
        tied[:-1] |= ~first[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        members = order[tied]
        both = group[tied] * (n + 2) + rank[members + known]
        again = np.argsort(both, kind="stable")
        both = both[again]
        order[tied] = members[again]
        first[tied[1:]] |= both[1:] != both[:-1]
        known *= 2
    return order, packed


def common_prefixes(s: np.ndarray, n: int, order: np.ndarray, packed: np.ndarray, window: int) -> np.ndarray:
    """``same[i]``: suffixes i and i + 1 of the order share ``window`` symbols, for suffixes that have no
    separator (symbol 0) among them; found by expanding intervals of the Burrows-Wheeler transform."""
    unknown = 255 if window < 255 else 65_535
    value = np.full(n + 1, unknown, np.uint8 if window < 255 else np.uint16)
    value[[0, n]] = 0
    for j in range(7):  # the first seven symbols are at hand: values 0 to 6
        part = packed >> (9 * (6 - j))
        value[1:n][(part[1:] != part[:-1]) & (value[1:n] == unknown)] = j
    transform = s[order - 1]  # position 0 follows the last separator
    step = np.empty(n, np.int64)
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    low = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    high = np.r_[low[1:], n]
    plain = np.ones(len(low), bool)
    for j in range(7):
        plain &= (packed[low] >> (9 * j)) & 511 > 0
    follow = plain & (value[high] == 6)
    low, high = low[follow], high[follow]
    for length in range(7, window):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        symbol = transform[at]
        some = symbol > 0
        at, symbol, owner = at[some], symbol[some], owner[some]
        if not len(at):
            break
        to = step[at]
        if size.max() > 1:
            sort = np.argsort(owner * (n + 1) + to)
            to, symbol, owner = to[sort], symbol[sort], owner[sort]
        cut = np.ones(len(to), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        begin = np.flatnonzero(cut)
        low, high = to[begin], to[np.r_[begin[1:], len(to)] - 1] + 1
        news = value[high] == unknown
        low, high = low[news], high[news]
        value[high] = length
    return value[1:n] == unknown


def repeats(found: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the joined pieces: offset of each, which positions start a whole window, which of these windows
    start elsewhere too, and a number for each class of equal windows."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    offsets = np.r_[0, np.cumsum(lengths + 1)]
    n = int(offsets[-1])
    s = np.zeros(n + 8, np.uint16)
    joined = np.frombuffer(b"\x00".join(found) + b"\x00", np.uint8)
    s[:n] = joined
    s[:n] += 1
    s[offsets[1:] - 1] = 0
    whole = np.ones(n, bool)
    back = np.minimum(lengths + 1, window)
    for k in range(1, window + 1):  # the last starts of each piece are too close to its end
        whole[offsets[1:][back >= k] - k] = False
    order, packed = suffix_order(s, n, window)
    same = common_prefixes(s, n, order, packed, window) & whole[order[1:]] & whole[order[:-1]]
    flag = np.zeros(n, bool)
    flag[:-1] |= same
    flag[1:] |= same
    again, number = np.zeros(n, bool), np.zeros(n, np.int64)
    again[order] = flag
    number[order] = np.cumsum(np.r_[True, ~same])
    return offsets, whole, again, number


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


FOUND = "k1 bigint, k2 bigint, start bigint, windows bigint, d1 bigint, d2 bigint, seen bigint"


def _found_in(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Of the pieces of a task: repeated windows of pieces that occur once, as (k1, k2, start, windows); of
    keys that are dealt to several tasks also a digest (d1, d2) of each class of windows and whether the
    task has ``seen`` it once or more, with its place if once."""
    text = rows.column("piece").to_pylist()
    k1, k2, start, copies, of = (rows.column(c).to_numpy() for c in ("k1", "k2", "start", "copies", "of"))
    offsets, whole, again, number = repeats(text, window)
    owner = np.repeat(np.arange(len(text)), np.diff(offsets))
    low, high = runs(again & whole & (copies == 1)[owner])
    own = owner[low]
    out = [k1[own], k2[own], start[own] + low - offsets[own], high - low, np.zeros((3, len(low)), np.int64)]
    dealt = np.flatnonzero(whole & (of > 1)[owner])
    if len(dealt):
        _, one = np.unique(number[dealt], return_index=True)
        dealt = dealt[one]
        own = owner[dealt]
        at = dealt - offsets[own]
        names = [xxhash.xxh3_128_digest(text[i][j : j + window]) for i, j in zip(own.tolist(), at.tolist())]
        names = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        seen = 1 + (again[dealt] | (copies[own] > 1))
        extra = [k1[own], k2[own], start[own] + at, np.zeros(len(own), np.int64), np.vstack([names.T, seen[None, :]])]
        out = [np.concatenate([a, b], axis=-1) for a, b in zip(out, extra)]
    columns = [*out[:4], *out[4]]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], [f.split()[0] for f in FOUND.split(", ")])


def expanded(mixed: DataFrame, window=WINDOW) -> DataFrame:
    """(k1, k2, start, windows): repeated windows among distinct pieces (key, salt, of, k1, k2, start, copies, piece)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column("piece").nbytes
            if size >= SORTED:  # all keys but the last are whole
                rows = pa.Table.from_batches(held)
                key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
                other = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield _found_in(rows.slice(0, cut), window)
                    held = rows.slice(cut).to_batches()
                    size = sum(x.column("piece").nbytes for x in held)
        if sum(x.num_rows for x in held):
            yield _found_in(pa.Table.from_batches(held), window)

    found = stored(mixed.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, FOUND), "windows-found")
    place = F.when(F.col("seen") == 1, F.struct("k1", "k2", "start"))
    # A task names a class once, so no class has more places than its key has salts.
    classes = found.where("seen > 0").groupBy("d1", "d2").agg(F.sum("seen").alias("seen"), F.collect_list(place).alias("places"))
    late = classes.where("seen > 1").select(F.explode("places").alias("p")).select("p.*", F.lit(1).cast("long").alias("windows"))
    return found.where("seen = 0").select(*KEY, "start", "windows").unionByName(late)


def distinct_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """(k1, k2, text, doc_id, digest, copies): one row for each text, bucketed by its key of 128 bits."""
    spark = rows.sparkSession
    made = rows.groupBy(*KEY).agg(
        F.first("text").alias("text"), F.min("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.count("*").alias("copies")
    )
    name = f"lintlake_texts_{uuid.uuid4().hex}"
    made.write.format("parquet").option("path", shared_dir(spark, "texts")).option("compression", "zstd").bucketBy(buckets, *KEY).saveAsTable(name)
    return spark.table(name)


def covered(texts: DataFrame, window=WINDOW, gram=GRAM) -> DataFrame:
    """(k1, k2, start, windows): all windows of distinct texts that start elsewhere too."""
    every = pieces(texts.where(F.octet_length("text") >= window), window, gram)
    keys = stored(every.groupBy("key").agg(F.sum("times").alias("times"), F.count("*").alias("n")).where("times > 1"), "keys")
    shared = stored(salted(every, keys.select("key", "n"), ["key"], "n", ["k1", "k2", "start"]).drop("n"), "pieces")
    classes = stored(
        shared.groupBy("key", "digest").agg(
            F.count("*").alias("copies"), F.max("times").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("at"), F.first("windows").alias("windows")
        ),
        "classes",
    )
    whole = salted(shared, classes.where("copies > 1").select("key", "digest", "copies"), ["key", "digest"], "copies", ["k1", "k2", "start"])
    sizes = classes.groupBy("key").agg(
        F.count("*").alias("classes"), F.sum(F.col("windows") + window - 1).alias("bytes"), F.max(F.when(F.col("copies") == 1, F.col("times"))).alias("inner")
    )
    sizes = stored(sizes.where("classes > 1 OR inner > 1"), "sizes")
    of = F.ceil(F.col("bytes") / MOST_OF_KEY).cast("int")
    mixed = salted(classes, sizes.select("key", "classes", of.alias("of")), ["key"], "classes", ["digest"])
    mixed = mixed.select("key", F.pmod(F.xxhash64("digest"), F.col("of")).cast("int").alias("salt"), "of", "copies", "windows", "at.*")
    wanted = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("key", "salt", "of", "copies", "start", "windows")).alias("wanted"))
    fetched = texts.select(*KEY, F.col("text").cast("binary").alias("_b")).join(wanted, KEY).select(
        *KEY, F.explode(F.transform("wanted", lambda w: F.struct(
            w["key"].alias("key"), w["salt"].alias("salt"), w["of"].alias("of"), w["copies"].alias("copies"), w["start"].alias("start"),
            F.substring(F.col("_b"), (w["start"] + 1).cast("int"), (w["windows"] + window - 1).cast("int")).alias("piece"),
        ))).alias("w"),
    )
    return whole.select(*KEY, "start", "windows").unionByName(expanded(fetched.select(*KEY, "w.*"), window))


def _rest(text: bytes, spans: list[dict], window: int) -> tuple[int, int, str]:
    """(removed, runs, SHA-256 of what is left) of a text, given its repeated windows."""
    at = np.array([(s["start"], s["start"] + s["windows"] + window - 1) for s in spans], np.int64).reshape(-1, 2)
    at = at[np.argsort(at[:, 0], kind="stable")]
    reach = np.maximum.accumulate(at[:, 1])
    first = np.flatnonzero(np.r_[True, at[1:, 0] > reach[:-1]])
    low, high = at[first, 0], reach[np.r_[first[1:] - 1, len(at) - 1]]
    rest, last = hashlib.sha256(), 0
    for a, b in zip(low.tolist(), high.tolist()):
        rest.update(text[last:a])
        last = b
    rest.update(text[last:])
    return int((high - low).sum()), len(first), rest.hexdigest()


def removed(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumns({"k1": F.xxhash64("digest"), "k2": F.xxhash64(F.lit(window), "digest")})
    texts = distinct_texts(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spans = covered(texts, window, gram).groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    once = texts.where("copies = 1").join(spans, KEY, "left")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            texts_, spans_, digests = b.column("text"), b.column("spans"), b.column("digest").to_pylist()
            out = [
                (0, 0, digest) if found is None else _rest(text.as_py(), found, window)
                for text, found, digest in zip(texts_, spans_.to_pylist(), digests)
            ]
            sizes = np.diff(binary(texts_)[1])
            made = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    single = once.select("doc_id", F.col("text").cast("binary").alias("text"), "spans", "digest").mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    # Copies: nothing is left of a text that holds a window.
    copies = texts.where("copies > 1").select(*KEY, "copies")
    size = F.octet_length("text").cast("long")
    whole = F.col("n_bytes") >= window
    narrow_rows = rows.select("doc_id", *KEY, size.alias("n_bytes"), "digest", F.monotonically_increasing_id().alias("_spread"))
    again = salted(narrow_rows, copies, KEY, "copies", ["_spread"])
    empty = hashlib.sha256().hexdigest()
    again = again.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return single.unionByName(again)
