"""Spelling variants: words of a vocabulary that differ by one edit, found in a trie of letter counts.

A word's frequency vector counts its letters by group (``GROUPS``, any other letter is the last group).
Words are leaves of a trie whose levels are the successive counts. One inserted letter adds one to one
count, one deleted letter takes one from one count, one replaced letter does both or neither, so the
words near a word lie on the paths that stray from its own by a surplus of one and a deficit of one at
most. A search walks the trie depth first with that budget; what it finds at a leaf is verified.

Links are symmetric, so each is looked for once: from the word whose vector is smaller at the first
level in which the two differ. A search therefore spends its surplus before its deficit.

The trie is shared out by its upper levels. A word is sent to its own node of the first ``BLOCKS[0]``
levels and to every other node of that depth that its budget reaches. Nodes that get more than
``MOST_ROWS`` rows are opened: their rows go on to the nodes of the next levels with what is left of
their budget, and so on; words that agree in every count and are still too many are dealt to a grid of
pieces, each pair of words meeting in one. Inside a task a node's words are searched for all its
queries at once: a step takes one trie node and the queries that reach it.

Defined results: null and empty texts have no words; a missing id counts as the empty text in the hash;
rows that repeat an id and text count again; ties of the form go to the smaller word in code-point
order; an empty table gives no rows; other columns are ignored; a run of any length is one word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import narrow, scalar_row, stored

#: Letters of each level of the trie; letters that are in none are counted in a last level.
GROUPS = ("e", "n", "a", "t", "i", "o", "r", "hs", "lu", "cdm", "fgbp", "wkvyxjqz")
LEVELS = len(GROUPS) + 1
#: Levels that a node is opened by, one number a round.
BLOCKS = (4, 3, 3, 3)
#: Rows of a node beyond which it is opened; pairs that a step verifies instead of going further down;
#: letters beyond which words are compared one by one; entries of a task's counter.
MOST_ROWS, FEW_PAIRS, WIDE, COUNTED = 12_000, 2_048, 32, 400_000
#: Words that one task sends out, and rows of nodes that a task gathers before it searches them.
SENT, GATHERED = 50_000, 60_000
#: Shortest word, least occurrences, a hash multiple that loses a letter, how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, LOSES, TIMES = 7, 2, 31, 10

HOME, SURPLUS, BOTH = 0, 1, 2


def runs_of(doc_id: str, text: str, found: re.Pattern, loses: int, least: int, counts: Counter) -> None:
    """Count the words of one text: its runs of letters, of which some lose a letter by their hash."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(found.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if not h % loses:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        counts[run] += n


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", loses=LOSES, least=LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each word occurs in all texts."""
    rows = narrow(docs, id_col, text_col)
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def count(batches):
        found = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
        counts: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                runs_of(doc_id, text.as_py(), found, loses, least, counts)
                if len(counts) >= COUNTED:
                    yield out()
        yield out()

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vector(word: Column) -> Column:
    """The counts of a word by level."""
    known = F.length(F.translate(word, "".join(GROUPS), ""))
    own = [(F.length(word) - F.length(F.translate(word, g, ""))).cast("int") for g in GROUPS]
    return F.array(*own, known.cast("int"))


def opened(rows: DataFrame, first: int, levels: int) -> DataFrame:
    """Rows (node, state, word, n, vec) at the nodes of ``levels`` more levels that their budget reaches."""

    def paths(state):
        yield (), state
        if state == HOME:
            for i in range(levels):
                yield ((i, 1),), SURPLUS
                for j in range(i + 1, levels):
                    yield ((i, 1), (j, -1)), BOTH
        elif state == SURPLUS:
            for j in range(levels):
                yield ((j, -1),), BOTH

    def node(steps):
        counts = [F.col("vec")[first + i] + dict(steps).get(i, 0) for i in range(levels)]
        return F.concat_ws(",", F.col("node"), *counts)

    def reached(state):
        made = []
        for steps, left in paths(state):
            to = F.struct(node(steps).alias("node"), F.lit(left).alias("state"))
            lacks = [F.col("vec")[first + i] == 0 for i, by in steps if by < 0]
            made.append(F.when(~lacks[0], to) if lacks else to)
        return F.array(*made)

    reach = F.when(F.col("state") == HOME, reached(HOME)).when(F.col("state") == SURPLUS, reached(SURPLUS)).otherwise(reached(BOTH))
    out = rows.select(F.explode(reach).alias("to"), "word", "n", "vec").where("to IS NOT NULL")
    return out.select("to.node", "to.state", "word", "n", "vec")


def _dealt(rows: DataFrame, large: DataFrame, most_rows: int) -> DataFrame:
    """Rows of nodes that agree in every count, dealt to a grid: words by line, searches by column. A row
    that is word and search stays both where its line and column cross."""
    found = rows.join(F.broadcast(large), "node").withColumn("of", F.ceil(F.col("rows") / most_rows).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("of")).cast("int")
    every = F.sequence(F.lit(0), F.col("of") - 1)
    searches = found.withColumn("line", F.explode(every)).withColumn("column", own).withColumn("is_word", F.lit(False))
    words = found.where(F.col("state") == HOME).withColumn("column", F.explode(every)).withColumn("line", own).withColumn("is_word", F.lit(True))
    out = searches.unionByName(words)
    return out.select(F.concat_ws("/", "node", "line", "column").alias("node"), "word", "n", (F.col("is_word")).alias("is_word"), (~F.col("is_word")).alias("is_search"))


def spread(words: DataFrame, blocks=BLOCKS, most_rows=MOST_ROWS) -> DataFrame:
    """(node, word, n, is_word, is_search): the words and searches of each node."""
    # A word grows to a dozen rows, so the narrow table is spread first.
    n = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // SENT)
    rows = words.repartition(n, "word").select(F.lit("").alias("node"), F.lit(HOME).alias("state"), "word", "n", vector(F.col("word")).alias("vec"))
    ready = []
    first = 0
    total = None
    for i, levels in enumerate(blocks):
        rows = stored(opened(rows, first, levels), "trie")
        first += levels
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("rows")), "nodes")
        total = total or scalar_row(sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))).n
        # At most 20,000 nodes are over this size, so their names can be broadcast.
        size = max(most_rows, total // 20_000)
        large = sizes.where(F.col("rows") > size)
        done = rows.join(F.broadcast(large.select("node")), "node", "left_anti")
        ready.append(done.select("node", "word", "n", (F.col("state") == HOME).alias("is_word"), F.lit(True).alias("is_search")))
        if large.isEmpty():
            break
        if i + 1 < len(blocks):
            rows = rows.join(F.broadcast(large.select("node")), "node", "left_semi").select("node", "state", "word", "n", "vec")
        else:
            ready.append(_dealt(rows, large, size))
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out


class Letters:
    """Words of one task as fixed-width arrays: counts by level, letters from the left and from the right."""

    def __init__(self, words: list[str]):
        coded = [w.encode("latin-1") for w in words]
        self.words = coded
        self.length = np.fromiter(map(len, coded), np.int64, len(coded))
        self.left = np.array([w[:WIDE] for w in coded], f"S{WIDE}").view(np.uint8).reshape(len(coded), WIDE)
        self.right = np.array([w[: -WIDE - 1 : -1] for w in coded], f"S{WIDE}").view(np.uint8).reshape(len(coded), WIDE)
        self.head, self.tail = (x[:, :3].astype(np.uint32) @ np.array([65_536, 256, 1], np.uint32) for x in (self.left, self.right))
        level = np.full(256, LEVELS - 1, np.uint8)
        for i, letters in enumerate(GROUPS):
            level[list(letters.encode())] = i
        flat = level[np.frombuffer(b"".join(coded), np.uint8)].astype(np.int64)
        owner = np.repeat(np.arange(len(coded)), self.length)
        self.counts = np.bincount(owner * LEVELS + flat, minlength=len(coded) * LEVELS).reshape(-1, LEVELS)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words of each pair differ by exactly one inserted, deleted or replaced letter: what
        they share from the left and from the right leaves at most one letter of the longer."""
        la, lb = self.length[a], self.length[b]
        most = np.maximum(la, lb)
        # of words of seven letters and more, the first three or the last three are the same
        ok = (np.abs(la - lb) <= 1) & ((self.head[a] == self.head[b]) | (self.tail[a] == self.tail[b]) | (most < 7))
        ok = np.flatnonzero(ok)
        a, b, most = a[ok], b[ok], most[ok]
        shared = 0
        for side in (self.left, self.right):
            same = side[a] == side[b]
            shared = shared + np.where(same.all(axis=1), WIDE, same.argmin(axis=1))
        good = shared >= most - 1
        for i in np.flatnonzero(most > WIDE).tolist():
            good[i] = one_edit(self.words[a[i]], self.words[b[i]])
        out = np.zeros(len(la), bool)
        out[ok[good]] = True
        return out

    def earlier(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a is the word that looks for b: the smaller count at the first level that differs, or
        the smaller word."""
        by = self.counts[b] - self.counts[a]
        first = (by != 0).argmax(axis=1)
        sign = by[np.arange(len(a)), first]
        return np.array([s > 0 or s == 0 and self.words[i] < self.words[j] for s, i, j in zip(sign.tolist(), a.tolist(), b.tolist())], bool)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words of any length differ by exactly one edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    low, high = 0, len(short)
    while low < high:  # the longest common start, by halving
        mid = (low + high + 1) // 2
        if short[:mid] == long[:mid]:
            low = mid
        else:
            high = mid - 1
    return short[low + (len(a) == len(b)) :] == long[low + 1 :]


def search(counts: np.ndarray, words: np.ndarray, queries: np.ndarray, few=FEW_PAIRS):
    """Depth-first search of the trie of some words for all queries: arrays (query, word) of what is left
    to verify. A query enters a child of its own count, of one more for its surplus, or of one less for its
    deficit."""
    stack = [(words, queries, np.full(len(queries), HOME), 0)]
    while stack:
        w, q, s, level = stack.pop()
        if not len(w) or not len(q):
            continue
        if level == LEVELS or len(w) * len(q) <= few:
            for at in range(0, len(q), max(1, few // len(w) * 64)):
                part = q[at : at + max(1, few // len(w) * 64)]
                yield np.repeat(part, len(w)), np.tile(w, len(part))
            continue
        mine, theirs = counts[w, level], counts[q, level]
        more, less = s == HOME, s == SURPLUS
        for c in np.unique(mine).tolist():
            same, up, down = theirs == c, (theirs == c - 1) & more, (theirs == c + 1) & less
            go = same | up | down
            after = np.where(up, SURPLUS, np.where(down, BOTH, s))
            stack.append((w[mine == c], q[go], after[go], level + 1))


def links_of(table: pa.Table, node: np.ndarray) -> pa.RecordBatch:
    """Links (word, near, near's n), both ways, of whole nodes; ``node``: a number for each row's node."""
    coded = table.column("word").combine_chunks().dictionary_encode()
    names, at = coded.dictionary, coded.indices.to_numpy()
    letters = Letters(names.to_pylist())
    n_of = np.zeros(len(names), np.int64)
    n_of[at] = table.column("n").to_numpy()
    is_word, is_search = (table.column(c).to_numpy() for c in ("is_word", "is_search"))
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    held, size = [], 0
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def verify():
        q, w = (np.concatenate(x) for x in zip(*held))
        good = letters.near(q, w)
        q, w = q[good], w[good]
        good = letters.earlier(q, w)
        out.append((q[good], w[good]))
        held.clear()

    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
        own = at[i:j]
        for q, w in search(letters.counts, own[is_word[i:j]], own[is_search[i:j]]):
            held.append((q, w))
            size += len(q)
            if size > 200_000:
                verify()
                size = 0
    if held:
        verify()
    q, w = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int),) * 2
    a, b = np.r_[q, w], np.r_[w, q]
    return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n_of[b])], ["word", "near", "near_n"])


def links(words: DataFrame, blocks=BLOCKS, most_rows=MOST_ROWS) -> DataFrame:
    """(word, near, near_n): every pair of words that differ by one edit, both ways."""
    rows = spread(words, blocks, most_rows)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= GATHERED:  # all nodes but the last are whole
                table = pa.Table.from_batches(held)
                node = table.column("node").combine_chunks().dictionary_encode().indices.to_numpy()
                cut = int(np.searchsorted(node, node[-1]))
                if cut:
                    yield links_of(table.slice(0, cut), node[:cut])
                    held = table.slice(cut).to_batches()
                    size -= cut
        if size:
            table = pa.Table.from_batches(held)
            yield links_of(table, table.column("node").combine_chunks().dictionary_encode().indices.to_numpy())

    dealt = rows.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last, a doubled distance a round. A form is
    ``TIMES`` as frequent as its word, so the way is short; a word of a given length is the form of a
    bounded number of words, so no key is hot."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("_on"), F.col("root").alias("_next"))
        found = stored(at.join(ahead, F.col("root") == F.col("_on"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        at = found.select("word", "root")
        if found.where("moved").isEmpty():
            return at


def variants(
    docs: DataFrame, id_col="doc_id", text_col="text", loses=LOSES, least=LEAST_LENGTH, least_count=LEAST_COUNT, times=TIMES,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stored(vocabulary(docs, id_col, text_col, loses, least).where(F.col("n") >= least_count), "words")
    # min_by of (-n, word): the most frequent near word, the smaller of equally frequent ones
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = links(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).withColumnRenamed("word", "_word")
    given = -F.col("best.n") >= F.col("n") * times
    found = stored(
        words.join(near, F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(given, F.col("best.word")).alias("form"), F.when(given, -F.col("best.n")).alias("form_n"),
        ),
        "variants",
    )
    last = roots(found.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "_word")
    return found.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
