"""Language-model scoring with a hashed maximum-entropy model.

The softmax over words is factored by a tree of classes: a token's probability is the product of the choices
on the way from the root to its word, and every choice among the up to ``FAN`` children of a node is a
softmax that is log-linear in hashed features of the context: the previous word, the pair of previous words,
and, at the root and its children, two skips (the word before the last, and the one before that), each joined
with the node. So the context
tells classes apart near the root and words of one class further down. The tree is built from the corpus:
children of a node weigh about the same, frequent words lie near the root, and words that live in one kind of
document (a document's kind is its most frequent token) lie together. Words too rare for the bounded
vocabulary fall into one leaf per kind, chosen by a table over word endings; in such a leaf a word has its
share of the counts, and absolute discounting leaves a share for words never seen.

Training: the training documents are dealt to ``ROUNDS`` rounds; in a round every task runs AdaGrad over
its own documents from the current weights, and the changes of every feature's weights are averaged by how
often each task met the feature (one row per feature and task, only those that it met, summed by Spark). The
weights have a fixed size, so they and the vocabulary are broadcast.

Scoring: one pass makes hashed sparse batches and sums the choices of every token. Counts of words outside the
bounded vocabulary stay in a table that grows with the corpus: what a document has of them is joined with
it, so base scores are exact.

Defined results: null text is empty, and an empty text is the end alone; repeated rows give repeated
results; without training documents every base score is 0 and the model gives what its prior gives; a null
id is never held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import cut, give_back, narrow, remainder, scalar_row, stored

FOLDS, HELD_OUT = 5, 1
#: Bounded vocabulary, fewest occurrences in it, children of a node.
WORDS, LEAST, FAN = 1 << 17, 3, 16
#: Kinds of documents: hashed, and kept.
HASHED_KINDS, KINDS = 32, 8
ENDINGS = 4096
#: Rows of a hashed table, rounds, tokens of a gradient step, step size, discount.
ROWS, ROUNDS, STEP_TOKENS, RATE, DISCOUNT = 1 << 15, 3, 32_768, 0.8, 0.75
#: Templates at the root, at its children, and further down; each has a table of its own at each of the three.
TEMPLATES = (4, 4, 2)
TABLES = tuple(slice(sum(TEMPLATES[:k]), sum(TEMPLATES[: k + 1])) for k in range(3))
#: Tokens that a task trains on at least, where there are as many: its changes are a table of fixed size.
TASK_TOKENS = 1 << 21
#: Bytes of text that are counted, and read, at a time, tokens that are scored at a time and those of a batch, bound of a logit.
COUNTED_BYTES, READ_BYTES, SCORED_TOKENS, BATCH_TOKENS, LARGEST = 8 << 20, 2 << 20, 16_384, 8_192, 60.0
#: Choices of a feature row that are summed together with those of other rows.
SHORT = 8
END = "\n"


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the words of all texts as numbers of distinct ones, and how many
    words each text has. Splits and lowers as ``tokens`` does."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(distinct, "").as_py()
    if blank >= 0:  # white space at an end of a text
        some = at != blank
        owner = np.repeat(np.arange(len(sizes)), sizes)[some]
        at, sizes = at[some], np.bincount(owner, minlength=len(sizes))
    return distinct, at, sizes


def counted(train: DataFrame) -> DataFrame:
    """(word, kind, n) in parts: counts of all training tokens by the kind of their document."""

    def count(texts):
        distinct, at, sizes = split(texts)
        named = distinct.cast(pa.string())
        sorted_ = pc.array_sort_indices(named).to_numpy().astype(np.int64)  # by their bytes
        place = np.empty(len(named), np.int64)
        place[sorted_] = np.arange(len(named))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pairs, n = np.unique(owner * max(len(named), 1) + place[at], return_counts=True)
        of, rank = np.divmod(pairs, max(len(named), 1))
        # the most frequent word of each text, the larger of equally frequent ones
        best = np.zeros(len(sizes), np.int64)
        np.maximum.at(best, of, n * len(named) + rank)
        kind = np.full(len(sizes), zlib.crc32(b"") % HASHED_KINDS)
        top, which = np.unique(best[sizes > 0] % max(len(named), 1), return_inverse=True)
        hashed = [zlib.crc32(w.encode()) % HASHED_KINDS for w in named.take(pa.array(sorted_[top])).to_pylist()]
        kind[sizes > 0] = np.array(hashed, np.int64)[which]
        both, sums = np.unique(kind[of] * max(len(named), 1) + rank, return_inverse=True)
        sums = np.bincount(sums, n, len(both)).astype(np.int64)
        kinds, rank = np.divmod(both, max(len(named), 1))
        words = named.take(pa.array(sorted_[rank]))
        ends = np.bincount(kind, minlength=HASHED_KINDS)
        some = np.flatnonzero(ends)
        words = pa.concat_arrays([words, pa.array([END] * len(some), pa.string())])
        return pa.RecordBatch.from_arrays(
            [words, pa.array(np.r_[kinds, some].astype(np.int32)), pa.array(np.r_[sums, ends[some]])], ["word", "kind", "n"]
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0))
            size += held[-1].nbytes
            if size >= COUNTED_BYTES:
                yield count(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield count(pa.concat_arrays(held))
        del held
        give_back()

    return train.select("text").mapInArrow(run, "word string, kind int, n bigint")


class Tree:
    """A tree whose leaves are words: the way to each, and prior choices.

    Items of one group are joined, the ``FAN`` lightest first, until each that is left of the group weighs as
    much as a child of the root may; then the rest of all groups is joined in the same way. So the
    weighted depth is near the least there is, and words of a group share their lower nodes."""

    def __init__(self, groups: np.ndarray, weights: np.ndarray):
        n = len(weights)
        parent: dict[int, tuple[int, int]] = {}
        mass: list[float] = weights.tolist()
        bias: list[np.ndarray] = []

        def join(heap: list[tuple[float, int]], enough: float) -> list[tuple[float, int]]:
            heapify(heap)
            take = (len(heap) - 2) % (FAN - 1) + 2  # then the last node is full
            while len(heap) > 1 and (take < FAN or heap[0][0] < enough):
                own = [heappop(heap) for _ in range(min(take, len(heap)))]
                node = n + len(bias)
                sizes = np.array([m for m, _ in own])
                row = np.full(FAN, -1e9, np.float32)
                row[: len(own)] = np.log(sizes / sizes.sum())
                bias.append(row)
                mass.append(float(sizes.sum()))
                for child, (_, item) in enumerate(own):
                    parent[item] = (node, child)
                heappush(heap, (mass[node], node))
                take = FAN
            return heap

        enough = weights.sum() / FAN
        rest = []
        for g in np.unique(groups).tolist():
            rest += join([(mass[i], i) for i in np.flatnonzero(groups == g).tolist()], enough)
        join(rest, np.inf)
        if not bias:
            bias.append(np.where(np.arange(FAN) == 0, 0, -1e9).astype(np.float32))
            parent[0] = (n, 0)
        self.bias = np.stack(bias)
        nodes, children, depth = [], [], np.zeros(n, np.int64)
        for leaf in range(n):
            way, at = [], leaf
            while at in parent:
                at, child = parent[at]
                way.append((at - n, child))
            depth[leaf] = len(way)
            nodes += [x for x, _ in reversed(way)]
            children += [c for _, c in reversed(way)]
        self.depth, self.start = depth, np.cumsum(depth) - depth
        self.nodes, self.children = np.array(nodes, np.int64), np.array(children, np.int64)


class Vocabulary:
    """The frequent words, the rule for all others, and the tree over both: a leaf for each word and for
    each rare kind."""

    def __init__(self, words: list[str], counts: np.ndarray, kinds: np.ndarray):
        """Words by falling count; ``kinds``: the hashed kind that each occurs in most."""
        self.words = [w.encode() for w in words]
        self.counts = counts
        mass = np.bincount(kinds, counts, HASHED_KINDS) if len(words) else np.zeros(HASHED_KINDS)
        place = np.full(HASHED_KINDS, KINDS)
        best = [k for k in np.argsort(-mass, kind="stable")[:KINDS] if mass[k] > 0]
        place[best] = np.arange(len(best))
        self.kind = place[kinds] if len(words) else np.empty(0, int)
        votes = np.zeros((ENDINGS, KINDS + 1))
        for w, k, n in zip(self.words, self.kind, np.sqrt(counts)):
            votes[zlib.crc32(w[-4:]) % ENDINGS, k] += n
        self.kind_of_ending = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), KINDS).astype(int).tolist()

    def grow(self, rare_counts: np.ndarray) -> None:
        """Build the tree; ``rare_counts``: occurrences of the words of each rare kind."""
        weights = np.concatenate([self.counts, rare_counts + 0.5])
        kind = np.concatenate([self.kind, np.arange(KINDS + 1)])
        self.tree = Tree(kind, weights)

    def rare_kind(self, word: bytes) -> int:
        return self.kind_of_ending[zlib.crc32(word[-4:]) % ENDINGS]


PRIME = np.uint64(0x9E3779B97F4A7C15)


def context_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of the context of each token, one per template; ``sizes``: tokens of each text."""
    flat = np.full(len(ids) + 3 * len(sizes), WORDS + KINDS + 1, np.uint64)  # the id before a beginning
    pos = np.arange(len(ids)) + 3 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    flat[pos] = ids
    one, two, three = flat[pos - 1], flat[pos - 2], flat[pos - 3]
    with np.errstate(over="ignore"):
        return np.stack([one, (one << np.uint64(20)) + two, two, three]) * PRIME


def contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of some texts in a row, and the keys of the context of each."""
    flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    return flat, context_keys(flat, np.array([len(i) for i in ids], np.int64))


def groups(sizes: np.ndarray, most: int):
    """Texts in groups of about ``most`` tokens: (first text, last, first token, last)."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        at = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, at + most, "right")))
        yield low, high, int(at), int(ends[high - 1])
        low = high


def feature_rows(keys: np.ndarray) -> np.ndarray:
    """Hashed rows of contexts."""
    return (keys >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.uint16)


def node_rows(mixed: np.ndarray, token: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Hashed rows of the contexts of tokens, each joined with the mark of a node."""
    own = mixed.take(token, axis=1)
    own ^= marks
    with np.errstate(over="ignore"):
        own *= PRIME
    return feature_rows(own)


class Lookup(dict):
    """Word to id: frequent words have their rank, others WORDS + their rare kind."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__({w: i for i, w in enumerate(vocabulary.words)})
        self.kinds = vocabulary.kind_of_ending

    def __missing__(self, word: bytes) -> int:
        return WORDS + self.kinds[zlib.crc32(word[-4:]) % ENDINGS]


#: Remainders of the cyclic redundancy check by byte.
CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)


def ending_places(words: pa.Array) -> np.ndarray:
    """``crc32`` of the last four bytes of each word, modulo ``ENDINGS``, of all words at once."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (4, 3, 2, 1):
        at = offsets[1:] - back
        some = at >= offsets[:-1]
        own = crc[some]
        crc[some] = CRC[(own ^ data[at[some]]) & 255] ^ (own >> 8)
    return (~crc % ENDINGS).astype(np.int64)


class Reader:
    """Texts to ids, ids to leaves, and leaves to the choices on their way."""

    def __init__(self, vocabulary: Vocabulary):
        self.known = pa.array(vocabulary.words, pa.binary()).cast(pa.string())
        self.kinds = np.array(vocabulary.kind_of_ending, np.int64)
        self.vocabulary, self._lookup, self._tops = vocabulary, None, None
        self.tree, self.words = vocabulary.tree, len(vocabulary.words)
        with np.errstate(over="ignore"):
            self.marks = np.arange(len(self.tree.bias), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def id_of(self, word: bytes) -> int:
        if self._lookup is None:
            self._lookup = Lookup(self.vocabulary)
        return self._lookup[word]

    def ids_of(self, names: pa.Array) -> np.ndarray:
        """The id of each of many words, as ``id_of`` gives it."""
        found = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(found < 0)
        found[rare] = WORDS + self.kinds[ending_places(names.take(pa.array(rare)))]
        return found

    def tops(self, weights: np.ndarray) -> np.ndarray:
        """The largest weight of each table; kept for weights that were asked for last and do not change."""
        if self._tops is None or self._tops[0] is not weights or weights.flags.writeable:
            self._tops = weights, weights.max(axis=(1, 2))
        return self._tops[1]

    def ids(self, words: list[bytes]) -> list[int]:
        """Ids of the words and of the end."""
        return [*map(self.id_of, words), self.id_of(END.encode())]

    def batch(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of some texts and the end, their ids, the tokens of all texts as numbers of
        distinct ones, each text with its end, and how many tokens each text has."""
        distinct, at, sizes = split(texts)
        names = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END], pa.string())])
        return names, self.ids_of(names), np.insert(at, np.cumsum(sizes), len(names) - 1), sizes + 1

    def leaves(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < WORDS, ids, ids - WORDS + self.words)

    def choices(self, leaves: np.ndarray, keys: np.ndarray):
        """The choices at the root, at its children and further down: (tables, feature rows, priors, child, token)."""
        t = self.tree
        first, depth = t.start[leaves], t.depth[leaves]
        mixed = keys ^ (keys >> np.uint64(29))
        yield TABLES[0], feature_rows(keys), t.bias.take(t.nodes[first], axis=0), t.children[first], np.arange(len(leaves))
        for level in (1, 2):
            n = np.minimum(depth - 1, 1) if level == 1 else np.maximum(depth - 2, 0)
            token = np.repeat(np.arange(len(leaves)), n)
            at = np.arange(len(token)) + np.repeat(first + level - (np.cumsum(n) - n), n)
            nodes = t.nodes[at]
            rows = node_rows(mixed[: TEMPLATES[level]], token, self.marks.take(nodes))
            yield TABLES[level], rows, t.bias.take(nodes, axis=0), t.children[at], token


ONES = np.ones(FAN, np.float32)


def shares(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of each choice before its sum is divided by, and one over the sum: features of all templates and
    the prior. Weights are far from the range of a float, so the largest need not be taken off; ``LARGEST``
    bounds them all the same, where they are not known to be ``bounded``."""
    out = bias
    for w, r in zip(weights, rows):
        out += w.take(r, axis=0)
    if not bounded:
        np.minimum(out, LARGEST, out=out)
    np.exp(out, out=out)
    return out, 1 / np.maximum(out @ ONES, 1e-30)


def sums_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each occurs, and the sums of the ``values`` of each.

    The first values of all short runs of a row are added at once, then the second ones, and so on: most runs
    are too short for sums of their own. Long runs are summed one by one."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    n = np.diff(np.append(first, len(own)))
    by = np.argsort(np.minimum(n, SHORT + 1).astype(np.uint8), kind="stable")[::-1]  # the longest first
    first, n = first[by], n[by]
    sums = values.take(order[first], axis=0)
    long = int(np.count_nonzero(n > SHORT))
    for k in range(1, SHORT):
        some = slice(long, int(np.count_nonzero(n > k)))
        if some.stop > long:
            sums[some] += values.take(order[first[some] + k], axis=0)
    if long:
        ends = np.cumsum(n[:long])
        starts = ends - n[:long]
        items = order[np.arange(ends[-1]) + np.repeat(first[:long] - starts, n[:long])]
        # pairs of floats at a time, which halves the work of short sums
        sums[:long] = np.add.reduceat(values.take(items, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
    return own[first], n, sums


def new_weights() -> np.ndarray:
    return np.zeros((sum(TEMPLATES), ROWS, FAN), np.float32)


def token_logs(reader: Reader, weights: np.ndarray, leaves: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Natural log of each token's probability, up to its leaf."""
    out = np.zeros(len(leaves))
    tops = reader.tops(weights)
    for table, rows, bias, child, token in reader.choices(leaves, keys):
        bounded = tops[table].sum() < LARGEST  # priors are logs of shares
        for at in range(0, len(child), BATCH_TOKENS):
            part = slice(at, at + BATCH_TOKENS)
            own = child[part]
            p, norm = shares(weights[table], rows[:, part], bias[part], bounded)
            p = p.reshape(-1).take(np.arange(0, p.size, FAN) + own) * norm
            out += np.bincount(token[part], np.log(np.maximum(p, 1e-30)), len(out))
    return out


def train_round(docs: DataFrame, shared) -> DataFrame:
    """(row, seen, d0, d1, ...): for each feature row that a task met, how often, and its change times that."""
    names = [f"d{c}" for c in range(FAN)]

    def run(batches):
        vocabulary, start = shared.value
        reader = Reader(vocabulary)
        weights = start.copy()
        squares, seen = np.full(weights.shape[:2], 1e-3, np.float32), np.zeros(weights.shape[:2], np.int32)

        def step(table, rows, bias, child):
            slopes, norm = shares(weights[table], rows, bias)
            slopes *= -norm[:, None]
            slopes.reshape(-1)[np.arange(0, slopes.size, FAN) + child] += 1
            for w, sq, met, r in zip(weights[table], squares[table], seen[table], rows):
                at, n, slope = sums_by_row(r, slopes)
                square = sq[at] + np.einsum("ij,ij->i", slope, slope)
                sq[at] = square
                slope *= (RATE / np.sqrt(square))[:, None]
                w[at] += slope
                met[at] += n.astype(np.int32)

        for texts in (x for b in batches for x in cut(b, 0, READ_BYTES)):
            _, ids_of, at, sizes = reader.batch(texts.column(0))
            ids = ids_of[at]
            for low, high, first, last in groups(sizes, STEP_TOKENS):
                y = ids[first:last]
                keys = context_keys(y, sizes[low:high])
                for table, rows, bias, child, _ in reader.choices(reader.leaves(y), keys):
                    for at_ in range(0, len(child), STEP_TOKENS):
                        part = slice(at_, at_ + STEP_TOKENS)
                        step(table, rows[:, part], bias[part], child[part])
        seen = seen.ravel()
        met = np.flatnonzero(seen)
        weights -= start
        change = weights.reshape(-1, FAN)
        for at in range(0, len(met), 16_384):
            own = met[at : at + 16_384]
            part = change[own] * seen[own, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(seen[own].astype(np.int64)), *[pa.array(part[:, c]) for c in range(FAN)]], ["row", "seen", *names]
            )
        del weights, change, squares, seen, reader
        give_back()

    made = docs.select("text").mapInArrow(run, "row int, seen bigint, " + ", ".join(f"{n} float" for n in names))
    # A task has a row once, so sums inside a task would find nothing to add: rows meet first.
    return made.repartition("row").groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(n).cast("float").alias(n) for n in names])


def fit(train: DataFrame):
    """(vocabulary with its tree, weights, counts of rare words, numbers) from the training documents."""
    parts = stored(counted(train), "token-counts")
    words = stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = scalar_row(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")))
    top = words.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(WORDS)
    ranked = top.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    names, counts = ranked.column("word").to_pylist(), ranked.column("n").to_numpy().astype(float)
    spark = train.sparkSession
    place = {w: i for i, w in enumerate(names)}
    few = F.broadcast(spark.createDataFrame([(w, i) for w, i in place.items()], "word string, id int"))
    by_kind = parts.join(few, "word").groupBy("id", "kind").agg(F.sum("n").alias("n")).groupBy("id").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    kinds = np.zeros(len(names), np.int64)
    found = by_kind.toArrow()
    kinds[found.column("id").to_numpy()] = found.column("kind").to_numpy()
    vocabulary = Vocabulary(names, counts, kinds)
    del ranked, place, found, names
    rare = words.join(few.select("word"), "word", "left_anti")

    kind_of = np.array(vocabulary.kind_of_ending, np.int64)

    def by_rare_kind(batches):
        sums = np.zeros((KINDS + 1, 2), np.int64)
        for b in batches:
            kind, n = kind_of[ending_places(b.column(0).cast(pa.string()))], b.column(1).to_numpy()
            np.add.at(sums, kind, np.stack([n, np.ones_like(n)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS + 1)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["kind", "n", "v"])

    sums = rare.select("word", "n").mapInArrow(by_rare_kind, "kind bigint, n bigint, v bigint").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rare_sums = np.zeros((KINDS + 1, 2))
    for r in sums.collect():
        rare_sums[r.kind] = r.n, r.v
    vocabulary.grow(rare_sums[:, 0])
    weights = new_weights()
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, weights))
        # A second hash deals the training documents to the rounds.
        own = train.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(ROUNDS)) == k)
        own = own.coalesce(max(1, totals.N // ROUNDS // TASK_TOKENS))
        change = train_round(own, shared).toArrow()
        at, seen = change.column("row").to_numpy(), np.maximum(change.column("seen").to_numpy(), 1)
        flat = weights.reshape(-1, FAN)
        for c in range(FAN):
            flat[at, c] += change.column(f"d{c}").to_numpy() / seen
        del change
        shared.destroy()
    return vocabulary, weights, rare, {"N": totals.N, "V": totals.V, "rare": rare_sums}


def scored(rows: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, numbers: dict) -> DataFrame:
    """Per row: what the bounded vocabulary settles, and the words that it does not."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, weights))
    total, distinct = numbers["N"], numbers["V"]

    def run(batches):
        vocabulary, weights = shared.value
        weights.flags.writeable = False
        reader = Reader(vocabulary)
        base = np.concatenate([np.log10((vocabulary.counts + 0.5) / (total + 0.5 * (distinct + 1))), np.zeros(WORDS + KINDS + 1 - len(vocabulary.counts))])
        row = TaskContext.get().partitionId() << 33
        for b in (x for whole in batches for x in cut(whole, 1, READ_BYTES)):
            names, ids_of, at, sizes = reader.batch(b.column(1))
            rare = ids_of >= WORDS
            for low, high, first, last in groups(sizes, SCORED_TOKENS):
                own, n = at[first:last], sizes[low:high]
                y = ids_of[own]
                logs = token_logs(reader, weights, reader.leaves(y), context_keys(y, n)) / np.log(10)
                starts = np.cumsum(n) - n
                # each rare word of a text once, with how often the text has it
                of = np.repeat(np.arange(high - low), n)
                pairs, times = np.unique((of * len(names) + own)[rare[own]], return_counts=True)
                of, word = np.divmod(pairs, len(names))
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=high - low))].astype(np.int32))
                columns = [
                    pa.array(np.arange(row, row + high - low)), b.column(0).slice(low, high - low), pa.array(n.astype(np.int64)),
                    pa.array(np.add.reduceat((y < WORDS).astype(np.int64), starts)), pa.array(np.add.reduceat(base[y], starts)), pa.array(np.add.reduceat(logs, starts)),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array((ids_of[word] - WORDS).astype(np.int32))),
                ]
                row += high - low
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "part", "words", "ns", "kinds"])

    return rows.mapInArrow(
        run, f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, part double, words array<string>, ns array<bigint>, kinds array<int>"
    )


def score(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = narrow(docs, id_col, text_col)
    train = rows.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    vocabulary, weights, rare, numbers = fit(train)
    made = stored(scored(rows, vocabulary, weights, numbers), "scored")
    sums = numbers["rare"]
    n_of = F.array(*[F.lit(float(max(n, 1))) for n, _ in sums])
    # Nothing of the kind was seen: all of its class is for unseen words.
    unseen = F.array(*[F.lit(float(np.log10(DISCOUNT * v / n)) if n else 0.0) for n, v in sums])
    spread = made.select("row", F.explode(F.arrays_zip("words", "ns", "kinds")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.ns").alias("k"), F.col("x.kinds").alias("kind"))
    met = spread.join(rare, "word", "left")
    floor = float(numbers["N"] + 0.5 * (numbers["V"] + 1))
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)
    log = F.when(F.col("n").isNull(), unseen[F.col("kind")]).otherwise(F.log10((F.col("n") - DISCOUNT) / n_of[F.col("kind")]))
    more = met.groupBy("row").agg(
        F.sum(F.col("k") * base).alias("_base"), F.sum(F.col("k") * log).alias("_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("_known"),
    )
    whole = made.drop("words", "ns", "kinds").join(more, "row", "left")
    return whole.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(numbers["N"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), (F.col("part") + F.coalesce("_log", F.lit(0.0))).alias("score"),
    )
