"""Packing token sequences into windows by minimum bin slack.

Every task tokenises its documents, cuts them into full windows and one remainder each, and packs the
remainders of a block by minimum bin slack over the multiset of their lengths. Lengths are below the
window, so the multiset is a histogram of fixed size: the longest remaining length opens a window, a
subset-sum dynamic programme over bitsets finds the fill closest to the capacity, its counts are
backtracked, and the pattern is used as often as the histogram allows. Where no fill is exact, the
longest remainder that is left is cut to close the gap. Nothing is shuffled and no task sees more than
its own documents; a task ends with at most one window that is not full.

Token ids are made once for each distinct space-separated unit of a batch, with a bounded cache: a unit
boundary (a space after a character that is not white space) is always a boundary of the tokenizer's own
units. Texts in which a space follows other white space are encoded whole.

Defined results: null text is empty, and an empty text is the single end id; rows that repeat each
other are packed each; an empty table gives no rows; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lintlake.llm.common import cut, give_back, narrow, worker_state

WINDOW, END_ID = 2048, 1
#: Remainders packed together; entries of the cache of unit ids; smallest piece cut to close a gap.
BLOCK, CACHED, LEAST_CUT = 65_536, 400_000, 16
#: Bytes of remainders that are held for packing; bytes of text that are encoded at a time.
HELD_BYTES, ENCODED_BYTES = 64 << 20, 4 << 20
SCHEMA = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: White space before a space: there a space does not begin a unit.
_SPACED = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


class Encoder:
    """Texts to unsigned 32-bit token ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin with a space: in units that are joined, the first of each unit and no other.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.cache: dict[str, bytes] = {}
        self.missed = 0

    def ids(self, text: str) -> np.ndarray:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, "<u4")

    def fill(self, missing: list[str]) -> list[bytes]:
        """Ids of units, encoded in one call: joined they keep their boundaries."""
        ids = self.ids("".join(missing))
        cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
        ids = ids.tobytes()
        return [ids[i:j] for i, j in zip(cuts, [*cuts[1:], len(ids)])]

    def units(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts of texts, each behind a space."""
        cache = self.cache
        out = list(map(cache.get, parts))
        missing = [p for p, ids in zip(parts, out) if ids is None]
        if missing:
            self.missed += len(missing)
            if self.missed > 20 * CACHED:  # the words have changed
                cache.clear()
                self.missed = 0
            made = dict(zip(missing, self.fill([" " + p for p in missing])))
            if len(cache) < CACHED:
                cache.update((p, ids) for p, ids in made.items() if len(p) < 64)
            out = [made[p] if ids is None else ids for p, ids in zip(parts, out)]
        return out

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. The distinct parts of all texts are looked up or encoded once; texts in which
        white space is followed by a space, and empty ones, are encoded alone."""
        alone = pc.or_(pc.match_substring_regex(texts, _SPACED), pc.equal(pc.binary_length(texts), 0))
        alone = alone.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(alone).tolist():
            out[i] = self.ids(texts[i].as_py())
        plain = np.flatnonzero(~alone)
        if not len(plain):
            return out
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        begin = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        begin = begin - begin[0]
        first = np.zeros(len(at), bool)
        first[begin[:-1]] = True
        # The first part of a text has no space before it.
        heads, rests = np.unique(at[first]), np.unique(at[~first])
        found = [self.ids(w).tobytes() for w in words.take(pa.array(heads)).to_pylist()]
        found += self.units(words.take(pa.array(rests)).to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        made = np.frombuffer(b"".join(found), "<u4")
        slot = np.empty(len(at), np.int64)
        of = np.zeros(len(words), np.int64)
        of[heads] = np.arange(len(heads))
        slot[first] = of[at[first]]
        of[rests] = len(heads) + np.arange(len(rests))
        slot[~first] = of[at[~first]]
        n = size[slot]
        ends = np.cumsum(n)
        ids = made[np.arange(ends[-1]) + np.repeat(start[slot] - (ends - n), n)]
        cuts = np.r_[0, ends[begin[1:] - 1]].tolist()
        for i, low, high in zip(plain.tolist(), cuts, cuts[1:]):
            out[i] = ids[low:high]
        return out


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length to how often: the multiset within ``counts`` whose sum is closest to the capacity from
    below. Bit s of a bitset says that sum s can be reached; the earliest bitset with the wanted sum is
    walked back to counts."""
    mask = (1 << (capacity + 1)) - 1
    steps, reach = [], 1
    goal = 1 << capacity
    for length in sorted(counts, reverse=True):
        n = min(counts[length], capacity // length)
        size = 1
        while n > 0:  # 1, 2, 4, ... copies at once make every number up to n
            size = min(size, n)
            steps.append((reach, length, size))
            reach |= (reach << (length * size)) & mask
            n -= size
            size *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    fill: dict[int, int] = defaultdict(int)
    for before, length, size in reversed(steps):
        if not before >> at & 1:
            fill[length] += size
            at -= length * size
    return dict(fill)


def pack_block(pieces: list[tuple[int, int, int]], window: int, least_cut: int = LEAST_CUT):
    """Windows of a block of remainders (item, start, length below the window): lists of (item, start, length)."""
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, start, length in pieces:
        held[length].append((item, start))
    counts = {n: len(v) for n, v in held.items()}

    def take(length):
        item, start = held[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return item, start, length

    def put(item, start, length):
        held[length].append((item, start))
        counts[length] = counts.get(length, 0) + 1

    while counts:
        seed = max(counts)
        counts[seed] -= 1
        fill = best_fill({k: v for k, v in counts.items() if v}, window - seed)
        counts[seed] += 1
        pattern = dict(fill)
        pattern[seed] = pattern.get(seed, 0) + 1
        slack = window - sum(k * v for k, v in pattern.items())
        left = sum(counts.values()) - sum(pattern.values())
        times = min(counts[k] // v for k, v in pattern.items())
        if slack and left:
            times = 1
        for _ in range(times):
            made = [take(k) for k, v in pattern.items() for _ in range(v)]
            if slack >= least_cut and counts and max(counts) > slack:
                item, start, length = take(max(counts))
                made.append((item, start, slack))
                put(item, start + slack, length - slack)
            yield made


def pack(docs: DataFrame, tokenizer: str, window=WINDOW, end_id=END_ID, block=BLOCK, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the number of the task's partition and, in the lower 33 bits, of the sequence in it."""
    rows = narrow(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        state = worker_state()
        if state.get("encoder_of") != tokenizer:
            state.update(encoder_of=tokenizer, encoder=Encoder(tokenizer))
        encode = state["encoder"]
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        tails: list[tuple[int, int, int]] = []
        held: list[tuple[object, bytes, int, int]] = []  # id, bytes of the remainder, its start, tokens
        held_bytes = 0

        def flush():
            nonlocal sequence
            for made in pack_block(tails, window):
                offset = 0
                for item, start, length in made:
                    doc, ids, first, tokens = held[item]
                    part = ids[4 * (start - first) : 4 * (start - first + length)]
                    out.append((doc, start, length, zlib.crc32(part), tokens, sequence, offset))
                    offset += length
                sequence += 1
            tails.clear()
            held.clear()

        def rows_out():
            columns = list(zip(*out)) if out else [()] * 7
            made = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow_kind), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            out.clear()
            return made

        arrow_kind = pa.int64()
        for b in batches:
            arrow_kind = b.schema.field(0).type
            for part in cut(b, 1, ENCODED_BYTES, trim=False):
                for doc, ids in zip(part.column(0).to_pylist(), encode.batch(part.column(1))):
                    ids = ids.tobytes() + end
                    tokens = len(ids) // 4
                    full = tokens // window * window
                    for at in range(0, full, window):
                        out.append((doc, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), tokens, sequence, 0))
                        sequence += 1
                    if tokens > full:
                        tails.append((len(held), full, tokens - full))
                        held.append((doc, ids[4 * full :], full, tokens))
                        held_bytes += 4 * (tokens - full)
                    if len(tails) >= block or held_bytes >= HELD_BYTES:
                        flush()
                        held_bytes = 0
                    if len(out) >= 65_536:
                        yield rows_out()
        flush()
        yield rows_out()
        give_back()

    return rows.mapInArrow(run, SCHEMA.format(kind.simpleString()))
