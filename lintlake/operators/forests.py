"""Forests of many settings over several folds, grown and scored at once: what a search compares.

Every fold's training rows are scaled and binned once, and lie in blocks. A unit is a block with some trees of one
setting. A round takes one level of all trees: units move their rows to the nodes chosen last, and count classes
per bin of the features drawn for each open node; counts are summed over the blocks of a tree, and every open node
gets its best cut. So a level of all forests is one job, rows and trees are both shared out, and a row whose node
is a leaf costs nothing further. Then held-out rows go down the trees, votes are summed, and F1 is counted.

The trees follow Spark ML's forests: 32 bins, a Poisson bag of rows, the root of the number of features drawn for
each node, Gini of the weighted classes, cuts with a gain and enough rows on both sides, leaves that say the same
merged, and shares of classes as votes; only the bins do not go by the weights of rows. Rows are drawn by fold, tree and
block, features by a node's path, so settings meet the same draws, and forests go on in the same nodes until they
choose otherwise: a forest is the same alone.
"""

from __future__ import annotations

import math
import pickle
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import shared_dir, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature; distinct values counted one by one, above which quantiles stand for them, and how many.
BINS, MOST_VALUES, QUANTILES = 32, 4096, 1024
#: Rows of a block. Rows times trees of a unit and of a wave: a wave's places of rows are stored, six bytes each, for
#: every kind of forest that has gone another way.
BLOCK_ROWS, UNIT, WAVE = 100_000, 400_000, 300_000_000
#: Nodes whose counts are laid out at a time; bytes of choices that are broadcast; units of a task.
NODES, SMALL_BYTES, TASK_UNITS = 2048, 32 << 20, 8
EPSILON = float(np.finfo(float).eps)
#: Poisson draws of mean one for 16 random bits.
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def cut_points(values: np.ndarray, counts: np.ndarray, most: int = BINS) -> np.ndarray:
    """Cuts between sorted distinct values as Spark ML puts them: all midpoints if there are fewer than
    ``most``, else about evenly by count."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < most:
        return middle
    stride = counts.sum() / most
    out, seen, goal = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - goal) < abs(seen - goal):
            out.append(middle[i - 1])
            goal += stride
    return np.array(out)


def all_cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The cuts of each of the features of ``x``, from all rows."""
    long = rows.select(F.posexplode("x").alias("i", "v"))
    known = stored(long.groupBy("i", "v").agg(F.count("*").alias("n")), "values")
    sizes = {r.i: r.n for r in known.groupBy("i").agg(F.count("*").alias("n")).collect()}
    few = [i for i, n in sizes.items() if n <= MOST_VALUES]
    pairs: dict[int, list] = {i: [] for i in sizes}
    for r in known.where(F.col("i").isin(few)).collect():
        pairs[r.i].append((r.v, r.n))
    if len(few) < len(sizes):
        parts = [j / QUANTILES for j in range(QUANTILES + 1)]
        many = long.where(~F.col("i").isin(few)).groupBy("i").agg(F.percentile_approx("v", parts, 10_000).alias("q"))
        for r in many.collect():
            pairs[r.i] = list(zip(*(a.tolist() for a in np.unique(r.q, return_counts=True))))
    most = min(BINS, rows.count())
    sorted_pairs = [np.array(sorted(pairs.get(i) or [(0.0, 1)])) for i in range(width)]
    return [cut_points(p[:, 0], p[:, 1], most) for p in sorted_pairs]


def blocks_of(rows: DataFrame, cuts: list[np.ndarray], fold: int) -> DataFrame:
    """(fold, block, n, train, held): bins and classes of blocks of rows, those of the fold apart."""

    def run(batches):
        part, k, kept, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            bins, y, out = (np.concatenate(a, axis=-1) for a in zip(*kept))
            both = [pickle.dumps((np.ascontiguousarray(bins[:, m]), y[m])) for m in (~out, out)]
            values = [[fold], [part * 1_000_000 + k], [int((~out).sum())], [both[0]], [both[1]]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["fold", "block", "n", "train", "held"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bins = np.array([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], dtype=np.uint8)
            kept.append((bins, b.column("target").to_numpy().astype(np.uint8), b.column("fold").to_numpy() == fold))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                k, kept, n = k + 1, [], 0
        if kept:
            yield block()

    return rows.mapInArrow(run, "fold int, block bigint, n bigint, train binary, held binary")


def bag(n: int, fold: int, tree: int, block: int, seed: int) -> np.ndarray:
    """How often each row of a block is in a tree's bag."""
    return POISSON.take(np.random.default_rng([seed, fold, tree, block]).integers(0, 1 << 16, n, dtype=np.uint16))


def mixed(keys: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit keys (the finish of SplitMix)."""
    z = keys + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def root_key(fold: int, tree: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, fold, tree]).integers(0, 1 << 63, 1).astype(np.uint64)


def drawn(keys: np.ndarray, width: int, take: int) -> np.ndarray:
    """The features tried at each open node, one row per feature tried; a node's draw hangs on its path alone."""
    if take >= width:
        return np.tile(np.arange(width)[:, None], len(keys))
    order = mixed(keys[:, None] + np.arange(1, width + 1).astype(np.uint64)).argpartition(take - 1, axis=1)
    return np.ascontiguousarray(order[:, :take].T)


def moved(rows: np.ndarray, at: np.ndarray, options: list, flat: np.ndarray, n: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their nodes in the new level: a row goes on once for each cut that its node was given."""
    out_rows, out_at = [], []
    for k, (has, feature, cut, child) in enumerate(options):
        if k:
            some = np.flatnonzero(has.take(at))
            r, v = rows.take(some), at.take(some)
        else:
            r, v = rows, at
        to = child.take(2 * v + (flat.take(feature.take(v) * n + r) >= cut.take(v)))
        stay = np.flatnonzero(to >= 0)
        out_rows.append(r.take(stay))
        out_at.append(to.take(stay))
    return np.concatenate(out_rows), np.concatenate(out_at)


def class_counts(rows, at, weight, flat, n, tried, classes, nodes) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero counts by (node, feature tried, bin, class), and their places in that order. ``flat`` holds
    bin times classes plus class, feature by feature."""
    step = BINS * classes
    places, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    if nodes > NODES:
        order = np.argsort(at, kind="stable")
        rows, at, weight = rows[order], at[order], weight[order]
    starts = tried * n
    for low in range(0, nodes, NODES):
        high = min(nodes, low + NODES)
        a, b = (0, len(at)) if nodes <= NODES else np.searchsorted(at, [low, high])
        if a == b:
            continue
        r, node, w = rows[a:b], at[a:b], weight[a:b]
        base = (node - low) * step
        made = [np.bincount(base + flat.take(t.take(node) + r), w, (high - low) * step) for t in starts]
        whole = np.stack(made).reshape(len(tried), high - low, step).swapaxes(0, 1).ravel()
        found = np.flatnonzero(whole)
        places.append(found + low * len(tried) * step)
        counts.append(whole.take(found).astype(np.uint32))
    return np.concatenate(places), np.concatenate(counts)


def impurity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and Gini impurity of weighted classes, which lie in the last place."""
    total = counts.sum(axis=-1)
    share = counts / np.maximum(total, EPSILON)[..., None]
    return total, 1 - (share * share).sum(axis=-1)


def shares_of(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1), EPSILON)[..., None]


def chosen(parts: list, keys: np.ndarray, member: np.ndarray, tried: np.ndarray, kinds: list, level: int):
    """The best cut of every open node of a tree for each kind of forest that has it. A kind is (weights of the
    classes, least rows of a side, depth). Kinds that choose alike go on in the same nodes. Returns the cuts for the
    rows, the new level's (keys, member), and for each kind its own (feature, cut, child, shares, own shares)."""
    take, classes, nodes = len(tried), len(kinds[0][0]), len(keys)
    width, many = take * BINS * classes, len(kinds)
    code, pure = np.full((nodes, many), -1), np.zeros((nodes, many, 2), bool)
    shares, own = np.zeros((nodes, many, 2, classes)), np.zeros((nodes, many, classes))
    for low in range(0, nodes, NODES):
        high = min(nodes, low + NODES)
        counts = np.zeros((high - low) * width)
        for places, found in parts:
            a, b = np.searchsorted(places, [low * width, high * width])
            counts[places[a:b] - low * width] += found[a:b]
        left = counts.reshape(high - low, take, BINS, classes).cumsum(axis=2)
        whole = left[:, :1, -1:]
        left = left[:, :, :-1]
        right = whole - left
        fewest = np.minimum(left.sum(axis=-1), right.sum(axis=-1)).reshape(high - low, -1)
        for weights in dict.fromkeys(k[0] for k in kinds):
            n, before = impurity(whole * weights)
            (n_left, of_left), (n_right, of_right) = impurity(left * weights), impurity(right * weights)
            gain = (before - (n_left * of_left + n_right * of_right) / np.maximum(n, EPSILON)).reshape(high - low, -1)
            mine = shares_of(whole[:, 0, 0] * weights)
            for i, (w, least, depth) in enumerate(kinds):
                each = np.flatnonzero(member[low:high, i])
                if w != weights or not len(each):
                    continue
                allowed = np.where(fewest[each] >= least, gain[each], -1.0)
                best = allowed.argmax(axis=1)
                cuts = (allowed[np.arange(len(each)), best] > 0) & (level < depth)
                j, at = best // (BINS - 1), best % (BINS - 1)
                sides = np.stack([left[each, j, at], right[each, j, at]], axis=1) * weights
                v = each + low
                own[v, i] = mine[each]
                shares[v, i] = np.where(cuts[:, None, None], shares_of(sides), mine[each][:, None])
                pure[v, i] = impurity(sides)[1] < EPSILON
                code[v, i] = np.where(cuts, tried[j, v] * 256 + at, -1)
    # The first kind of those that cut a node alike stands for them; a node's cuts are ranked in that order.
    stands = np.full((nodes, many), -1)
    for i in range(many):
        for j in range(i + 1):
            same = (stands[:, i] < 0) & (code[:, i] >= 0) & (code[:, j] == code[:, i])
            stands[same, i] = j
    first = stands == np.arange(many)
    rank = first.cumsum(axis=1) - 1
    going = np.array([level + 1 < k[2] for k in kinds])
    options, next_keys, next_member, count = [], [np.zeros(0, np.uint64)], [np.zeros((0, many), bool)], 0
    child = np.full((nodes, many, 2), -1)
    for r in range(int(first.sum(axis=1).max(initial=0))):
        v, i = np.nonzero(first & (rank == r))
        alike = (stands[v] == i[:, None]) & going
        inside = alike[:, None, :] & ~pure[v, i][:, :, None]
        exists = inside.any(axis=2)
        number = np.where(exists, np.cumsum(exists).reshape(exists.shape) - 1 + count, -1)
        count += int(exists.sum())
        child[v] = np.where(inside.swapaxes(1, 2), number[:, None, :], child[v])
        has, feature, cut, to = np.zeros(nodes, bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full((nodes, 2), -1)
        has[v], feature[v], cut[v], to[v] = True, code[v, i] // 256, (code[v, i] % 256 + 1) * classes, number
        options.append((has, feature, cut, to.ravel()))
        made = mixed(mixed(keys[v] ^ code[v, i].astype(np.uint64))[:, None] + np.arange(2).astype(np.uint64))
        next_keys.append(made[exists])
        next_member.append(inside[exists])
    keys, grown = np.concatenate(next_keys), np.concatenate(next_member)
    place = np.cumsum(grown, axis=0) - 1
    levels = []
    for i in range(many):
        v = np.flatnonzero(member[:, i])
        to, c = child[v, i], code[v, i]
        to = np.where(to >= 0, place[to, i], -1) if len(place) else to
        levels.append((np.maximum(c, 0) // 256, np.where(c >= 0, c % 256, 255).astype(np.uint8), to.ravel(), shares[v, i], own[v, i]))
    return options, (keys, grown), levels


def whole_tree(levels: list) -> tuple[np.ndarray, ...]:
    """One tree of its levels: (feature, cut, next node or -1, shares) with two sides per node; the last level's sides
    are leaves. From the deepest level up, a node whose sides are leaves with the same verdict becomes a leaf."""
    out, leaf, mine = [], None, None
    starts = np.cumsum([0, *[len(lv[0]) for lv in levels]])
    for k in range(len(levels) - 1, -1, -1):
        feature, cut, to, shares, own = levels[k]
        to = to.copy() if leaf is not None else np.full(len(to), -1)
        shares, cut = shares.reshape(-1, shares.shape[-1]).copy(), cut.copy()
        if leaf is not None:
            inner = np.flatnonzero(to >= 0)
            ends = inner[leaf[to[inner]]]
            shares[ends] = mine[to[ends]]
            to[ends] = -1
        is_leaf, says = (to < 0).reshape(-1, 2), shares.argmax(axis=1).reshape(-1, 2)
        leaf, mine = is_leaf.all(axis=1) & (says[:, 0] == says[:, 1]), own
        shares[np.repeat(leaf, 2)] = np.repeat(own[leaf], 2, axis=0)
        cut[leaf] = 255
        out.append((feature, cut, np.where(to >= 0, to + starts[k + 1], -1), shares))
    return tuple(np.concatenate(a) for a in zip(*out[::-1]))


def votes_of(tree: tuple, bins: np.ndarray, votes: np.ndarray) -> None:
    """Add the shares of each row's leaf to its votes."""
    feature, cut, to, shares = tree
    rows, at, flat = np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.intp), bins.ravel()
    while len(rows):
        slot = 2 * at + (flat.take(feature.take(at) * bins.shape[1] + rows) > cut.take(at))
        at = to.take(slot)
        done = at < 0
        votes[rows[done]] += shares[slot[done]]
        rows, at = rows[~done], at[~done]


def _removed(spark, path: str) -> None:
    """Delete a level's places: only the next level reads them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _kinds(settings: list, tree: int) -> list[tuple]:
    """(weights, least rows of a side, depth) of the forests that have the tree: those alike are grown once, as deep
    as the deepest of them; depth 0 and no tree where none has it."""
    deepest: dict[tuple, int] = {}
    for trees, depth, least, weights in settings:
        deepest[weights, least] = max(deepest.get((weights, least), -1), depth if tree < trees else -1)
    return [(*k, depth) for k, depth in deepest.items()]


def _grown(units: DataFrame, settings: list, width: int, tried: int, bagged: bool, seed: int, tasks: int) -> DataFrame:
    """(g, levels) of the units' groups, a level of all trees in a job."""
    spark = units.sparkSession
    names = ["g", "fold", "first", "size", "block"]
    kept = "g int, fold int, first int, size int, block bigint"
    classes = len(settings[0][3])

    def level_of(level: int):
        def run(batches):
            for frame in batches:
                for u in frame.itertuples(index=False):
                    bins, y = pickle.loads(u.train)
                    n = bins.shape[1]
                    flat = (bins.astype(np.uint16) * classes + y).ravel()
                    state = pickle.loads(u.state) if level else [None] * u.size
                    choices = pickle.loads(u.choice) if level else [None] * u.size
                    places, counts = [], []
                    for k, (old, choice) in enumerate(zip(state, choices)):
                        tree = u.first + k
                        if level and (choice is None or not len(choice[1][0])):
                            places.append(None)
                            counts.append(None)
                            continue
                        times = bag(n, u.fold, tree, u.block, seed) if bagged else np.ones(n, np.uint8)
                        if level:
                            nodes = choice[1]
                            rows, at = moved(old[0].astype(np.intp), old[1].astype(np.intp), choice[0], flat, n, classes)
                        else:
                            nodes = root_key(u.fold, tree, seed), np.array([[k[2] >= 0 for k in _kinds(settings, tree)]])
                            rows = np.flatnonzero(times)
                            at = np.zeros(len(rows), np.intp)
                        most = len(nodes[0])
                        sums = class_counts(rows, at, times.take(rows).astype(float), flat, n, drawn(nodes[0], width, tried), classes, most)
                        places.append((rows.astype(np.uint32), at.astype(np.uint16 if most < 1 << 16 else np.uint32)))
                        counts.append((nodes, *sums))
                    row = [*(getattr(u, c) for c in names), u.train, pickle.dumps(places), pickle.dumps(counts)]
                    yield pd.DataFrame([row], columns=[*names, "train", "state", "counts"])

        return run

    def choose(level: int):
        def run(frame):
            u = frame.iloc[0]
            blocks = [pickle.loads(c) for c in frame.counts]
            choices, levels, left = [], [], 0
            for k in range(u["size"]):
                parts = [b[k] for b in blocks]
                if parts[0] is None:
                    choices.append(None)
                    levels.append(None)
                    continue
                keys, member = parts[0][0]
                kinds = _kinds(settings, u["first"] + k)
                options, nodes, found = chosen([p[1:] for p in parts], keys, member, drawn(keys, width, tried), kinds, level)
                choices.append((options, nodes))
                levels.append(found)
                left += len(nodes[0])
            row = [u.g, u.fold, u["first"], level, left, pickle.dumps(choices), pickle.dumps(levels)]
            return pd.DataFrame([row], columns=["g", "fold", "first", "level", "left", "choice", "levels"])

        return run

    made, before, levels = units.repartition(tasks), None, []
    for level in range(max(s[1] for s in settings) + 1):
        shape = f"{kept}, train binary, state binary, counts binary"
        path = shared_dir(spark, "places")
        # Few units a file, because writers and readers hold a file's rows.
        made.mapInPandas(level_of(level), shape).write.option("maxRecordsPerFile", TASK_UNITS).parquet(path)
        grown = spark.read.schema(shape).parquet(path)
        found = grown.select(*names, "counts").repartition(tasks, "g").groupBy("g")
        shape = "g int, fold int, first int, level int, left bigint, choice binary, levels binary"
        levels.append(stored(found.applyInPandas(choose(level), shape), "choices"))
        if before:
            _removed(spark, before)
        before = path
        left, size = levels[-1].agg(F.sum("left"), F.sum(F.length("choice"))).first()
        if not left:
            break
        choice = levels[-1].where("left > 0").select("g", "choice")
        made = grown.drop("counts").join(F.broadcast(choice) if size <= SMALL_BYTES else choice, "g")
    _removed(spark, before)
    everything = levels[0]
    for more in levels[1:]:
        everything = everything.unionByName(more)
    return everything.select("g", "fold", "first", "level", "levels")


def _judged(held: DataFrame, levels: DataFrame, settings: list) -> DataFrame:
    """(trial, fold, tp, fp, fn) of class one among the held-out rows, a forest's trees cut off at its depth."""
    order = list(dict.fromkeys((s[3], s[2]) for s in settings))

    def assemble(frame):
        frame = frame.sort_values("level")
        each = [pickle.loads(x) for x in frame.levels]
        u = frame.iloc[0]
        forests = []
        for trees, depth, least, weights in settings:
            i, own = order.index((weights, least)), []
            for k in range(min(len(each[0]), trees - u["first"])):
                parts = [lv[k][i] for lv in each[: max(depth, 1)] if lv[k] is not None]
                own.append(whole_tree([p for p in parts if len(p[0])]))
            forests.append(own)
        return pd.DataFrame([[u.g, u.fold, u["first"], pickle.dumps(forests)]], columns=["g", "fold", "first", "trees"])

    def vote(batches):
        for frame in batches:
            for u in frame.itertuples(index=False):
                bins, y = pickle.loads(u.held)
                for trial, forest in enumerate(pickle.loads(u.trees)):
                    if forest:
                        votes = np.zeros((bins.shape[1], len(settings[trial][3])))
                        for tree in forest:
                            votes_of(tree, bins, votes)
                        row = [trial, u.fold, u.block, u.first, pickle.dumps(y), pickle.dumps(votes)]
                        yield pd.DataFrame([row], columns=["trial", "fold", "block", "first", "y", "votes"])

    def count(frame):
        u = frame.iloc[0]
        yes = sum(pickle.loads(v) for v in frame.sort_values("first").votes).argmax(axis=1) == 1
        is_one = pickle.loads(u.y) == 1
        row = [u.trial, u.fold, int((yes & is_one).sum()), int((yes & ~is_one).sum()), int((~yes & is_one).sum())]
        return pd.DataFrame([row], columns=["trial", "fold", "tp", "fp", "fn"])

    cores = held.sparkSession.sparkContext.defaultParallelism
    trees = stored(levels.repartition(4 * cores, "g").groupBy("g").applyInPandas(assemble, "g int, fold int, first int, trees binary"), "trees")
    units = held.join(trees, "fold").repartition(max(cores, trees.count()))
    voted = units.mapInPandas(vote, "trial int, fold int, block bigint, first int, y binary, votes binary")
    voted = stored(voted, "votes")
    counted = voted.groupBy("trial", "fold", "block").applyInPandas(count, "trial int, fold int, tp bigint, fp bigint, fn bigint")
    return counted.groupBy("trial", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def fold_f1(
    data: DataFrame, scaler, settings: list[tuple], folds: int, seed: int, bagged: bool = True, tried: int | None = None
) -> list[list[float]]:
    """F1 of class one for each setting and held-out fold of (features, target, fold) rows, which are read in
    the order they lie in. A setting is (trees, depth, least rows of a side, weight of each class). ``bagged``
    and ``tried`` stand for the draws of rows and the number of features drawn for a node."""
    spark = data.sparkSession
    width = len(data.first().features)
    settings = [(*s[:3], tuple(s[3])) for s in settings]
    blocks = []
    for fold in range(folds):
        fitted = scaler.fit(data.where(F.col("fold") != fold))
        rows = fitted.transform(data).select("fold", "target", vector_to_array("scaled").alias("x"))
        cuts = all_cuts(rows.where(F.col("fold") != fold), width)
        blocks.append(stored(blocks_of(rows, cuts, fold), "blocks"))
    sizes = [b.agg(F.max("n"), F.sum("n"), F.count("*")).first() for b in blocks]
    most, total, per_fold = (max(s[i] for s in sizes) for i in range(3))
    binned = blocks[0]
    for more in blocks[1:]:
        binned = binned.unionByName(more)
    cores = spark.sparkContext.defaultParallelism
    trees = max(s[0] for s in settings)
    # As many units as cores at least, twice over.
    step = max(1, min(UNIT // max(most, 1), trees * folds * per_fold // (2 * cores)))
    groups = [(fold, first, min(step, trees - first)) for first in range(0, trees, step) for fold in range(folds)]
    wave = max(1, WAVE // (step * max(total, 1)))
    levels = None
    for at in range(0, len(groups), wave):
        some = [(at + g, *x) for g, x in enumerate(groups[at : at + wave])]
        named = spark.createDataFrame(some, "g int, fold int, first int, size int")
        units = len(some) * per_fold
        tasks = max(1, min(units, max(2 * cores, -(-units // TASK_UNITS))))
        each = binned.select("fold", "block", "train").join(F.broadcast(named), "fold")
        take = tried or math.ceil(math.sqrt(width))
        made = _grown(each, settings, width, take, bagged, seed, tasks)
        levels = made if levels is None else levels.unionByName(made)
    out = [[0.0] * folds for _ in settings]
    for r in _judged(binned.select("fold", "block", "held"), levels, settings).collect():
        out[r.trial][r.fold] = 2 * r.tp / (2 * r.tp + r.fp + r.fn) if r.tp else 0.0
    return out
