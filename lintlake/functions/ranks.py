"""Ranks, running totals, exact quantiles and row positions without a one-task window.

Order statistics are selected, not sorted for: a sketch brackets the wanted rank, one pass counts what lies
below the bracket and what lies in it, and the bracket is narrowed round by round until it holds few distinct
values. Running totals are scanned in levels: inside blocks whose number grows with the rows, over the blocks
of a group of blocks, and over the groups.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import stored

#: Accuracy of sketches and how far from a rank, as a share of all rows, its bracket reaches.
ACCURACY, SLACK = 10_000, 0.001
#: Distinct values that are ranked on the driver, parts that a round cuts an interval into, and groups.
FEW, STEPS, MOST_GROUPS = 100_000, 64, 10_000
#: Rows of a block, blocks of a group of blocks, and rows of a table that is broadcast at most.
BLOCK_ROWS, BLOCK_GROUP, MOST_BROADCAST = 200_000, 1024, 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``MOST_BROADCAST`` rows."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


class Selected(NamedTuple):
    """The value at a rank, the rows before its first copy, its copies, and all rows of its group."""

    value: object
    before: int
    n: int
    total: int


def narrowed(table: DataFrame, ranks: dict[int, int], few: int = FEW) -> dict[int, tuple]:
    """(value, rows before it, its rows) at a rank of each target, from rows (t, value, n) with distinct
    values per target. An interval that holds the rank is cut at quantiles of its distinct values, the rows
    of each part are counted, and the part with the rank is the next interval."""
    spark, kind = table.sparkSession, table.schema["value"].dataType.simpleString()
    ahead = dict.fromkeys(ranks, 0)
    steps = F.array(*[F.lit(i / STEPS) for i in range(1, STEPS)])
    while True:
        facts = table.groupBy("t").agg(F.count("*").alias("m"), F.array_distinct(F.percentile_approx("value", steps, ACCURACY)).alias("cuts")).collect()
        if sum(f.m for f in facts) <= few:
            break
        cuts = {f.t: sorted(f.cuts) for f in facts}
        known = F.broadcast(spark.createDataFrame(list(cuts.items()), f"t int, cuts array<{kind}>"))
        part = F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("part")
        sums: dict[int, dict[int, int]] = {}
        for r in table.join(known, "t").groupBy("t", part).agg(F.sum("n").alias("n")).collect():
            sums.setdefault(r.t, {})[r.part] = r.n
        bounds = []
        for t, parts in sums.items():
            for part, n in sorted(parts.items()):
                if ranks[t] < ahead[t] + n:
                    break
                ahead[t] += n
            low = cuts[t][part - 1] if part else None
            bounds.append((t, low, cuts[t][part] if part < len(cuts[t]) else None))
        limits = F.broadcast(spark.createDataFrame(bounds, f"t int, low {kind}, high {kind}"))
        inside = (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
        table = table.join(limits, "t").where(inside).select("t", "value", "n")
    found = {}
    for t, value, n in sorted(table.select("t", "value", "n").collect()):
        if t not in found:
            if ranks[t] < ahead[t] + n:
                found[t] = (value, ahead[t], n)
            else:
                ahead[t] += n
    return found


def select_ranks(
    rows: DataFrame, group: str, value: str, shares: list[float], rank: Callable[[int, int], int], few: int = FEW
) -> dict[object, list[Selected | None]]:
    """The values at ``rank(total, i)`` for the i-th share, in each group of rows (group, value).

    ``rows`` are read twice: once for a sketch, which gives each rank a bracket, and once to count the rows
    below the bracket and per distinct value in it. A sketch is not trusted: where a rank turns out to lie
    outside its bracket, the bracket becomes the whole range. Nulls are left out; NaN ranks last and is never
    selected (None). The number of groups is checked.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(group).alias("g"), F.col(value).alias("value")).where("value IS NOT NULL")
    kind = plain.schema["value"].dataType
    number = ~F.isnan("value") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)
    near = [min(1.0, max(0.0, s + d)) for s in shares for d in (-SLACK, SLACK)]
    sketch = F.percentile_approx(F.when(number, F.col("value")), F.array(*map(F.lit, near)), ACCURACY)
    facts = plain.groupBy("g").agg(F.count("*").alias("all"), F.count_if(number).alias("n"), sketch.alias("near")).limit(MOST_GROUPS + 1).collect()
    plain = plain.where(number)
    if len(facts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    targets = {}
    for f in facts:
        for i, share in enumerate(shares):
            low = f.near[2 * i] if f.n and share > SLACK else None
            high = f.near[2 * i + 1] if f.n and share < 1 - SLACK else None
            targets[len(targets)] = (f.g, i, low, high, rank(f["all"], i), f.n, f["all"])
    out: dict[object, list[Selected | None]] = {f.g: [None] * len(shares) for f in facts}
    open_ = {t: x for t, x in targets.items() if 0 <= x[4] < x[5]}
    simple, of = kind.simpleString(), plain.schema["g"].dataType.simpleString()
    while open_:
        known = spark.createDataFrame([(t, x[0], x[2], x[3]) for t, x in open_.items()], f"t int, _g {of}, low {simple}, high {simple}")
        met = plain.join(F.broadcast(known), F.col("g").eqNullSafe(F.col("_g")))
        met = met.where(F.col("high").isNull() | (F.col("value") <= F.col("high")))
        inside = F.when(F.col("low").isNull() | (F.col("value") >= F.col("low")), F.col("value"))
        counted = stored(met.select("t", inside.alias("value")).groupBy("t", "value").agg(F.count("*").alias("n")), "bracket")
        sums = counted.groupBy("t").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("below"), F.sum("n").alias("n")).collect()
        sums = {r.t: r for r in sums}
        held = {t for t, x in open_.items() if t in sums and sums[t].below <= x[4] < sums[t].n}
        ranks = {t: open_[t][4] - sums[t].below for t in held}
        if held:
            mine = counted.where(F.col("value").isNotNull() & F.col("t").isin(list(held)))
            for t, (v, before, n) in narrowed(mine, ranks, few).items():
                out[targets[t][0]][targets[t][1]] = Selected(v, before + sums[t].below, n, targets[t][6])
        open_ = {t: (*x[:2], None, None, *x[4:]) for t, x in open_.items() if t not in held}
    return out


def running_totals(
    counted: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str],
    descending: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``<sum>_before``, the total of the rows ahead in ``order`` with the same keys, and
    ``<sum>_total``, the total of all of them.

    ``counted`` has one row per (keys, order). Its rows are dealt to sorted ranges of about ``block_rows``,
    which are written down as blocks; totals are scanned inside a block, over the blocks of a group of
    blocks, and over the groups (a table of a few rows for billions, scanned on the driver).
    """
    spark = counted.sparkSession
    by = F.desc(order) if descending else F.asc(order)
    counted = stored(counted, "counts")
    blocks = max(1, -(-counted.count() // block_rows))
    ranged = counted.repartitionByRange(blocks, *keys, by).withColumn("_block", F.spark_partition_id())
    ranged = stored(ranged, "blocks")
    ahead = Window.unboundedPreceding, -1
    groups = F.floor(F.col("_block") / BLOCK_GROUP).cast("int")
    totals = ranged.groupBy(*keys, "_block").agg(*[F.sum(s).alias(f"_{s}") for s in sums]).withColumn("_of", groups)
    totals = stored(totals, "block-totals")
    coarse = totals.groupBy(*keys, "_of").agg(*[F.sum(f"_{s}").alias(s) for s in sums]).orderBy(*keys, "_of").collect()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema if f.name in keys)
    names = [f"_{s}_{x}" for s in sums for x in ("groups", "all")]
    facts: dict[tuple, list] = {}
    for r in coarse:
        facts.setdefault(tuple(r[k] for k in keys), []).append(r)
    scanned = []
    for key, rows in facts.items():
        running = {s: list(accumulate((r[s] for r in rows), initial=0)) for s in sums}
        for i, r in enumerate(rows):
            scanned.append((*key, r["_of"], *(x for s in sums for x in (running[s][i], running[s][-1]))))
    kind = {f.name: f.dataType.simpleString() for f in totals.schema}
    shape = ", ".join(filter(None, [kinds, "_of int", *[f"`{n}` {kind['_' + n[1:].rsplit('_', 1)[0]]}" for n in names]]))
    over = small(spark.createDataFrame(scanned, shape), len(scanned))
    earlier = Window.partitionBy(*keys, "_of").orderBy("_block").rowsBetween(*ahead)
    offsets = totals.withColumns({f"_{s}_at": F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)) for s in sums})
    offsets = offsets.join(over, [*keys, "_of"]).select(
        *keys, "_block", *[(F.col(f"_{s}_at") + F.col(f"_{s}_groups")).alias(f"_{s}_offset") for s in sums],
        *[F.col(f"_{s}_all").alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(*ahead)
    result = ranged.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    result = result.join(small(offsets, totals.count()), [*keys, "_block"])
    result = result.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"_{s}_offset") for s in sums})
    return result.drop("_block", *[f"_{s}_offset" for s in sums])


def quantile_map(quantiles: DataFrame) -> Column:
    """A (name, q, value) table as one map from (name, q) to value: a scalar subquery."""
    key = F.struct("name", "q")
    entries = F.collect_list(F.struct(key.alias("k"), F.col("value").alias("v")))
    return quantiles.agg(F.map_from_entries(entries).alias("m")).scalar()


def quantile_of(held: Column, name: str, q: float) -> Column:
    """Look up a value in a column made by ``quantile_map``."""
    return F.element_at(held, F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")))


def _between(low: float, high: float, part: float) -> float:
    return low + (high - low) * part


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of columns as (name, q, value) rows; NaN ranks last.

    The table is read for the sketches and for the brackets around the wanted ranks; only what lies in a
    bracket is counted per distinct value.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        )
    ).where("value IS NOT NULL")
    def rank(total: int, i: int) -> int:
        place = qs[i // 2] * (total - 1)
        return int(place) + (i % 2 if place % 1 else 0)

    at = select_ranks(long, "name", "value", [q for q in qs for _ in (0, 1)], rank)
    sizes = {r.name: r.n for r in long.groupBy("name").agg(F.count("*").alias("n")).collect()} if any(None in x for x in at.values()) else {}
    rows = []
    for c, found in at.items():
        ends = [x.value if x else float("nan") for x in found]
        total = sizes[c] if None in found else found[0].total
        rows += [(c, q, _between(ends[2 * i], ends[2 * i + 1], q * (total - 1) % 1)) for i, q in enumerate(qs)]
    return df.sparkSession.createDataFrame(rows, "name string, q double, value double")


def quantiles_of_counts(counted: DataFrame, qs: list[float]) -> DataFrame:
    """The same, as (q, value), from a table of the count ``n`` of each ``value``."""
    spark = counted.sparkSession
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    ranks = {2 * i + up: int(q * (total - 1)) + (up if q * (total - 1) % 1 else 0) for i, q in enumerate(qs) for up in (0, 1)} if total else {}
    targets = F.array(*[F.lit(t) for t in ranks]) if ranks else F.array().cast("array<int>")
    table = counted.select(F.explode(targets).alias("t"), F.col("value").cast("double").alias("value"), "n")
    found = narrowed(table, ranks)
    rows = [(q, _between(found[2 * i][0], found[2 * i + 1][0], q * (total - 1) % 1)) for i, q in enumerate(qs)] if total else []
    return spark.createDataFrame(rows, "q double, value double")


def _comes_first(order: list[tuple[str, bool]], cut, strictly: bool) -> Column:
    """Whether a row comes before the row ``cut`` in an order of (column, ascending) as Spark sorts: nulls
    first in ascending columns, last in others; ``strictly`` false: or is the same."""
    out = F.lit(not strictly)
    for name, ascending in reversed(order):
        c, value = F.col(name), cut[name]
        if value is None:
            before = F.lit(False) if ascending else c.isNotNull()
        else:
            before = (c.isNull() | (c < F.lit(value))) if ascending else F.coalesce(c > F.lit(value), F.lit(False))
        out = before | (c.eqNullSafe(F.lit(value)) & out)
    return out


def at_rank(rows: DataFrame, order: list[tuple[str, bool]], rank: int, limit: int, few: int, cuts: int = 31) -> tuple[DataFrame, int]:
    """Rows that hold the places ``rank`` to ``rank + limit`` of an order, and the place in them where these
    begin, so that fewer than ``few`` rows come before their end. In each round a sample of bounded size gives cuts, the rows
    between them are counted, and the part that holds the rank is looked at next. Rows that are the same in
    all columns of the order cannot be told apart, so an interval of one key is not cut further."""
    inside, total = rows, rows.count()
    start, size = 0, total
    by = [F.asc(c) if ascending else F.desc(c) for c, ascending in order]
    kept = rows
    seed = 0
    while rank < total and rank - start + limit > few:
        drawn = inside.sample(fraction=min(1.0, 40.0 * cuts / size), seed=seed).orderBy(*by).collect()
        seed += 1
        if not drawn:
            continue
        chosen = [drawn[len(drawn) * i // (cuts + 1)] for i in range(1, cuts + 1)]
        chosen = [c for i, c in enumerate(chosen) if not i or c != chosen[i - 1]]
        # Even parts lie between cuts, odd ones are the rows equal to a cut.
        part = F.lit(2 * len(chosen))
        for i, c in reversed(list(enumerate(chosen))):
            part = F.when(_comes_first(order, c, True), 2 * i).when(_comes_first(order, c, False), 2 * i + 1).otherwise(part)
        counts = {r.part: r.n for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        for p, n in sorted(counts.items()):
            if rank < start + n:
                break
            start += n
        if p:
            kept = rows.where(~_comes_first(order, chosen[(p - 1) // 2], p % 2 == 1))
        if p % 2:
            break
        size = n
        if p:
            inside = inside.where(~_comes_first(order, chosen[p // 2 - 1], False))
        if p < 2 * len(chosen):
            inside = inside.where(_comes_first(order, chosen[p // 2], True))
    return kept, rank - start


def with_scan_index(df: DataFrame, name: str) -> DataFrame:
    """Zero-based position of each row of a scanned table.

    Files come in the order of their names and rows in the order of the file: a row's position is that of
    its stretch of a file (file, offset of the block) and its place in it. Tables that are not scanned files
    count by partition. The sizes of the stretches are summed up on the driver, one row for each."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    try:
        of = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        tagged = df.select("*", of.alias("_stretch"), F.monotonically_increasing_id().alias("_id"))
        tagged.schema  # noqa: B018  resolves the hidden column
    except Exception:  # noqa: BLE001  no files below
        tagged = tagged.withColumn("_stretch", F.struct(F.lit("").alias("file"), F.shiftrightunsigned("_id", 33).alias("block")))
    sizes = tagged.groupBy("_stretch").agg(F.count("*").alias("n"), F.min("_id").alias("first")).orderBy("_stretch").collect()
    starts = accumulate((s.n for s in sizes), initial=0)
    known = [(s["_stretch"].file, s["_stretch"].block, start - s.first) for s, start in zip(sizes, starts)]
    shift = df.sparkSession.createDataFrame(known, "_file string, _block bigint, _shift bigint")
    same = (F.col("_stretch.file") == F.col("_file")) & (F.col("_stretch.block") == F.col("_block"))
    return (
        tagged.join(small(shift, len(known)), same)
        .withColumn(name, F.col("_id") + F.col("_shift"))
        .drop("_id", "_stretch", "_file", "_block", "_shift")
    )
