"""Quality rules by distribution divergence.

Basic rules first (at least 50 words, at most half of them in repeated three-word windows). A document
that passes is held against the reference of its language: the Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1) between its histogram of character classes and the reference's, and
between its histogram of the language's most common words and the reference's. Short texts differ by
chance, so a limit is a constant plus a share that falls with the square root of the number of words,
and a guard leaves the word histogram out below a minimum length.

References are counts over all documents that pass the basic rules, by language: one pass counts
characters and words, a second scores. Common words are found from whole counts; the reference table
has ``COMMON`` + 1 + 9 numbers per language, and languages are codes (fewer than 8,000).

Defined results: null text has no words and fails; a null language is a language of its own; a language
whose passing documents hold fewer than ``LEAST_REFERENCE`` words has no reference, and only the basic
rules count; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import small_batches, stored, worker_state
from lintlake.llm.textstats import N_CLASSES, basic_counts, class_counts, class_table

LEAST_WORDS, MOST_REPEATED = 50, 50
COMMON, LEAST_REFERENCE, LEAST_SHARE = 50, 2_000, 2_000
#: Limits of the distances: constant, and what is added divided by the square root of the words.
CLASS_LIMIT, WORD_LIMIT = (0.16, 2.0), (0.27, 2.2)
#: Fewest words for the word histogram to count.
WORD_GUARD = 60
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 300_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(x: dict) -> bool:
    return x["n_words"] < LEAST_WORDS or 100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"]


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = a / max(a.sum(), 1), b / max(b.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0)))


def limit(pair: tuple[float, float], words: int) -> float:
    return pair[0] + pair[1] / max(words, 1) ** 0.5


def counted(docs: DataFrame, text_col="text", lang_col="lang") -> DataFrame:
    """(lang, word, n, classes): counts of words and of character classes of passing documents, in parts."""

    def run(batches):
        table = class_table()
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}

        def out():
            rows = [(lang, w.decode(), n, None) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, None, int(c.sum()), c.tolist()) for lang, c in classes.items()]
            words.clear()
            classes.clear()
            langs, names, ns, cs = zip(*rows) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(ns, pa.int64()), pa.array(cs, pa.list_(pa.int64()))],
                ["lang", "word", "n", "classes"],
            )

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                text = text.as_py()
                x = basic_counts(text)
                if base_failed(x):
                    continue
                words.setdefault(lang, Counter()).update(x["words"])
                classes[lang] = classes.get(lang, 0) + class_counts(text, table)
                if sum(map(len, words.values())) > FLUSH:
                    yield out()
        yield out()

    rows = small_batches(docs).select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[lang_col].cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, word string, n bigint, classes array<bigint>")


def references(docs: DataFrame, text_col="text", lang_col="lang") -> list[dict]:
    """One dictionary per language: lang, words and counts of the most common words, the count of all
    others, and counts of the character classes."""
    parts = stored(counted(docs, text_col, lang_col), "language-counts")
    words = stored(parts.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    # At most LEAST_SHARE words of a language can hold 1/LEAST_SHARE of its words each: so few are ranked.
    frequent = words.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, COMMON)
    best = frequent.where(F.col("n") * LEAST_SHARE >= F.col("total")).groupBy("lang", "total").agg(ranked.alias("best"))
    sums = [F.sum(F.coalesce(F.col("classes")[k], F.lit(0))).alias(f"c{k}") for k in range(N_CLASSES)]
    classes = parts.where("word IS NULL").groupBy(F.col("lang").alias("_lang")).agg(*sums)
    made = best.join(classes, F.col("lang").eqNullSafe(F.col("_lang"))).where(F.col("total") >= LEAST_REFERENCE)
    return [
        {
            "lang": r["lang"], "total": r["total"], "common": [x.word for x in r["best"]], "counts": [-x.n for x in r["best"]],
            "classes": [r[f"c{k}"] for k in range(N_CLASSES)],
        }
        for r in made.collect()
    ]


def judge(docs: DataFrame, refs: list[dict] | None = None, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, class_distance, word_distance (null
    where a distance does not count)."""
    refs = references(docs, text_col, lang_col) if refs is None else refs
    held = {
        r["lang"]: (
            {w.encode(): k for k, w in enumerate(r["common"])},
            np.array([*r["counts"], r["total"] - sum(r["counts"])], float),
            np.array(r["classes"], float),
        )
        for r in refs
    }
    rows = small_batches(docs).select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    )

    def run(batches):
        state = worker_state()
        if "class_table" not in state:
            state["class_table"] = class_table()
        table = state["class_table"]
        for b in batches:
            out = {k: [] for k in (*_COUNTS, "base_failed", "kept", "class_distance", "word_distance")}
            for text, lang in zip(b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                x = basic_counts(text)
                failed, ref = base_failed(x), held.get(lang)
                near = words = None
                if ref and not failed:
                    common, counts, classes = ref
                    near = distance(class_counts(text, table), classes)
                    if x["n_words"] >= WORD_GUARD:
                        bins = np.zeros(len(counts))
                        get = common.get
                        for w, n in Counter(x["words"]).items():
                            bins[get(w, -1)] += n
                        words = distance(bins, counts)
                bad = failed or (near is not None and near > limit(CLASS_LIMIT, x["n_words"])) or (words is not None and words > limit(WORD_LIMIT, x["n_words"]))
                for k in _COUNTS:
                    out[k].append(x[k])
                out["base_failed"].append(failed)
                out["kept"].append(not bad)
                out["class_distance"].append(near)
                out["word_distance"].append(words)
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["doc_id", *out]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, class_distance double, word_distance double")
