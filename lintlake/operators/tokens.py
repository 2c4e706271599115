"""Token ids, masks, truncation and token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.functions.ranks import quantile_map, quantile_of, quantiles_of_counts
from lintlake.session import stored

# Length limit, share of head lines and the mark left by truncation.
MAX_LENGTH = 512
TOKENS_PER_WORD, TOKENS_PER_LINE, HEAD_SHARE = 1.5, 15, 0.6
TRUNCATION_MARK = "... [TRUNCATED] ..."
PAD_ID, FIRST_ID, VOCABULARY = 1, 4, 50_000


def default_tokens(code: Column) -> Column:
    return X.tokens(F.coalesce(code, F.lit("")))


def token_ids(
    tokens: Column, max_length: int = MAX_LENGTH, pad_id: int = PAD_ID, vocabulary: int = VOCABULARY
) -> Column:
    """Hashed ids of a token array, capped and padded to ``max_length``."""
    capped = F.slice(tokens, 1, max_length)
    ids = F.transform(
        capped, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocabulary)) + FIRST_ID).cast("int")
    )
    return X.let(ids, lambda i: F.concat(i, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(i))))


def attention_mask(ids: Column, pad_id: int = PAD_ID) -> Column:
    return F.transform(ids, lambda i: (i != pad_id).cast("int"))


def tokenize(codes: DataFrame, max_length: int = MAX_LENGTH, tokens: Column | None = None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``; ``tokens`` may be any array of text."""
    source = default_tokens(F.col("code")) if tokens is None else tokens
    return codes.withColumn("input_ids", token_ids(source, max_length)).withColumn(
        "attention_mask", attention_mask(F.col("input_ids"))
    )


def truncate_code(code: Column, max_tokens: int = MAX_LENGTH) -> Column:
    """Keep the first 60 % and the last lines of code estimated longer than ``max_tokens``."""
    keep = int(max_tokens / TOKENS_PER_LINE)
    head = int(keep * HEAD_SHARE)
    tail = keep - head
    text = F.coalesce(code, F.lit(""))
    long = (X.word_count(text) * TOKENS_PER_WORD > max_tokens) & (X.line_count(text) > keep)

    def cut(rows: Column) -> Column:
        return F.concat(
            F.array_join(F.slice(rows, 1, head), "\n"),
            F.lit(f"\n{TRUNCATION_MARK}\n"),
            F.array_join(F.slice(rows, -tail, tail), "\n"),
        )

    return F.when(long, X.let(X.lines(text), cut)).otherwise(text)


def token_statistics(codes: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Min, max, mean and exact percentiles of token counts over a table.

    Every figure comes from the table of counts per length.
    """
    source = default_tokens(F.col("code")) if tokens is None else tokens
    lengths = codes.select(F.size(source).cast("double").alias("value"))
    counted = stored(lengths.groupBy("value").agg(F.count("*").alias("n")), "lengths")
    base = counted.agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    names = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = quantiles_of_counts(counted, list(names.values()))
    held = quantile_map(found.withColumn("name", F.lit("n")))
    return base.withColumn("_at", held).select(
        "min", "max", "mean", *[quantile_of(F.col("_at"), "n", q).alias(n) for n, q in names.items()]
    )
