"""One query per operator over its whole table, with production parameters, and the pipeline."""

from __future__ import annotations

from lintlake.llm import (
    op1_warc, op2_toxicity, op3_packing, op4_maxent, op5_divergence, op6_simhash, op7_exact_dedup, op8_mixing, op9_quadratic, op10_sharding,
    op11_spelling, op12_repeats, op13_centroids,
)
from lintlake.llm.common import documents, labels
from lintlake.llm.oracles import SQL

TOKENIZER = "byte_bpe_50k.json"

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


@query
def op1_warc_dictionary(spark, folder):
    return op1_warc.archived(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op2_toxicity_grammar(spark, folder):
    return op2_toxicity.score(documents(spark, folder), labels(spark, folder))


@query
def op3_bin_slack_packing(spark, folder):
    import public_tokenizers

    return op3_packing.pack(documents(spark, folder), public_tokenizers.path(TOKENIZER))


@query
def op4_hashed_maxent(spark, folder):
    return op4_maxent.score(documents(spark, folder))


@query
def op5_divergence_rules(spark, folder):
    # The distances stay with the operator: floating sums differ in their last digits between engines.
    return op5_divergence.judge(documents(spark, folder)).drop("class_distance", "word_distance")


@query
def op6_simhash_near_dedup(spark, folder):
    return op6_simhash.components(documents(spark, folder))


@query
def op7_exact_dedup_index(spark, folder):
    docs = documents(spark, folder)
    return op7_exact_dedup.decisions(docs, op7_exact_dedup.new_index(spark), "documents")


@query
def op8_mixing_sources(spark, folder):
    return op8_mixing.mix(documents(spark, folder), carry=False)


@query
def op9_quadratic_quality(spark, folder):
    return op9_quadratic.score(documents(spark, folder), labels(spark, folder))


@query
def op10_sampled_splitters(spark, folder):
    return op10_sharding.shard(documents(spark, folder))


@query
def op11_frequency_trie(spark, folder):
    return op11_spelling.variants(documents(spark, folder))


@query
def op12_interval_expansion(spark, folder):
    return op12_repeats.removed(documents(spark, folder))


@query
def op13_threshold_centroids(spark, folder):
    return op13_centroids.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


__all__ = ["Q", "SQL"]
