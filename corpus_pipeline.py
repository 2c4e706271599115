"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, folder of the tables) and works on all that its predecessor kept. All but
the last return the columns of documents, further columns included; an empty table stays empty.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from lintlake.llm import op3_packing, op6_simhash, op7_exact_dedup, op8_mixing, op9_quadratic  # noqa: E402
from lintlake.llm.common import documents, labels  # noqa: E402
from lintlake.session import stored  # noqa: E402

TOKENIZER = "byte_bpe_50k.json"


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier (learned from the labelled ones among them) accepts. A null text is
    judged as an empty one, and one without an id like any other; of rows that repeat each other all or none
    stay; without labels of both kinds all stay."""
    return op9_quadratic.accepted(docs, labels(spark, sf_dir))


def exact(spark, docs, sf_dir):
    """One document of every text: that with the largest id, null ids last; null and empty texts are one text, and
    rows that repeat id and text are one document."""
    return op7_exact_dedup.survivors(docs, op7_exact_dedup.new_index(spark), "pipeline")


def near(spark, docs, sf_dir):
    """One document of every component of near-duplicates: that with the smallest id, null ids last. Texts without
    a word are alike; rows of one id and different texts are judged for themselves. Fingerprints link as in
    ``op6``: three words, three bits; README says what share of pairs of a given similarity that reaches."""
    return op6_simhash.survivors(docs)


def mixing(spark, docs, sf_dir):
    """Every document as often as the mix takes it, whole: twice at most. A document without a word is never
    taken; a null source is a source of its own; null and repeated ids are drawn by their texts."""
    return op8_mixing.mixed(docs)


def packing(spark, docs, sf_dir):
    """Pieces of token sequences. A document that the mix takes twice is packed twice: its pieces come twice."""
    return op3_packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: The classifier, fingerprints and packing are not SQL; tests/llm/test_pipeline.py holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
