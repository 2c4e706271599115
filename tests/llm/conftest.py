import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source); with columns whose names clash with results."""

    def make(rows):
        full = [(*r, *("s0",) * (3 - len(r))) for r in rows]
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in full], SCHEMA)
        extra = ["size", "kept", "keep_id", "score", "key", "digest", "row", "label", "fp", "shard", "token", "text_crc32"]
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(f"extra {c}") for c in extra})

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "Ä ß x €"), (7, "word " * 60_000),
    (8, "same text here again"), (9, "same text here again"), (9, "same text here again"), (None, "same text here again"),
    (None, None), (10, "line\nline\nline"), (11, "x" * 200_000), (12, "one two three four five six seven"),
    (13, "One two three four five six seven"),
]
