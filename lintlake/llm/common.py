"""What several operators share: words, held-out rows, stored tables and state of a worker."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import stored

#: A word: a run without ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


#: Rows and bytes of a batch that is handed to Python: a task holds a few of them, so this bounds its
#: memory beside the JVM heap also where texts are long.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The table itself, after the session's Arrow batches are brought down to BATCH_ROWS and BATCH_BYTES;
    smaller settings are left alone."""
    conf = df.sparkSession.conf
    arrow = "spark.sql.execution.arrow"
    rows, size = int(conf.get(f"{arrow}.maxRecordsPerBatch")), conf.get(f"{arrow}.maxBytesPerBatch").rstrip("b")
    if not 0 < rows <= BATCH_ROWS:
        conf.set(f"{arrow}.maxRecordsPerBatch", str(BATCH_ROWS))
    if size.lstrip("-").isdigit() and not 0 < int(size) <= BATCH_BYTES:
        conf.set(f"{arrow}.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that further columns cannot clash; null text is empty."""
    return small_batches(docs).select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and what it keeps is missing beside
    the heap of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = worker_state().get("trim")
    if trim is None:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # not every C library has it
        worker_state()["trim"] = trim
    trim(0)


def cut(batch: pa.RecordBatch, column: int, most: int, trim: bool = True):
    """A batch in parts of about ``most`` bytes of a text column; with ``trim`` what is freed of a part is
    given back at once."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        if trim:
            give_back()
        at = to


def scalar_row(df: DataFrame):
    """The one row of a global aggregate: a few numbers, whatever the size of the input."""
    return df.collect()[0]


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for loaded vocabularies and caches."""
    name = "lintlake_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


__all__ = ["WORD", "cut", "documents", "give_back", "labels", "narrow", "remainder", "scalar_row", "small_batches", "stored", "worker_state"]
