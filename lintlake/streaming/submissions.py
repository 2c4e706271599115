"""Streams: submissions analysed as they arrive, and statistics kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.plans.analysis import analyze
from lintlake.sources.report_store import append_reports, compact_when_due


def analyze_stream(
    submissions: DataFrame,
    reports_path: str,
    checkpoint: str,
    name: str = "stream",
    available_now: bool = True,
    compact_at: int | None = None,
) -> StreamingQuery:
    """Append one report per streamed snippet to the reports table.

    The analysis has no state, so it runs unchanged on the stream. Each micro-batch is a load
    named by its number: a batch repeated after a failure replaces itself. ``compact_at``: compact the
    store whenever so many loads wait, so that searches by id stay quick while the stream runs.
    """

    def store(batch: DataFrame, number: int) -> None:
        append_reports(batch, reports_path, f"{name}-{number}")
        if compact_at:
            compact_when_due(batch.sparkSession, reports_path, compact_at)

    writer = analyze(submissions).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stats_stream(
    reports: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Count and mean probability per risk level over all reports so far, after each batch.

    State is one row per risk level.
    """
    stats = reports.groupBy("risk_level").agg(
        F.count("*").alias("analyses"), F.avg("bug_probability").alias("average_bug_probability")
    )
    writer = stats.writeStream.outputMode("complete").foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
