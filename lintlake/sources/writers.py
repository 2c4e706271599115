"""Writers of datasets, metrics, embeddings, experiment logs and reports."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.operators.metrics import METRIC_COLUMNS
from lintlake.schemas import STORED_REPORT
from lintlake.sources.report_store import append_reports, read_reports


def save_dataset(df: DataFrame, path: str, format: str = "csv") -> str:
    """Write CSV (with header) or Parquet; the suffix is added when missing. Returns the path."""
    kind = format.lower()
    if kind not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format: {format}")
    if not path.endswith(f".{kind}"):
        path = f"{path}.{kind}"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    return path


def save_code_lines(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)


def save_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select(
        F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")
    ).write.mode("overwrite").parquet(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON document per file with every metric."""
    return metrics.select("file_id", F.to_json(F.struct(*METRIC_COLUMNS)).alias("json"))


def _entry_rows(name: str) -> Column:
    return F.transform(
        F.map_entries(name),
        lambda e: F.struct(
            F.concat(F.lit(f"{name}."), e["key"]).alias("metric"),
            e["value"].cast("string").alias("value"),
        ),
    )


def metrics_rows(metrics: DataFrame) -> DataFrame:
    """Metrics as (metric, value) rows: maps become ``name.key``, lists are joined by ``; ``."""
    pieces = []
    for name in METRIC_COLUMNS:
        kind = metrics.schema[name].dataType
        if isinstance(kind, T.MapType):
            entries = _entry_rows(name)
        else:
            text = (
                F.array_join(name, "; ")
                if isinstance(kind, T.ArrayType)
                else F.col(name).cast("string")
            )
            entries = F.array(F.struct(F.lit(name).alias("metric"), text.alias("value")))
        pieces.append(entries)
    return metrics.select("file_id", F.inline(F.concat(*pieces)))


def create_reports_table(spark: SparkSession, name: str, path: str) -> None:
    """Create the reports table over the loads at ``path`` when it does not exist, and list them. It shows
    the loads as they were appended; ``create_reports_view`` shows the store without deleted reports, also
    after a compaction."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED_REPORT.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY (load_id, language) LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def create_reports_view(spark: SparkSession, name: str, path: str) -> None:
    """The live reports of a store as a view of the session, as they are now."""
    read_reports(spark, path).createOrReplaceTempView(name)


def log_experiment(
    spark: SparkSession, model: str, parameters: dict, metrics: dict, path: str
) -> str:
    """Append one experiment record; returns its id of eight hex digits."""
    experiment = uuid4().hex[:8]
    record = [
        (
            experiment,
            datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S"),
            model,
            {k: json.dumps(v) for k, v in parameters.items()},
            {k: float(v) for k, v in metrics.items()},
        )
    ]
    schema = (
        "experiment_id string, timestamp string, model string, parameters map<string,string>, "
        "metrics map<string,double>"
    )
    spark.createDataFrame(record, schema).write.mode("append").json(path)
    return experiment


def save_results(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def save_tuning_results(trials: DataFrame, path: str) -> None:
    """Best value, its parameters and the number of trials."""
    best = trials.agg(
        F.max("value").alias("best_value"),
        F.max_by("params", "value").alias("best_params"),
        F.count("*").alias("n_trials"),
    )
    best.write.mode("overwrite").json(path)


__all__ = [
    "append_reports",
    "create_reports_table",
    "create_reports_view",
    "log_experiment",
    "metrics_json",
    "metrics_rows",
    "save_code_lines",
    "save_dataset",
    "save_embeddings",
    "save_results",
    "save_tuning_results",
]
