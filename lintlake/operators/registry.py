"""Model versions: save, load, list and retention."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION_SCHEMA = "model_name string, version string, path string, metadata string"


def save_model(model: PipelineModel, path: str, metadata: dict | None = None) -> None:
    """Save a fitted pipeline; metadata goes to ``<path>.meta`` as JSON."""
    model.write().overwrite().save(path)
    if metadata:
        spark = SparkSession.active()
        row = spark.createDataFrame([(json.dumps(metadata),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    try:
        model = PipelineModel.load(path)
    except Exception as problem:
        raise FileNotFoundError(f"Model not found: {path}") from problem
    try:
        text = spark.read.text(f"{path}.meta").first()
    except AnalysisException:
        text = None
    return model, json.loads(text[0]) if text else {}


def version_model(
    model: PipelineModel, base: str, name: str, metadata: dict | None = None, version: str | None = None
) -> str:
    """Save under a time-stamped version, register it and make it the latest. Returns its folder."""
    spark = SparkSession.active()
    version = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    folder = f"{base}/{name}/{version}"
    facts = {**(metadata or {}), "version": version, "model_name": name}
    save_model(model, f"{folder}/model", facts)
    entry = spark.createDataFrame([(name, version, f"{folder}/model", json.dumps(facts))], VERSION_SCHEMA)
    entry.coalesce(1).write.mode("overwrite").json(f"{folder}/entry")
    pointer = spark.createDataFrame([(version,)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{base}/{name}/latest")
    return folder


def list_versions(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Versions of a model, newest first; empty when there are none."""
    try:
        entries = spark.read.schema(VERSION_SCHEMA).json(f"{base}/{name}/*/entry")
    except AnalysisException:
        entries = spark.createDataFrame([], VERSION_SCHEMA)
    return entries.orderBy(F.desc("version"))


def load_latest(spark: SparkSession, base: str, name: str) -> PipelineModel:
    """The version the pointer names, else the newest one."""
    try:
        version = spark.read.text(f"{base}/{name}/latest").first()[0]
    except (AnalysisException, TypeError):
        newest = list_versions(spark, base, name).agg(F.max("version")).first()[0]
        if newest is None:
            raise FileNotFoundError(f"No versions found for model {name}") from None
        version = newest
    return load_model(spark, f"{base}/{name}/{version}/model")[0]


def retention(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Mark which versions of each model stay: the newest ``keep``."""
    newest = Window.partitionBy("model_name").orderBy(F.desc("version"))
    return versions.withColumn("kept", F.row_number().over(newest) <= keep)


def delete_old_versions(spark: SparkSession, base: str, name: str, keep: int = 3) -> list[str]:
    """Remove the folders of versions beyond the newest ``keep``; returns the removed versions."""
    old = retention(list_versions(spark, base, name), keep).where("NOT kept").select("version")
    removed = []
    for row in old.orderBy("version").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/{row.version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        removed.append(row.version)
    return removed
