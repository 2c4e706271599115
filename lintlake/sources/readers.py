"""Readers of code files, labels, feature tables and splits."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lintlake.functions.ranks import with_scan_index
from lintlake.functions.text import is_blank
from lintlake.operators.parse import language_of_path
from lintlake.schemas import CODE, LABELLED_CODE, SUBMISSIONS


def source_files(spark: SparkSession, glob: str, language: str | None = None) -> DataFrame:
    """Source files as whole text, invalid UTF-8 replaced; language by extension unless given.

    Files with an unknown extension have a null language; ``rejected_files`` lists them.
    ``is_empty`` marks files of white space only.
    """
    files = spark.read.format("binaryFile").load(glob)
    path = F.col("path")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    # Text mode reading turns every line end into a newline.
    code = F.regexp_replace(text, "\r\n?", "\n")
    named = F.lit(language) if language else language_of_path(path)
    return files.select(
        F.sha2(path, 256).alias("file_id"),
        path,
        named.alias("language"),
        code.alias("code"),
        F.lit(None).cast("int").alias("target"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("commit_id"),
    ).withColumn("is_empty", is_blank(F.col("code")))


def rejected_files(files: DataFrame) -> DataFrame:
    return files.where("language IS NULL").select("file_id", "path")


def labelled_code(spark: SparkSession, path: str) -> DataFrame:
    """Labelled code lines with their line number; a bad line keeps ``_corrupt_record``."""
    schema = T.StructType([*LABELLED_CODE.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = with_scan_index(spark.read.text(path), "line")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("line", parsed.alias("r")).select("line", "r.*")


def code_table(labelled: DataFrame, language: str = "python") -> DataFrame:
    """Labelled code as a table of source files."""
    key = F.concat_ws("_", "project", "commit_id")
    made = labelled.select(
        key.alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit(language).alias("language"),
        F.col("func").alias("code"),
        "target",
        "project",
        "commit_id",
    )
    return made.select(*CODE.fieldNames())


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission metadata with the position of each line in ``line``."""
    names = SUBMISSIONS.fieldNames()
    table = spark.read.option("header", True).csv(path).select(*names)
    return with_scan_index(table, "line")


def feature_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.csv`` directly under a folder, columns united by name.

    Spark maps the columns of one CSV read by position, so files are grouped by their first line, found
    for all of them in one job, and each group is one scan. The number of jobs depends on the number of
    different first lines, not of files; the driver holds the names of the files, as any scan's does.
    Files without a line are skipped; a folder without files gives an empty table.
    """
    united = None
    for files in _files_by_header(spark, folder):
        part = spark.read.option("header", True).option("inferSchema", True).csv(files)
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], T.StructType([])) if united is None else united


def _files_by_header(spark: SparkSession, folder: str) -> list[list[str]]:
    """The files of each first line, in the order of the lines."""
    try:
        lines = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    except AnalysisException:
        return []
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), place.alias("place"))
    first = lines.where(~is_blank(F.col("value"))).groupBy("path").agg(F.min_by("value", "place").alias("header"))
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return [[_as_given(f) for f in r.files] for r in grouped.orderBy("header").collect()]


def _as_given(location: str) -> str:
    """The path of a file's location, with the signs of patterns taken literally."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(location))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset: Parquet by suffix, else CSV."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def train_and_validation(spark: SparkSession, train: str, val: str) -> tuple[DataFrame, DataFrame]:
    """Two splits: CSV by suffix, else Parquet."""

    def one(path: str) -> DataFrame:
        if path.endswith(".csv"):
            return spark.read.option("header", True).option("inferSchema", True).csv(path)
        return spark.read.parquet(path)

    return one(train), one(val)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "embedding")
