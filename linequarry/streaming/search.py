"""The stateless part of a search over a stream of lines or of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linequarry.operators.search import hit_columns, hits
from linequarry.plans.expression import Plan


def matching_lines(stream: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """Rows of the stream whose text, one line, matches, with column and preview."""
    return stream.where(plan.predicate(F.col(text))).select("*", *hit_columns(plan, text))


def hits_of_files(stream: DataFrame, keys: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """Hits of a stream of whole files; there is no order and no cap in a stream."""
    return hits(stream, keys, plan, text)


def text_stream(spark: SparkSession, directory: str) -> DataFrame:
    """path and text of the lines of files as they arrive in a directory."""
    return spark.readStream.option("lineSep", "\n").text(directory).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
