"""Search terms, from an argument or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def argument_terms(spark: SparkSession, argument: str) -> DataFrame:
    """term: the distinct parts of a comma-separated argument; empty ones don't count."""
    return spark.createDataFrame([(x,) for x in dict.fromkeys(argument.split(",")) if x], "term string")


def file_terms(spark: SparkSession, path: str) -> DataFrame:
    """term: the distinct lines of a file; empty ones don't count."""
    return spark.read.option("lineSep", "\n").text(path).filter("value != ''").select(F.col("value").alias("term")).distinct()
