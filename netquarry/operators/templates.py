"""Line templates: the kinds of a line's addresses in order, and matching by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import found, template
from .search import small


def with_template(lines: DataFrame, dialect: str = "ref") -> DataFrame:
    # Never null, or a join on it would put a filter that repeats the extraction below itself.
    return lines.withColumn("template", F.coalesce(template(found("text", dialect)), F.lit("")))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """template: the distinct lines of a file; lines that begin with # are comments."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.col("value").alias("template")).distinct()


def sample_templates(lines: DataFrame, dialect: str = "ref") -> DataFrame:
    """template: those of sample lines; comments don't count."""
    return with_template(lines.filter(~F.startswith("text", F.lit("#"))), dialect).select("template").distinct()


def match(lines: DataFrame, templates: DataFrame, dialect: str = "ref") -> DataFrame:
    """Lines whose template is one of templates."""
    return with_template(lines, dialect).join(small(templates.select("template").distinct()), "template", "left_semi")


def template_counts(lines: DataFrame, dialect: str = "ref") -> DataFrame:
    """template and the number of lines that have it."""
    return with_template(lines, dialect).groupBy("template").agg(F.count(F.lit(1)).alias("lines"))
