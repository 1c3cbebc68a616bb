"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm import jaccard_join, line_dedup, packing, pii, quality_rules, scratch
from netquarry.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept.

    A null or blank text fails the base and goes; equal rows are judged alike; an empty table gives no row. Columns keep
    their values whatever their names, in this stage and the next three.
    """
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines but the first of each; those that lose all their lines go.

    A null text has no line and stays; rows equal in doc_id and text count once and are treated alike; of places that tie
    by doc_id the one of the least text hash and line number stays; an empty table gives no row.
    """
    return line_dedup.dedupe(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 and above, the one of the least doc_id.

    A null text, one without words and a row without a doc_id are linked with nothing and stay; rows that share the least
    doc_id all stay; an empty table gives no row.
    """
    return jaccard_join.keep_one(docs, 5, 80, 100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced.

    A null text stays null, a text without spans stays as it is, rows equal in doc_id and text get the same text, and an
    empty table gives no row. Of overlapping spans the one that starts first gives the kind.
    """
    return pii.clean(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids (little-endian unsigned 16-bit), packed into sequences of 4096 tokens.

    A null or empty text has the end id alone; a text longer than a sequence is cut; rows that share a doc_id are documents
    of their own; equal pieces are ranked in any order; other columns are left out; an empty table gives no row.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2, keep_ids=2)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("packing", sequences),
]

#: Weighed votes, templates and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's table goes once the next one's is written; the last serves the result."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        scratch.drop(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
