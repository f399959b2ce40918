"""A corpus pipeline: quality rules, near-duplicate removal, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept, and all but
the last return the columns of documents. run() writes each stage's result to the shared folder and reads it again.
A document that the mix takes several times is repeated, with its own doc_id, and one that it doesn't take is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.llm import op3_rules, op7_secrets, op8_mix, op9_pack, op10_jaccard
from lattis.llm.work import documents, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go; a null text has no words and goes. Repeated rows are judged alike."""
    return op3_rules.filter_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, one with its smallest id (rows without an id come last in this)."""
    return op10_jaccard.dedupe(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with the secrets in their texts struck out; a null text stays null."""
    return op7_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken one by one, whatever their ids; those without words and those that the mix leaves out are dropped."""
    return op8_mix.take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, with its bin; a null text is one token."""
    return op9_pack.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]
#: The Jaccard join, the forest, the subset sums and best-fit can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
