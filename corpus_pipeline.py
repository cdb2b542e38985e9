"""Corpus pipeline: stages over documents, each written as Parquet and read again.

run(spark, sf_dir) applies STAGES to the table documents.  All stages but the last
return the columns of documents; the last returns what the mix takes of each
document.  Trained and near-duplicate stages have no SQL form, so ORACLE_SQL is
None and tests compare the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gistmill.llm import decontamination, jaccard_join, mixing, secrets, toxicity
from gistmill.llm.common import read, table
from gistmill.workers import give_back

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _frugal(stage: Stage) -> Stage:
    """The stage, with workers that give memory back, also where it runs by itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by 5-word shingles at 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text; every document stays."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", _frugal(drop_toxic)),
    ("ngram_jaccard_join", _frugal(drop_near_copies)),
    ("decontamination", _frugal(drop_contaminated)),
    ("secret_scans", _frugal(redact_secrets)),
    ("mixing", _frugal(mix_sources)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage-{name}")
    return docs
