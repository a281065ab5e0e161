"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import forget, table, write_shared
from tidewheel.llm.mixing import mixed
from tidewheel.llm.packing import pack
from tidewheel.llm.quality_classifier import accepted
from tidewheel.llm.resemblance import near_copies
from tidewheel.llm.secret_scan import redacted
from tidewheel.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (SimHash and MinHash of five-word shingles, resemblance of 0.8) stays."""
    return one_of_each(docs, near_copies)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash", simhash),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the classifier, components over links, or the buckets' dynamic programming.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        before, docs = docs, write_shared(made, f"stage-{name}")
        forget(before)  # nothing reads a stage's table once the next one is written
