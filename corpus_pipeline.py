"""The corpus pipeline: documents in, a weighted training mixture out.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes each stage's rows as
Parquet below the shared folder and hands the reread table to the next one. Columns are those of
documents throughout; extra columns pass through, and null texts go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import decontamination, languages, mixing, near_copies, secrets
from slotwise.llm.common import kept
from slotwise.llm.registry import table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known main language go."""
    return languages.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in four fifths of their five-word shingles, the one with the smallest doc_id stays; SimHashes in
    Gray order propose the nearest of them, min-hash keys the others."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more repeats benchmark passages go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; stretches that hold a secret are replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as the target weights of their source ask for."""
    return mixing.mixture(docs)


STAGES = [
    ("languages", identify_languages),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Mixture inference and the near-copy search can't be stated in SQL; tests hold each stage against its operator or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
