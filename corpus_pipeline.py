"""Documents through language ID, exact dedup, near-dedup, decontamination and BPE, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns the columns of documents; the last returns
token figures. ``run`` writes each stage's result to the shared folder and
reads it back, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loci.llm import bpe, decontaminate, exact_dedup, langid, simhash
from loci.llm.common import documents
from loci.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or no dictionary better than another."""
    return langid.identify(docs).where("NOT rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies stays."""
    return simhash.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of what is left."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Fingerprints, dictionaries and merges cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
