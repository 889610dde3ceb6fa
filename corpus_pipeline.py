"""The corpus pipeline: documents pass the stages in order, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import bpe_backtrack, pivotal_mixing, rule_ensemble, simhash_anchors, surrogates
from lexlake.llm.common import table
from lexlake.llm.queries import word_vocabulary
from lexlake.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those it is given."""
    return rule_ensemble.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, found by SimHash anchors and compared by their five-word shingles."""
    return simhash_anchors.representatives(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with stand-ins for personal data and secrets; n_chars follows the text where it has changed."""
    out = surrogates.pseudonymised(docs)
    if "n_chars" in docs.columns:
        own = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_entities") > 0, F.char_length("text").cast(own)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return pivotal_mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe_backtrack.bpe_digests(docs, word_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("private_data", replace_private),
    ("mix", mix_sources),
    ("encode", encode),
]

# the stages draw at random, learn and hash in ways SQL cannot express
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
