"""The corpus pipeline: quality rules -> language ID -> near-dedup -> source mix -> tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; the last returns one row of token ids and
digests for each document of the mix, as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mathgrade.llm import byte_bpe, language_id, mixing, near_dup, quality_rules
from mathgrade.llm.common import load, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy rejects go."""
    return quality_rules.keep(docs, quality_rules.POLICIES[quality_rules.CURRENT])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learnt language explains go. The models learn from this stage's input."""
    return language_id.keep(docs, language_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, as often as it takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document."""
    return byte_bpe.encode(docs)


STAGES = [("quality rules", quality), ("language ID", language), ("near-dedup", near_dedup), ("source mix", mix), ("byte BPE", tokens)]

#: Language models and the tokenizer have no SQL form; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
