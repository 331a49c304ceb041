"""From raw documents to training shards: five stages, each an operator of ``murmur.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontaminate, mixing, simhash, toxicity, training_order
from murmur.llm.common import stored
from murmur.llm.queries import TOKENIZERS, table, toxic_model

# The last stage's result depends on trained weights, hashes and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject(docs, toxic_model(spark, docs, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which words of a benchmark item are hit go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"), size=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares, in a global random order."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order."""
    encoder = training_order.byte_pair_encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return training_order.materialise(docs, encoder)


STAGES = [
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", output_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
