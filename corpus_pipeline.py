"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold benchmark passages
go, sources are mixed to target weights, and what is left becomes token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ontoweave.llm import decontamination, mixing, simhash, tokens, toxicity
from ontoweave.llm.common import table, written
from ontoweave.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that a model of the labels, but for the held-out ones, holds for toxic are rejected."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component the document with the smallest id stays."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a passage of a benchmark item are rejected."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are sampled by probabilities that fit the target shares of sources, languages and forms."""
    return mixing.sampled(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids go into directly addressable files in order of doc_id; a row per document as read back."""
    ship(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_output(docs, path, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Trained models, hashes and a tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
