"""The corpus pipeline: from raw documents to packed token sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. Rejected documents go, near duplicates leave one of each group, secrets are
replaced in the texts, and what remains is tokenised and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import language_id, packing, quality, secrets, simhash
from docketry.llm.common import materialise
from docketry.llm.queries import pattern, read, tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unknown or ambiguous language go."""
    return language_id.keep_identified(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or are probably bad go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id."""
    return simhash.first_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by the name of their kind; n_chars follows."""
    return secrets.redact(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages learn models and use vocabularies, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
