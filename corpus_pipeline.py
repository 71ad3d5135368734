"""The corpus pipeline: STAGES over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bk_tree, byte_bpe, byte_cnn, containment, surrogates
from siftline.llm.common import materialize, table
from siftline.llm.queries import BYTE_RANKS, PASSPHRASE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; it learns from the rows not held out."""
    model = byte_cnn.train(docs.where(~byte_cnn.held_out(docs["doc_id"])))
    return byte_cnn.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id."""
    return bk_tree.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.clean(docs, table(spark, sf_dir, "benchmark"), any_length=True)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in the place of personal data and secrets."""
    return surrogates.anonymize(docs, surrogates.key_from(PASSPHRASE))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the text that the ids decode to."""
    return byte_bpe.tokenize(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("replace_pii", replace_pii),
    ("encode", encode),
]

#: SQL can't express the classifier, the tokenizer library or the keyed surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
