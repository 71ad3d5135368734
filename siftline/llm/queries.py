"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bk_tree, byte_bpe, byte_cnn, containment, license_scan, link_graph, mpeg_audio, suffix_dedup, surrogates, token_counts
from siftline.llm.common import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
PASSPHRASE = "siftline"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(table(spark, sf_dir, "documents"))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = byte_cnn.train(docs.where(~byte_cnn.held_out(docs["doc_id"])))
    out = byte_cnn.predict(docs, model)
    return out.select("doc_id", byte_cnn.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk_tree.near_duplicates(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.anonymize(docs, surrogates.key_from(PASSPHRASE), marks=True)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.roundtrip_digest(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_graph.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_length=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_link_graph": link_graph.oracle(URL_RULES), "op10_containment": containment.oracle()}
