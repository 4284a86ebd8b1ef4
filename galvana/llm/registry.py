"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, byte_bpe, chat, fingerprint, lm, packing, phrases, pipeline, quality, secrets, sharding, simhash, substrings, topk
from .common import table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_probe(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    own = (
        op1_simhash, op2_secrets, op3_packing, op4_topk, op5_fingerprint, op6_substrings, op7_byte_bpe, op8_quality, op9_lm, op10_hilbert,
        op11_phrases, op12_audit, op13_chat,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
