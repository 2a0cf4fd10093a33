"""The queries of the training-data operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_main, mixing, mpeg, pii, quality, secrets, sharding, simhash, toxicity
from .common import table


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(table(spark, sf_dir, "documents"))


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(table(spark, sf_dir, "documents"))


def op3_bpe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.main_text(pages, html_main.train(pages))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.with_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return book.withColumn("base_failed", F.expr(f"fail_bits & {quality.BASE} <> 0"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_assignment_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_anchors": op1_pii_anchors,
    "op2_mpeg_media": op2_mpeg_media,
    "op3_bpe_scan": op3_bpe_scan,
    "op4_noisy_channel_toxicity": op4_noisy_channel_toxicity,
    "op5_dom_boosting": op5_dom_boosting,
    "op6_quality_ledger": op6_quality_ledger,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_two_pass_shuffle": op9_two_pass_shuffle,
    "op10_assignment_lexer": op10_assignment_lexer,
    "op7_simhash_pigeonring": op7_simhash_pigeonring,
}

ORACLES: dict[str, str] = {"op6_quality_ledger": quality.ORACLE, "op8_pfair_mix": mixing.ORACLE}
