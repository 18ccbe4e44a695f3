"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, dialogs, gif, langid, lexical, licenses, packing, quality, secrets, shards, simhash, toxicity, warc
from .common import documents, labels, table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged_documents(documents(spark, sf_dir))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_documents(documents(spark, sf_dir))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded_documents(documents(spark, sf_dir))


def op5_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op6_language_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified_documents(documents(spark, sf_dir))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned_documents(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed_documents(documents(spark, sf_dir))


def op10_exact_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


def op13_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_gif_media": op2_gif_media,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_ring_shards": op4_ring_shards,
    "op5_merge_replay": op5_merge_replay,
    "op6_language_machines": op6_language_machines,
    "op7_markov_secrets": op7_markov_secrets,
    "op8_simhash": op8_simhash,
    "op9_license_digests": op9_license_digests,
    "op10_exact_fit_packing": op10_exact_fit_packing,
    "op11_norm_buckets": op11_norm_buckets,
    "op12_warc_archives": op12_warc_archives,
    "op13_dialog_repair": op13_dialog_repair,
}

ORACLE_SQL: dict[str, str] = {"op1_line_frequency": quality.ORACLE, "op9_license_digests": licenses.oracle(), "op11_norm_buckets": lexical.ORACLE, "op12_warc_archives": warc.ORACLE}
