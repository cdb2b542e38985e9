"""Registered queries of the llm operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gistmill.llm.common import read


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.quality import scored

    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.decontamination import findings

    return findings(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.search import self_search

    return self_search(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.warc import archived

    return archived(spark, read(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.secrets import scanned

    return scanned(read(spark, sf_dir, "documents")).drop("scores")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.mixing import mixed

    return mixed(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.url_filter import judged

    return judged(read(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.language_model import scored

    return scored(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.toxicity import scored

    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.jaccard_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"), k=3, percent=90)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from gistmill.llm.packing import digests, packed

    return digests(packed(read(spark, sf_dir, "documents"), path("word_bpe_49k.json")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistmill.llm.resampling import resampled

    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gistmill.llm.manifest import fifth, manifest

    return manifest(read(spark, sf_dir, "documents"), tampered=fifth(F.col("doc_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from gistmill.llm import jaccard_join, manifest, mixing, search, warc

    return {"op3_topk_search": search.oracle(), "op4_warc": warc.ORACLE, "op6_mixing": mixing.oracle(), "op10_ngram_jaccard_join": jaccard_join.oracle(), "op13_manifest": manifest.oracle()}
