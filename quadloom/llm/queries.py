"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import bpe, hard_negatives, kneser_ney, licenses, media, packing, page_text, quality_classifier, quality_rules, ranked_search, simhash, token_store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.contract(_table(spark, sf_dir, "documents")).drop("perplexity")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = token_store.write(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_store.read(spark, uri, with_ids=False).drop("ids")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.store_and_read(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.contract(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.contract(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.contract(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_media_columns": op6_media_columns,
        "op7_token_store": op7_token_store,
        "op8_license_scan": op8_license_scan,
        "op9_packing": op9_packing,
        "op10_warc": op10_warc,
        "op11_ranked_search": op11_ranked_search,
        "op12_page_text": op12_page_text,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": warc.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
