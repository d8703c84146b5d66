"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinder.llm import (
    decontaminate,
    divergence,
    edit_fingerprint,
    fill_middle,
    html_text,
    langid,
    license_scan,
    mixing,
    pii,
    quality_rules,
    sharding,
    simhash,
    toxicity,
)
from cinder.llm.common import documents, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_list(documents(spark, sf_dir))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.compare_next(documents(spark, sf_dir))


def op9_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edit_pairs(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.short_copies(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(documents(spark, sf_dir))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_edit_fingerprint": op9_edit_fingerprint,
    "op9_edit_pairs": op9_edit_pairs,
    "op10_decontamination": op10_decontamination,
    "op10_short_items": op10_short_items,
    "op11_fill_middle": op11_fill_middle,
    "op12_divergence": op12_divergence,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE = {
    "op8_sharding": sharding.oracle_sql(),
    "op10_decontamination": decontaminate.oracle_sql(),
    "op11_fill_middle": fill_middle.oracle_sql(),
    "op12_divergence": divergence.oracle_sql(),
    "op13_quality_rules": quality_rules.oracle_sql(),
}
