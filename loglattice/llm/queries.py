"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, lexical_search, licenses, mixing, near_dedup, packing, quality, revisits, secret_scan, sharding, substring_dedup, token_counts
from .common import table, tokenizer_path


def op1_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged headers as one string, name=value in order."""
    found = revisits.resolve_revisits(revisits.crawl_of(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(pairs, ";"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), size=50)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy decides, from the ledger's bits."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of the mix alone, which SQL can say."""
    goal = mixing.targets(mixing.source_sizes(mixing.sized(table(spark, sf_dir, "documents"))))
    return goal.withColumn("target", F.round("target", 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_resolve_revisits,
        op2_token_counts,
        op3_substring_dedup,
        op4_license_scan,
        op5_exact_dedup,
        op6_shard_rows,
        op7_mix_sources,
        op8_quality_rules,
        op9_pack_documents,
        op10_near_dedup,
        op11_find_secrets,
        op12_ranked_search,
        op13_filter_audit,
        quality_ablations,
        mixing_targets,
    )
}
