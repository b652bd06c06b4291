"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, with_offsets

    pieces = pack(read_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_offsets(pieces).drop("slot")


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digests

    return pii_digests(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(read_table(spark, sf_dir, "documents"))


def op4_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import rollup_documents

    return rollup_documents(read_table(spark, sf_dir, "documents"))


def op5_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprints_with_neighbours

    return fingerprints_with_neighbours(read_table(spark, sf_dir, "documents"))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(read_table(spark, sf_dir, "documents"))


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_text import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"))


def op10_near_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import near_classes

    return near_classes(read_table(spark, sf_dir, "documents")).drop("text_key", "head_key")


def op11_centroid_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings")).drop("by_integers")


def op12_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_pairs import pair_digests

    return pair_digests(read_table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OPERATORS = (op1_packing_nnls, op2_pii_bootstrap, op3_sentencepiece_agenda, op4_token_ledger, op5_simhash_blocks, op6_quality_outliers, op7_site_templates, op8_license_diagonals, op9_url_rules, op10_near_bayes, op11_centroid_screen, op12_pair_index, op13_target_resampling)
QUERIES = {f.__name__: f for f in OPERATORS}
