"""The registered queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their oracle SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, exact_dedup, html_text, jaccard_join, language_id, mixing, period_runs, secrets, simhash, url_filter, vector_search,
    warc_fixity, whitening)
from .common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    """The rank file of the BPE queries: $BYTE_BPE_RANKS, or that of the installed public vocabularies."""
    given = os.environ.get("BYTE_BPE_RANKS")
    if given:
        return given
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; the html is not read."""
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page.page_id", "host", "path", "rule", "verdict", "blocked_chance")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vec_id divisible by 50."""
    return vector_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), rank_file())


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, with what the audit against a damaged replica says of it."""
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.audit(warc_fixity.manifest(pages), warc_fixity.manifest(warc_fixity.aged(pages)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    whitened = whitening.components(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))       # null where a long cannot hold it


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.cluster(_table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them with a planted period."""
    return period_runs.detect(_table(spark, sf_dir, "documents"), plant=True, texts=False)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_url_filter, op3_vector_search, op4_language_id, op5_source_mixing, op6_byte_bpe, op7_warc_fixity,
    op8_secret_scan, op9_simhash_near_dedup, op10_html_extraction, op11_embedding_whitening, op12_jaccard_join, op13_period_runs)}

ORACLE_SQL = {"op1_exact_dedup": exact_dedup.ORACLE, "op5_source_mixing": mixing.ORACLE, "op7_warc_fixity": warc_fixity.ORACLE,
              "op12_jaccard_join": jaccard_join.ORACLE}
