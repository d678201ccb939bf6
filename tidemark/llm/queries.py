"""The registered queries op1 to op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, license_scan, mixing, packing, pii, secret_scan, simhash, substring, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    """Documents taken to the target words of their sources."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    """The five nearest rows of every fiftieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_substring(spark, sf_dir):
    """What is left of each text without passages that occur earlier."""
    return substring.dedup(_table(spark, sf_dir, "documents")).drop("kept", "repeats")


def op4_toxicity(spark, sf_dir):
    """Toxicity of every text."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark, sf_dir):
    """Secrets in every text, by kind and place."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    """Fingerprints and their components."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    """License phrases and notices in every text."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    """Every text with surrogates for its entities."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_top_k, op3_substring, op4_toxicity, op5_secret_scan, op6_simhash, op7_exact_dedup, op8_license_scan, op9_packing, op10_pii)}
ORACLES = {"op2_top_k": topk.ORACLE, "op3_substring": substring.ORACLE, "op5_secret_scan": secret_scan.oracle(), "op7_exact_dedup": exact_dedup.ORACLE, "op8_license_scan": license_scan.oracle()}
