"""From raw documents to packed sequences: STAGES, and run() for all of them.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written to the shared folder before the
next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm import exact_dedup, mixing, near_copies, packing, toxicity
from tidemark.llm.common import only_kept, saved


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles or more) stays: the one with the smallest id."""
    return near_copies.keep_one(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None  # a trained network and a tokenizer are among the stages


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage saves on its way is deleted once its result is written, and that once the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with only_kept(spark) as kept:
        for name, stage in STAGES[:-1]:
            with only_kept(spark) as here:
                docs = saved(stage(spark, docs, sf_dir), name)
                here.append(docs)
        kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
