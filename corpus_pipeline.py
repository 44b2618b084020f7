"""A corpus pipeline over the documents table: filter, deduplicate, mix and encode.

Each stage takes and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewatch.llm import bpe, exact, mixing, simhash, toxicity
from statewatch.llm.common import arrow_rows, plain, remainder
from statewatch.plans.durable import durable

#: The rank file's name in the folder of public tokenizers; ``STATEWATCH_RANKS`` may name another file.
RANKS = "byte_bpe_50k.tiktoken"
#: No source is drawn less than once, and none more than one and a quarter times.
MIX = mixing.Mix(repeats=1.25)


def ranks_path() -> str:
    import public_tokenizers

    return os.environ.get("STATEWATCH_RANKS") or public_tokenizers.path(RANKS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The lexicon is learned as in the toxicity query."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, marks, learn=remainder("doc_id", 3) != 1)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest id stays."""
    return exact.drop_exact_copies(docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_copies(docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat up to the limit of ``MIX``; every document stays."""
    words = F.regexp_count(plain("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return mixing.mix_sources(docs, "doc_id", "source", words, MIX).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), with the text they decode to."""
    found = bpe.encode_texts(docs, ranks_path(), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Fingerprints, learned weights and merge ranks are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with arrow_rows(spark):
            docs = durable(made, name, spark)
    return docs
