"""A corpus from raw documents to packed sequences: each stage applies one
operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.llm import decontam, host_quality, line_dedup, packing, simhash
from uttermill.llm.common import table, written
from uttermill.llm.queries import tokenizer
from uttermill.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules or their host's verdict reject."""
    prepare(spark)
    return host_quality.keep_good(docs)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes all but the first occurrence of cross-site boilerplate lines."""
    prepare(spark)
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group."""
    prepare(spark)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    prepare(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4 096 tokens."""
    prepare(spark)
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_spread), ("simhash_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", sequences)]

#: SQL can't express fingerprints and token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage is written as
    Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
