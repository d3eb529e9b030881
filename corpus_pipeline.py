"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows of its predecessor. Null and empty texts, repeated
rows and empty tables go through as each operator defines for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe, line_dedup, mixing, near_dedup, quality
from tallyspark.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts are judged as empty ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in 10 documents or more go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id stays."""
    return near_dedup.near_duplicates(docs).where("kept").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, none more than twice, towards equal weights; every document is shown."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; decoded_sha256 is of what the ids decode to."""
    encoded = byte_bpe.encode(docs, *byte_bpe.public_ranks(), ids=True, digests=True, texts=False)
    return encoded.drop("ids_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: A classifier, sampling and merges by rank: not for SQL. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
