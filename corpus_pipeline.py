"""Corpus pipeline: toxic documents go, one document of each group of near-duplicates stays, personal
data is replaced, sources are mixed to their target weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the digests of the encoding.  The mix takes a document as
often as its source's target asks for, so a document may then be there twice.  No stage is
expressible in SQL; a test holds the stages against the operators they call, the encoding by count and
columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, mixing, near_dedup, pii, toxicity
from waymark.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "text"), output="digests").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written once for the next, and goes when that one has been written."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if before:
                scratch.drop(*before)
            before = [docs]
    return docs
