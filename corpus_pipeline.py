"""The corpus pipeline: language, near-duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return
the columns of ``docs``; the last returns the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.llm import decontam, langid, neardup, packing, secrets
from scrivenry.llm.common import Scratch, documents, dropped, stored
from scrivenry.llm.queries import tokenizer

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.  Rejected: null texts, texts without a letter, and texts of which no
    word and no n-gram was seen.  The language is learned from labelled rows of ``docs`` itself; without any, all
    documents are rejected.  Repeated rows are judged alike."""
    return langid.known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the one with the smallest doc_id.
    Rows repeated with doc_id and text stay once.  Documents without doc_id or words are in no group."""
    return neardup.deduplicated(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark keeps all."""
    return decontam.clean(docs, documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars counted anew; null texts stay null, with n_chars null."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, see ``packing.pack``."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: No stage is within SQL's reach; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, read = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as tables:  # what a stage wrote for itself goes when its result is stored
            before, docs = read, stored(stage(spark, docs, sf_dir), name)
            read = tables.paths[-1]
            tables.kept.add(read)
        if before:
            dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
