"""Corpus pipeline over the documents table: filter, deduplicate, decontaminate, pseudonymise, pack.

Each stage works on all rows its predecessor kept and returns them with the columns of
documents; the last returns packed pieces. ``run`` writes each stage's rows in the shared
folder and reads them again, so a lost executor never repeats more than a stage.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as each
operator's module states; null and empty texts pass all stages and are packed as the end
id alone.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, release, table
from tracewright.llm.decontaminate import without_leaks
from tracewright.llm.ngram_join import one_of_each
from tracewright.llm.packing import pack_documents
from tracewright.llm.pii import pseudonymize
from tracewright.llm.tokens import vocabulary_path
from tracewright.llm.toxicity import below, train

#: Documents that score this much are rejected.
TOXIC = 0.3


#: The setting that holds the secret key of pseudonyms.
PSEUDONYM_KEY = "spark.tracewright.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's secret key; without one a random key, whose pseudonyms link within this run alone."""
    named = spark.conf.get(PSEUDONYM_KEY, None)
    return named.encode() if named else os.urandom(32)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return below(docs, model, TOXIC)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    out = pseudonymize(docs, pseudonym_key(spark), counted=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return pack_documents(docs, vocabulary_path())


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL can express neither the trained scores nor the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = materialize(docs, f"pipeline-{name}")
            if before:
                release(spark, before)  # what the stage after next reads is written
            before = path
    return docs
