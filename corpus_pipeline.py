"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Null, empty and word-less texts pass the first four stages as they are and are packed as an end id.
Rows without a doc_id are judged like others: toxic ones, near copies and leaks among them go. Of rows
that repeat a doc_id and a text one stays; rows that repeat a doc_id with other texts are told apart.
An empty table gives an empty result. All stages but the last keep all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontaminate, jaccard, packing, secrets, toxicity
from webloom.llm.queries import table, tokenizer_path
from webloom.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token sequences of fixed length: a row for each piece with its place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("secret_scan", redact_secrets), ("best_fit_packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
