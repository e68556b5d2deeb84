"""The corpus pipeline: toxic documents go, then copies, near copies and benchmark leaks; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
documents, so a lost executor costs one stage at most. All but the last return the columns of ``documents``, extra ones
among them, whatever they are called.

In every stage null text counts as empty. An empty table gives an empty one. Rows that repeat are toxic or leaks all
together, and one of them stays after exact deduplication: the one with the smallest doc_id, a null one only where there
is no other. Empty texts score as texts without evidence, are copies of each other, hold no benchmark item and are
packed as one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oscilla.llm import decontam, exact, minhash, packing, queries, toxicity
from oscilla.llm.common import cleanup, durable, read_table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), queries.TOXIC_AT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Trained dictionaries, signatures and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = written()
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        cleanup(since=before, keep=1)  # what the stage wrote for itself, and what the one before left it
    return STAGES[-1][1](spark, docs, sf_dir)
