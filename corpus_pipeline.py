"""The corpus pipeline: documents through toxicity, near duplicates, repeated substrings, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next
one. All but the last return the columns of documents; every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import mixing, ngram_join, packing, substring, toxicity
from nightloom.llm.common import fresh, materialize, read_table
from nightloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half, by a model of the labels outside of the held-out fold."""
    model = toxicity.train(toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    own = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, own, f"{own}_spans").filter(F.col(own) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id; documents without words all stay."""
    return ngram_join.keep_one(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has; n_chars follows the text."""
    own = fresh(docs.columns, "cut")
    cut = substring.cut_repeats(docs, names=(f"{own}_words", own, f"{own}_repeats"))
    return cut.withColumn("n_chars", F.when(F.col(own) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed to their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; sequences follow the order in which the mixture was written, stretch by stretch."""
    placed, position = packing.in_written_order(docs)
    return packing.pack_documents(placed, tokenizer_path("byte_bpe_50k.json"), position=position)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_substrings),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained chain and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
