"""The queries of this subpackage, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, idcodec, images, mixing, ngram_join, packing, prefixtrie, quality, sharding, substring, toxicity, urlfilter, warc
from .common import read_table


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.embedding_images(read_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op5_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_slots(read_table(spark, sf_dir, "documents"))


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.document_digests(read_table(spark, sf_dir, "documents"))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_table(spark, sf_dir, "documents"))


def op8_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcodec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read_table(spark, sf_dir, "documents"))


def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(read_table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_descriptors": op3_descriptors,
    "op4_warc": op4_warc,
    "op5_pfair": op5_pfair,
    "op6_seed_extend": op6_seed_extend,
    "op7_rendezvous": op7_rendezvous,
    "op8_range_coder": op8_range_coder,
    "op9_best_fit": op9_best_fit,
    "op10_partenum": op10_partenum,
    "op11_token_spans": op11_token_spans,
    "op12_bloom_cascade": op12_bloom_cascade,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": quality.QUALITY_SQL,
    "op4_warc": warc.ARCHIVE_SQL,
    "op6_seed_extend": substring.SUBSTRING_SQL,
    "op7_rendezvous": sharding.SHARDS_SQL,
    "op10_partenum": ngram_join.JACCARD_SQL,
    "op12_bloom_cascade": urlfilter.URL_SQL,
    "op13_prefix_trie": prefixtrie.TRIE_SQL,
}
