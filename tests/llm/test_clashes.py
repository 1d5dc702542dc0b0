"""Every operator on documents, and every pipeline stage, on tables whose extra columns have the names that these use themselves, and on very long texts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nightloom.llm import alignment, common, idcodec, mixing, ngram_join, packing, prefixtrie, quality, sharding, substring, toxicity, urlfilter, warc
from nightloom.llm.queries import tokenizer_path

#: Names that operators give to columns of their own.
NAMES = """position file row f n ahead part bin first released offset opens sequence_id piece start length ids_crc32 _order _piece _rank _base _at _at0 _at1 shard slot grown_shard
    _gone _gone_id _gone_fp component key fp last salt _salt least rows score spans toxicity toxicity_spans n_words n_removed repeats cut cut_words cut_repeats _s _s1 _s2
    _source _begin _bytes _sum _ahead _p _p1 _p2 _p3 block phase release deadline text_fp id held_out predicted links pair times a b best row_number anchor window owner hash
    features band signature need value v t s seq digest word_chars kept base_failed stratum toxic quality""".split()


def _documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    take = lambda n: " ".join(words[i] for i in rng.integers(0, 300, n))
    base, passage = take(80), take(40)
    texts = [take(int(n)) for n in rng.integers(1, 120, 40)] + [base] * 3 + [f"{base} more"] + [f"{take(10)} {passage} {take(10)}" for _ in range(4)] + [None, "", " "]
    return spark.createDataFrame([(k, t, ["en", "de"][k % 2], ["x", "y", "z"][k % 3], len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def _labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 7 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")


def _rows(df, columns):
    return sorted(json.dumps([str(v) for v in r]) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tables(spark):
    plain = _documents(spark).cache()
    kinds = [F.lit("x"), F.lit(None).cast("bigint"), F.col("doc_id") % 3]
    return plain, plain.select("*", *[kinds[k % 3].alias(n) for k, n in enumerate(NAMES)]), plain.select("*", *[kinds[(k + 1) % 3].alias(n) for k, n in enumerate(NAMES)])


OPERATORS = {
    "quality": lambda d, labels: quality.judge_documents(d, labels),
    "toxicity": lambda d, labels: toxicity.score_documents(d, labels),
    "mixing": lambda d, labels: mixing.document_slots(d),
    "substring": lambda d, labels: substring.document_digests(d),
    "sharding": lambda d, labels: sharding.document_shards(d),
    "idcodec": lambda d, labels: idcodec.encode_documents(d, tokenizer_path("word_bpe_49k.json")),
    "packing": lambda d, labels: packing.pack_documents(d, tokenizer_path("byte_bpe_50k.json")).drop("sequence_id", "offset"),
    "ngram_join": lambda d, labels: ngram_join.join_documents(d),
    "alignment": lambda d, labels: alignment.align_documents(d, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_keep_to_their_columns(spark, tables, name):
    plain, *crowded = tables
    want = OPERATORS[name](plain, _labels(spark))
    rows = _rows(want, want.columns)
    for more in crowded:
        found = OPERATORS[name](more, _labels(spark))
        assert found.columns == want.columns and _rows(found, want.columns) == rows


@pytest.mark.parametrize("stage", ["ngram_jaccard", "substring_dedup", "mixing", "toxicity"])
def test_stages_return_the_columns_that_they_got(spark, tables, tmp_path, stage):
    plain, *crowded = tables
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    want = _rows(run(spark, plain, str(tmp_path)), plain.columns)
    for more in crowded:
        found = run(spark, more, str(tmp_path))
        assert found.columns == more.columns and found.schema.simpleString() == more.schema.simpleString() and _rows(found, plain.columns) == want
        kept = {r.doc_id: r for r in more.collect()}
        assert all(r[n] == kept[r.doc_id][n] for r in found.collect() for n in NAMES)


def test_assign_keeps_the_columns_of_a_user(spark, tables):
    _, more, _ = tables
    found = sharding.assign(more, "doc_id", {0: 1.0, 1: 1.0}, {0: 1.0, 1: 1.0, 2: 1.0})
    assert sorted(found.columns) == sorted(more.columns) and found.filter("slot IS NULL OR shard IS NULL").isEmpty()
    assert _rows(found, ["doc_id", "_order", "_piece", "_rank", "_base"]) == _rows(more, ["doc_id", "_order", "_piece", "_rank", "_base"])


def test_pages_and_conversations_keep_to_their_columns(spark):
    pages = spark.createDataFrame([(k, f"http://a{k % 3}.example.org/es/{k}", f"<p>{k % 4}{'x' * 120}</p>") for k in range(20)], "page_id long, url string, html string")
    talks = spark.createDataFrame([(k % 7, k // 7, "user", f"t {k % 3}") for k in range(40)], "conv_id long, turn long, role string, text string")
    names = ["host", "path", "rule", "verdict", "key", "block", "shard", "place", "bytes", "digest", "payload", "refers_to", "_key0", "_mask0", "pos", "depth", "f0", "p0", "a0", "d0", "n", "h", "head", "base", "part", "saved", "leaf", "top"]
    for made, table in ((urlfilter.judge_pages, pages), (warc.archive_pages, pages), (prefixtrie.trie, talks)):
        want = made(table)
        more = table.select("*", *[F.lit("z").alias(n) for n in names])
        assert _rows(made(more), want.columns) == _rows(want, want.columns)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"quality"}))
def test_texts_of_a_megabyte(spark, name):
    """Many words, one word, white space, and no word twice."""
    texts = [" ".join(f"w{k % 977}" for k in range(220_000)), "x" * 10**6, "\n \t" * 350_000, " ".join(map(str, range(150_000)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(9, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    found = OPERATORS[name](docs, _labels(spark)).collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3, 9}
    if name == "sharding":
        assert {r.doc_id: r.size for r in found} == {k: len(t) + 1 for k, t in enumerate(texts)} | {9: 4}
    if name == "substring":
        assert {r.doc_id: r.n_words for r in found} == {0: 220_000, 1: 1, 2: 0, 3: 150_000, 9: 2}


def test_fresh_names_begin_no_column():
    assert common.fresh(["A", "b"], "c") == "c" and common.fresh(["Cut_words", "x"], "cut") == "cut__" and common.fresh([], "a") == "a"
