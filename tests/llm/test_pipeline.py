"""Every stage of the pipeline against brute force on what its predecessor kept, on a table with copies, nulls, empty and repeated rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nightloom.llm import mixing, packing, toxicity
from nightloom.llm.common import read_table

from test_operators import brute_components, brute_substrings, corpus, path, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels: those of the smallest table, and odd rows beside them."""
    folder = str(tmp_path_factory.mktemp("sf"))
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    odd = [(100_000 + k, t, None, ["a", None][k % 2], None if t is None else len(t)) for k, t in enumerate(corpus(3, 40))]
    odd += [(100_500, "same words again and again in one text", "en", "a", 38)] * 2 + [(None, "a text of unknown id", "en", "a", 20), (None, None, None, None, None)]
    given.unionByName(spark.createDataFrame(odd, SCHEMA)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def kept_texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def plain_score(model, text):
    """The document score by a plain forward-backward over its words."""
    odds = [math.exp(max(-30, min(30, model.unary(w)))) for w in words_of(text)]
    best = total = 0.0
    if odds:
        start, stay, enter, leave = (math.exp(x) for x in model.chain)
        step = np.array([[1.0, enter], [leave, stay]])  # from clean, from toxic
        forward = [np.array([1.0, start * odds[0]])]
        for o in odds[1:]:
            f = forward[-1] @ step * np.array([1.0, o])
            forward.append(f / f.sum())
        back = [np.ones(2)]
        for o in reversed(odds[1:]):
            b = step @ (np.array([1.0, o]) * back[-1])
            back.append(b / b.sum())
        p = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, reversed(back))]
        best, total = max(p), sum(p)
    return float(model.document_scores(np.array([best]), np.array([total]))[0])


def test_stages_equal_brute_force(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "best_fit_packing"]
    docs = read_table(spark, tables, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, tables), name)
        assert docs.columns == columns
        kept.append(docs)
    before = read_table(spark, tables, "documents")
    model = toxicity.train(toxicity.training_sample(before, read_table(spark, tables, "labels")))
    assert kept_texts(kept[0]) == Counter({k: n for k, n in kept_texts(before).items() if plain_score(model, k[1]) < 0.5})
    # One of each group of near copies; rows of one id and text are one document.
    rows = kept_texts(kept[0])
    number = {k: i for i, k in enumerate(sorted(rows, key=lambda k: (k[0] is None, k[0] or 0)))}
    parts = brute_components([(i, k[1]) for k, i in number.items()])
    assert kept_texts(kept[1]) == Counter({k: n for k, n in rows.items() if parts[number[k]][1] == number[k]})
    # What a smaller document has goes from the others; rows without an id stay as they are.
    rows = kept_texts(kept[1])
    cut = brute_substrings([k for k in rows if k[0] is not None])
    found = {d: words_of(t) for d, t in kept_texts(kept[2]) if d is not None}
    assert found == {d: words for d, (_, _, words) in cut.items()} and sum(n for _, n, _ in cut.values()) > 0
    assert {k: n for k, n in kept_texts(kept[2]).items() if k[0] is None} == {k: n for k, n in rows.items() if k[0] is None}
    # The order of the mixture, nothing lost.
    assert kept_texts(kept[3]) == kept_texts(kept[2])
    slot = {(r.doc_id, r.source): r.slot for r in mixing.schedule_documents(kept[2]).select("doc_id", "source", "slot").collect()}
    order = [slot[r.doc_id, r.source] for r in mixing.mix(kept[2]).collect()]
    assert order == sorted(order)
    # Whole documents in sequences that hold them.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[3], tables).collect()
    want = Counter()
    for (d, text), n in kept_texts(kept[3]).items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        starts = [0, *range(first, len(ids), 2048)]
        for piece, start in enumerate(starts):
            end = first if piece == 0 else start + 2048
            want[d, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4"))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1 + 1.01 * packing.lower_bound(np.array([r.length for r in packed]), 2048)


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        read_table(spark, tables, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_is_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d", n)) for n in names) == 13
