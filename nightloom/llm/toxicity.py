"""Toxic spans by a linear-chain conditional random field.

Training tokens get their labels from documents marked toxic: a token is toxic where one of
its features sets toxic documents apart from clean ones by a likelihood-ratio test, or
is needed to explain a toxic document (greedy cover). On these tokens a chain of two states is
trained by its exact gradient. Scoring runs forward-backward over every whole text; the
marginals give the offending offsets, and their maximum and sum a calibrated document score.
Training sees a bounded sample of the labelled rows; scoring never shuffles a text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .wordhash import slices

#: The bounded training sample: labelled rows of each kind, by a hash of doc_id, and characters in all.
TOXIC_ROWS = 1600
CLEAN_ROWS = 2000
SAMPLE_CHARS = 14_000_000
#: What a feature must reach to mark tokens: log odds, and G2 for the whole sample (a share of the largest) and for the cover.
LOG_ODDS = 3.0
G2_SHARE, G2_LEAST, G2_COVER = 0.15, 20.0, 15.0
SPAN = 0.5
#: Words whose odds a worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    """The word in lower case without outer punctuation, and its beginnings."""
    w = _EDGES.sub("", word.lower())
    return [f"w={w}", *(f"{n}={w[:n]}" for n in (4, 5, 6) if len(w) > n)] if w else []


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of at most TOXIC_ROWS + CLEAN_ROWS labelled rows outside of the held-out fold.

    Of rows of equal texts one stays, so copies don't pass for evidence; in the order of a hash texts are taken as long as they
    fit into SAMPLE_CHARS characters, longer ones are passed over. Null labels, ids and texts are left out.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    order = F.xxhash64("doc_id")
    picked = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).unionByName(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    rows = documents.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy(F.sha2("text", 256)).agg(F.min_by(F.struct("doc_id", "text", "toxic"), F.struct(F.xxhash64("doc_id"), "doc_id", "toxic", "text")).alias("r"))
    out, left = [], SAMPLE_CHARS
    for r in sorted(rows.select("r.*").toLocalIterator(), key=lambda r: (hash((r.doc_id * 0x9E3779B97F4A7C15) % 2**64), r.text)):
        if len(r.text) <= left:
            left -= len(r.text)
            out.append((r.text, r.toxic))
    return out


def _g2(t: np.ndarray, n: np.ndarray, nt: int, nn: int) -> np.ndarray:
    """The likelihood ratio of a feature found in t of nt toxic and n of nn clean documents."""
    both, total = t + n, nt + nn
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return 2 * (part(t, both * nt / total) + part(n, both * nn / total) + part(nt - t, (total - both) * nt / total) + part(nn - n, (total - both) * nn / total))


def _marking_features(docs: list[np.ndarray], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Which features mark the tokens of toxic documents. docs: the features of each document, once each."""
    nt, nn = int(toxic.sum()), int((~toxic).sum())
    counts = [np.zeros(n_features), np.zeros(n_features)]
    for d, k in zip(docs, toxic, strict=True):
        counts[int(k)][d] += 1
    n, t = counts
    odds = np.log((t + 0.5) / (nt + 1)) - np.log((n + 0.5) / (nn + 1))
    telling = (odds >= LOG_ODDS) & (t >= 2)
    g2 = np.where(telling, _g2(t, n, nt, nn), 0)
    marks = g2 >= max(G2_LEAST, G2_SHARE * g2.max(initial=0))
    # Cover: what the marks don't explain is explained by further features, the most telling first.
    names = np.flatnonzero(telling & ~marks)
    place = np.full(n_features, -1)
    place[names] = np.arange(len(names))
    open_docs = [place[d][place[d] >= 0] for d, k in zip(docs, toxic, strict=True) if k and not marks[d].any()]
    left = np.zeros(len(names))
    for d in open_docs:
        left[d] += 1
    while len(names) and open_docs:
        gain = np.where(left >= 2, _g2(left, n[names], nt, nn), 0)
        best = int(gain.argmax())
        if gain[best] < G2_COVER:
            break
        marks[names[best]] = True
        explained = [d for d in open_docs if best in d]
        open_docs = [d for d in open_docs if best not in d]
        for d in explained:
            left[d] -= 1
    return marks


def marginals(unary: np.ndarray, count: np.ndarray, chain: tuple[float, float, float, float]) -> np.ndarray:
    """The probability of the toxic state for each token, by forward-backward.

    unary: log odds of the tokens of all texts in a row, count: tokens of each; chain: log odds of the start, and log weights of
    toxic-toxic, clean-toxic and toxic-clean beside clean-clean (0). All texts run side by side, the longest first.
    """
    start, stay, enter, leave = (math.exp(x) for x in chain)
    odds = np.exp(np.clip(unary, -30, 30))
    out = np.zeros(len(unary))
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return out
    first, size = (np.cumsum(count) - count)[order], count[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts with a token at each place
    p = np.full(len(order), start / (1 + start))
    for t in range(size[0]):
        n = active[t]
        at, q = first[:n] + t, p[:n]
        toxic = odds[at] * (q if t == 0 else stay * q + enter * (1 - q))
        clean = 1 - q if t == 0 else leave * q + (1 - q)
        p[:n] = out[at] = toxic / (toxic + clean)
    back = np.full(len(order), 0.5)  # the toxic share of the message from the right
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        at, b = first[:n] + t, back[:n]
        f = out[at]
        out[at] = f * b / (f * b + (1 - f) * (1 - b))
        right = odds[at] * b
        toxic, clean = stay * right + leave * (1 - b), enter * right + (1 - b)
        back[:n] = toxic / (toxic + clean)
    return out


class Model:
    """Weights of features and the chain; calibration of the document score."""

    def __init__(self, weights: dict[str, float], bias: float, chain: tuple[float, float, float, float], scale: tuple[float, float, float]):
        self.weights, self.bias, self.chain, self.scale = weights, bias, chain, scale

    def unary(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def document_scores(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        z = a + b * _logit(best) + c * np.log1p(total)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def _sums(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value and the sum of each text; 0 for a text without tokens."""
    best, total = np.zeros(len(count)), np.zeros(len(count))
    full = count > 0
    if full.any():
        at = (np.cumsum(count) - count)[full]
        best[full], total[full] = np.maximum.reduceat(values, at), np.add.reduceat(values, at)
    return best, total


def train(sample: list[tuple[str, int]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-6) -> Model:
    """Labels the tokens of the sample, fits the chain by Adam on its exact gradient, then the document score.

    The sample is emptied on the way, for memory. One without toxic or without clean documents gives a model that scores everything by its share of toxic documents.
    """
    n_toxic = sum(y for _, y in sample)
    if not n_toxic or n_toxic == len(sample):
        prior = (n_toxic + 0.5) / (len(sample) + 1) if sample else 1e-3
        return Model({}, -20.0, (-20.0, 0.0, 0.0, 0.0), (math.log(prior / (1 - prior)), 0.0, 0.0))
    words: dict[str, int] = {}
    docs = [np.fromiter((words.setdefault(w, len(words)) for w in _WORD.findall(text)), np.int32) for text, _ in sample]
    y = np.array([label for _, label in sample])
    sample.clear()
    # Features as numbers: those of word i are at col[edges[i]:edges[i + 1]].
    known: dict[str, int] = {}
    col, edges = array("i"), array("i", [0])
    for w in words:
        col.extend(known.setdefault(f, len(known)) for f in features(w))
        edges.append(len(col))
    col, edges = np.array(col), np.array(edges)
    row = np.repeat(np.arange(len(words)), np.diff(edges))
    in_doc = []
    for d in docs:
        u = np.unique(d)
        size = edges[u + 1] - edges[u]
        in_doc.append(np.unique(col[np.repeat(edges[u] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]).astype(np.int32))
    marks = _marking_features(in_doc, y == 1, len(known))
    marked = np.bincount(row, marks[col], len(words)) > 0
    # The model's features are those of toxic documents; all others share the bias.
    seen = np.zeros(len(known), np.int64)
    for d, k in zip(in_doc, y, strict=True):
        if k:
            seen[d] += 1
    del in_doc
    used = np.cumsum(seen >= 2) - 1
    names = {f: int(used[i]) for f, i in known.items() if seen[i] >= 2}
    row, col = row[seen[col] >= 2], used[col[seen[col] >= 2]]
    del known
    tokens, count = np.concatenate(docs), np.array([len(d) for d in docs])
    gold = marked[tokens] & np.repeat(y == 1, count)
    usable = np.repeat((y == 0) | (np.array([bool(marked[d].any()) for d in docs])), count)  # a toxic text without marks teaches nothing
    tokens, gold = tokens[usable], gold[usable]
    # The chain is trained in stretches of 64 tokens side by side.
    stretch = 64
    count = np.full(-(-len(tokens) // stretch), stretch)
    count[-1] -= stretch * len(count) - len(tokens)
    first = np.cumsum(count) - count
    inner = np.ones(len(tokens), bool)
    inner[first] = False
    gold_pairs = _pair_counts(gold.astype(float), gold.astype(float), inner)
    theta = np.zeros(len(names) + 5)  # features, bias, start, stay, enter, leave
    theta[-5:] = -4, -4, 0, -4, 0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold_words = np.bincount(tokens, gold, len(words))
    for k in range(1, rounds + 1):
        by_word = np.bincount(row, theta[col], len(words)) + theta[-5]
        unary, chain = by_word[tokens], tuple(theta[-4:])
        p = marginals(unary, count, chain)
        expected = _expected_pairs(unary, p, count, chain, inner)
        miss = np.bincount(tokens, p, len(words)) - gold_words
        grad = np.concatenate([np.bincount(col, miss[row], len(names)), [miss.sum(), (p[first] - gold[first]).sum()], expected - gold_pairs])
        grad = grad / len(tokens) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-12)
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-4}
    chain = tuple(float(x) for x in theta[-4:])
    by_word = np.bincount(row, theta[col], len(words)) + theta[-5]
    count = np.array([len(d) for d in docs])
    best, total = _sums(marginals(by_word[np.concatenate(docs)], count, chain), count)
    return Model(weights, float(theta[-5]), chain, _calibrate(best, total, y))


def _pair_counts(left: np.ndarray, right: np.ndarray, inner: np.ndarray) -> np.ndarray:
    a, b = left[:-1], right[1:]
    k = inner[1:]
    return np.array([(a * b)[k].sum(), ((1 - a) * b)[k].sum(), (a * (1 - b))[k].sum()])


def _expected_pairs(unary, p, count, chain, inner) -> np.ndarray:
    """The expected toxic-toxic, clean-toxic and toxic-clean transitions.

    Given both marginals, a pair's four probabilities follow from the weight ratio of the chain:
    its odds ratio is that of the transition weights.
    """
    ratio = math.exp(chain[1] - chain[2] - chain[3])
    a, b = p[:-1][inner[1:]], p[1:][inner[1:]]
    if abs(ratio - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (a + b) * (ratio - 1)
        both = 2 * ratio * a * b / (s + np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * a * b, 0)))
    return np.array([both.sum(), (b - both).sum(), (a - both).sum()])


def _calibrate(best: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A logistic fit of the label by Newton's method with a small ridge."""
    x = np.stack([np.ones(len(y)), _logit(best), np.log1p(total)], 1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(3)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 0.01 * w), -2, 2)
    return tuple(float(i) for i in w)


def score(documents: DataFrame, model: Model, score_name: str = "score", spans_name: str = "spans") -> DataFrame:
    """documents with score and spans, the offsets (code points) of the toxic words; columns of the names that these are given are replaced.

    A null or empty text has no spans and the score of a text without toxic words.
    """
    documents = documents.drop(score_name, spans_name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), f"`{score_name}` double, `{spans_name}` array<struct<begin:int,end:int>>"])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # a worker may come from a stage of ids
        model, known, odds = shared.value, {}, []

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                odds.append(model.unary(word))
                n = self[word] = len(self)
                return n

        known = Codes()
        for batch in (part for whole in batches for part in slices(whole)):
            if len(known) > REMEMBERED:
                known, odds = Codes(), []
            texts = batch.column("text").to_pylist()
            codes, count = [], np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                if text:
                    before = len(codes)
                    codes.extend(map(known.__getitem__, _WORD.findall(text)))
                    count[k] = len(codes) - before
            p = marginals(np.array(odds)[np.array(codes, np.int64)] if codes else np.zeros(0), count, model.chain)
            best, total = _sums(p, count)
            spans: list[list[dict]] = [[] for _ in texts]
            first = np.cumsum(count) - count
            for k in np.flatnonzero(best >= SPAN):
                toxic = p[first[k] : first[k] + count[k]] >= SPAN
                spans[k] = [{"begin": m.start(), "end": m.end()} for m, hit in zip(_WORD.finditer(texts[k]), toxic, strict=True) if hit]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.document_scores(best, total)), pa.array(spans, kind)], names=[*batch.schema.names, score_name, spans_name]
            )

    return documents.mapInArrow(run, schema)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans of every document, by a model trained on the labels outside of the held-out fold."""
    out = score(documents.select("doc_id", "text"), train(training_sample(documents, labels)))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )
