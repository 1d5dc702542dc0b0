"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the SEED-word runs within a window of WINDOW words the one of the least hash. A
window's anchor depends on its words alone, so equal windows have equal anchors and only anchors found in
several documents can seed a repeat. Around an anchor, the windows that chose it are extended to the
left and to the right into one run of words. Where all documents extend an anchor by the same run, the
smallest document of the anchor owns that run and no window has to be compared; where extensions
differ, their windows are compared one by one through their hashes. Never are
two documents of a group paired, so groups of copies cost what their words cost. Adjoining
windows make up the maximal repeats over the length threshold, which are cut out of all
documents but the smallest. Runs and windows are compared by 64-bit hashes of their words, not word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .wordhash import Words, slices

WINDOW = 13
SEED = 5
#: Up to so many anchors found in several documents go to the tasks as a broadcast (17 bytes each); more are joined by a shuffle.
BROADCAST_ANCHORS = 6_000_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ANCHORS = "anchor bigint, doc_id bigint, run bigint"
_FOUND = "doc_id bigint, fp bigint, start int, n int, anchor bigint, window bigint"


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, fp, text: a row is known by its id and the hash of its text."""
    return documents.select("doc_id", F.xxhash64("text").alias("fp"), F.coalesce("text", F.lit("")).alias("text"))


def _seeded(words: Words, window: int, seed: int):
    """Of each window of the batch its start, text and anchor; the windows of one anchor in a row make up a run.

    Returns starts of windows, their texts (numbers in the batch), anchors' hashes, and where runs begin.
    """
    starts, have = words.run_starts(window)
    text = np.repeat(np.arange(len(have)), have)
    if not len(starts):
        return starts, text, np.zeros(0, np.uint64), starts
    span = window - seed
    n_runs = len(words.hash) - seed + 1
    grams = words.run(np.arange(n_runs), np.arange(n_runs) + seed)
    best, at = grams[starts], starts.copy()
    for k in range(1, span + 1):
        other = grams[starts + k]
        less = other <= best  # of equals the rightmost
        best, at = np.where(less, other, best), np.where(less, starts + k, at)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    return starts, text, best, np.flatnonzero(new)


def _runs(words: Words, starts: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run's words, and the number of its windows."""
    n = np.diff(np.append(begins, len(starts)))
    return words.run(starts[begins], starts[begins] + n + window - 1), n


def _anchors(documents: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = Words(batch.column("text"))
            starts, text, anchor, begins = _seeded(words, window, seed)
            runs, _ = _runs(words, starts, begins, window)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text[begins]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[begins].view(np.int64)), pa.array(doc), pa.array(runs.view(np.int64))], names=["anchor", "doc_id", "run"])

    return documents.select("doc_id", "text").mapInArrow(run, _ANCHORS)


def _extended(documents: DataFrame, shared, window: int, seed: int) -> DataFrame:
    """Extends the shared anchors of each text.

    Gives windows start to start + n - 1 that a smaller document has for certain (anchor null), and single windows still to be
    compared. shared: a broadcast of sorted anchors, their smallest documents and whether their runs differ; None where
    documents bring their own in columns anchors, firsts and differ.
    """

    def found(anchor, doc_text, table):
        if table is not None:
            at = np.minimum(np.searchsorted(table[0], anchor), max(len(table[0]) - 1, 0))
            hit = table[0][at] == anchor if len(table[0]) else np.zeros(len(anchor), bool)
            return hit, table[1][at] if len(table[0]) else anchor, table[2][at] if len(table[0]) else hit
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared is not None else None
        for batch in (part for whole in batches for part in slices(whole)):
            words = Words(batch.column("text"))
            starts, text, anchors, begins = _seeded(words, window, seed)
            _, n = _runs(words, starts, begins, window)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            anchor, of = anchors[begins].view(np.int64), text[begins]
            if table is not None:
                hit, first, differ = found(anchor, of, table)
            else:
                hit, first, differ = _own(batch, anchor, of)
            sure = hit & ~differ & (first < ids[of])
            open_ = hit & differ
            relative = starts - words.first[text]
            # Certain runs that adjoin are one stretch.
            s = np.flatnonzero(sure)
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1] + 1) | (of[s[1:]] != of[s[:-1]])
            lead = np.flatnonzero(new)
            length = np.add.reduceat(n[s], lead) if len(s) else s
            s = s[lead]
            w = np.flatnonzero(np.repeat(open_, n))
            row = np.concatenate([of[s], text[w]])
            start = np.concatenate([relative[begins[s]], relative[w]])
            sure_rows = np.arange(len(row)) < len(s)
            window_hash = np.concatenate([np.zeros(len(s), np.int64), words.run(starts[w], starts[w] + window).view(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[row]),
                    batch.column("fp").take(pa.array(row)),
                    pa.array(start.astype(np.int32)),
                    pa.array(np.concatenate([length, np.ones(len(w), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(s), np.int64), anchors[w].view(np.int64)]), mask=sure_rows),
                    pa.array(window_hash, mask=sure_rows),
                ],
                names=[x.split()[0] for x in _FOUND.split(", ")],
            )

    return documents.mapInArrow(run, _FOUND)


def _own(batch: pa.RecordBatch, anchor: np.ndarray, of: np.ndarray):
    """hit, first and differ of anchors from the lists that each document brings."""
    lists = batch.column("anchors")
    size = np.diff(np.asarray(lists.offsets))
    keys, first, differ = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("anchors", "firsts", "differ"))
    key_of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((keys, key_of))
    keys, first, differ, key_of = keys[order], first[order], differ[order].astype(bool), key_of[order]
    begin = np.cumsum(size) - size
    at = np.zeros(len(anchor), np.int64)
    hit = np.zeros(len(anchor), bool)
    edges = np.searchsorted(of, np.arange(len(size) + 1))
    for k in np.flatnonzero(size):
        mine = slice(edges[k], edges[k + 1])
        own = keys[begin[k] : begin[k] + size[k]]
        found = np.minimum(np.searchsorted(own, anchor[mine]), size[k] - 1)
        at[mine], hit[mine] = begin[k] + found, own[found] == anchor[mine]
    if not len(keys):
        return hit, anchor, hit
    return hit, first[at], differ[at]


def repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """doc_id, fp, spans: by document (id and text hash) the windows, from start on n in a row, that a document of a smaller id has too."""
    docs = _keyed(documents).filter("doc_id IS NOT NULL")
    anchors = _anchors(docs, window, seed)
    shared = materialize(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("run") != F.max("run")).alias("differ"))
        .filter("first < last")
        .drop("last"),
        "anchors",
    )
    if shared.count() <= broadcast_anchors:
        table = shared.toArrow()
        keys, firsts, differ = (table[c].to_numpy() for c in ("anchor", "first", "differ"))
        order = np.argsort(keys)
        sent = docs.sparkSession.sparkContext.broadcast((keys[order], firsts[order], differ[order].astype(bool)))
        found = _extended(docs, sent, window, seed)
    else:
        own = (
            anchors.select("anchor", "doc_id").distinct().join(shared, "anchor")
            .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "differ")).alias("a"))
            .select("doc_id", F.col("a.anchor").alias("anchors"), F.col("a.first").alias("firsts"), F.col("a.differ").alias("differ"))
        )
        found = _extended(docs.join(own, "doc_id"), None, window, seed)
    found = materialize(found, "found")
    windows = found.filter("anchor IS NOT NULL")
    # Written, so that the join below has a shuffle on both sides and Spark can split the rows of a hot window.
    owners = materialize(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "owners")
    compared = windows.join(owners, ["anchor", "window"]).filter("doc_id > first").select("doc_id", "fp", "start", "n")
    sure = found.filter("anchor IS NULL").select("doc_id", "fp", "start", "n")
    return sure.unionByName(compared).groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def cut_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED, broadcast_anchors: int = BROADCAST_ANCHORS, names: tuple[str, str, str] = ("n_words", "n_removed", "repeats")) -> DataFrame:
    """documents with text cut, n_words, n_removed and repeats (maximal repeats as word ranges begin to end), under the given names; columns of these names are replaced.

    text keeps its words, joined by one space where any were removed; where none were it stays as it is. A null text stays null with 0 words;
    rows of null doc_id are kept whole and take nothing from others. Rows of equal doc_id are judged each against smaller ids.
    """
    kept = [f.name for f in documents.schema if f.name.lower() not in {n.lower() for n in names}]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept]
    own = fresh(kept, "_s")
    spans = repeats(documents, window, seed, broadcast_anchors).withColumnsRenamed({"doc_id": f"{own}1", "fp": f"{own}2", "spans": own})
    joined = documents.select(*kept).join(spans, (F.col("doc_id") == F.col(f"{own}1")) & (F.xxhash64("text") == F.col(f"{own}2")), "left").select(*kept, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, n_words, n_removed, ranges = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist(), strict=True):
                words = _WORD.findall(text or "")
                merged: list[list[int]] = []
                for begin, end in sorted((s["start"], s["start"] + s["n"] + window - 1) for s in spans or ()):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([begin, end])
                if merged:
                    edges = [0, *(x for pair in merged for x in pair), len(words)]
                    text = " ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])
                texts.append(text)
                n_words.append(len(words))
                n_removed.append(sum(e - b for b, e in merged))
                ranges.append([{"begin": b, "end": e} for b, e in merged])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(ranges, kind)], names=[*kept, *names]
            )

    return joined.mapInArrow(run, ", ".join([*kinds, f"`{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` array<struct<begin:int,end:int>>"]))


def document_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, joined by one space."""
    cut = cut_repeats(documents.select("doc_id", "text"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(joined.cast("binary"), 256).alias("kept_sha256"))


SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS r(i)),
later AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(13) AS r(o)),
word AS (SELECT doc_id, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
