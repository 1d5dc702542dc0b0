"""Tokens of two tokenizers aligned by the bytes that they cover.

A is a byte-level BPE of the tokenizers library, B a byte-fallback BPE of sentencepiece, which puts a space before a text; A reads the text with
that space. The spans that the libraries give (characters for A, UTF-8 bytes for B) are coarse cuts: they are right where a token ends with a
character. Tokens that end within one, and byte-fallback tokens, get their ends from their decoded bytes. Where tokens of both end lies a cut,
and the tokens between two cuts are a group.

Both tokenizers always cut before a single space between two other characters, so a text is aligned chunk by chunk, and a worker process
remembers chunks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _Codes, cut_before_words
from .wordhash import slices

#: Chunks and characters of chunks that a worker remembers; beyond either its memory starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 30_000_000
#: Pairs of ids whose counts are broadcast at most; the counts of the others are joined.
BROADCAST_PAIRS = 2_000_000

_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<a:int,b:int,times:int>>"


def byte_of_character() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def refined(ends: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Token ends in bytes: the coarse ones where they are sure, in between from the decoded sizes on from the last sure one."""
    at = np.cumsum(sizes)
    known = np.flatnonzero(sure)
    last = np.searchsorted(known, np.arange(len(ends)), side="right") - 1
    base = np.where(last >= 0, ends[known[last]] - at[known[last]], 0) if len(known) else np.zeros(len(ends), np.int64)
    return at + base


class Aligner:
    def __init__(self, byte_bpe: str, piece_bpe: str, remembered: int = REMEMBERED, chars: int = REMEMBERED_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        table = byte_of_character()
        self.a_bytes = {i: bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        # No piece runs over the beginning of a word, so words are encoded alike alone and in a text.
        self.parted = all("▁" not in p.lstrip("▁") for p in pieces)
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(v) for v in self.a_bytes.values()]
        self.b_size = np.array([len(v) for v in self.b_bytes], np.int64)
        self.remembered, self.chars = remembered, chars
        self.forget()

    def forget(self) -> None:
        self.codes, self.held = _Codes(), 0
        #: Of each chunk: tokens of A and B, groups, links, and whether its bytes come back.
        self.counts = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def _spans(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of A and then of B: ids, coarse ends (from the beginning of each chunk with its space) in characters for A and bytes for B, whether they are sure, and tokens of each chunk."""
        found = self.a.encode_batch([f" {c}" for c in chunks], add_special_tokens=False)
        ids = [x.ids for x in found]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in found)), np.int64, 2 * int(many.sum())).reshape(-1, 2)
        # A token of A ends with a character where the next one begins no earlier; white space that a span leaves out belongs to the next token.
        sure = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        sure[np.cumsum(many)[many > 0] - 1] = True
        a = [np.fromiter(chain.from_iterable(ids), np.int64, int(many.sum())), spans[:, 1], sure, many]
        pieces = [[(p.id, p.begin, p.end) for p in x.pieces] for x in self.b.encode(chunks, num_threads=1, return_type="proto")]
        many = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(pieces)), np.int64, 3 * int(many.sum())).reshape(-1, 3)
        # Of the byte tokens of one character only the last has a span. The space before the text has none: spans are one byte short.
        return a, [flat[:, 0], flat[:, 2] + 1, flat[:, 2] > flat[:, 1], many]

    def align(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each chunk's bytes come back from both tokenizers, and of all those chunks in a row: ids of A and of B, the group of each, and the chunk of each group."""
        raw = [f" {c}".encode() for c in chunks]
        (a, a_ends, a_sure, n_a), (b, b_ends, b_sure, n_b) = self._spans(chunks)
        whole = np.ones(len(chunks), bool)
        for ids, table, sizes, many in ((a, self.a_bytes, self.a_size, n_a), (b, self.b_bytes, self.b_size, n_b)):
            back = b"".join([table[k] for k in ids.tolist()])
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(many)].tolist()
            begin = 0
            for k, end in enumerate(ends):
                if back[begin:end] != raw[k]:
                    whole[k] = False
                begin = end
        keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
        a, a_ends, a_sure, b, b_ends, b_sure = a[keep_a], a_ends[keep_a], a_sure[keep_a], b[keep_b], b_ends[keep_b], b_sure[keep_b]
        n_a, n_b, kept = n_a[whole], n_b[whole], np.flatnonzero(whole)
        joined = np.frombuffer(b"".join([raw[k] for k in kept.tolist()]), np.uint8)
        starts = np.append(np.flatnonzero((joined & 0xC0) != 0x80), len(joined))  # of characters
        n_bytes, n_chars = np.array([len(raw[k]) for k in kept], np.int64), np.array([len(chunks[k]) + 1 for k in kept], np.int64)
        a_ends = refined(starts[a_ends + np.repeat(np.cumsum(n_chars) - n_chars, n_a)], a_sure, self.a_size[a])
        b_ends = refined(b_ends + np.repeat(np.cumsum(n_bytes) - n_bytes, n_b), b_sure, self.b_size[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        return whole, a, b, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), kept[np.searchsorted(np.cumsum(n_bytes), cuts)]

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        whole, a, b, ga, gb, chunk = self.align(new)
        n = len(chunk)
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        # Each token of A meets the tokens of B in its group.
        many = nb[ga]
        other = np.arange(int(many.sum())) + np.repeat((np.cumsum(nb) - nb)[ga] - (np.cumsum(many) - many), many)
        sums = lambda per_group: np.bincount(chunk, weights=per_group, minlength=len(new)).astype(np.int64)
        counts = np.stack([sums(na), sums(nb), sums(np.ones(n)), sums(na * nb), whole.astype(np.int64)], 1)
        texts, at_a, at_b = [], 0, 0
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for p, q in zip(na.tolist(), nb.tolist(), strict=True):
            texts.append(f"{','.join(names_a[at_a : at_a + p])}|{','.join(names_b[at_b : at_b + q])}")
            at_a, at_b = at_a + p, at_b + q
        edges = np.concatenate([[0], np.cumsum(counts[:, 2])]).tolist()
        self.groups += [";".join(texts[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, np.cumsum(counts[:, 3]) - counts[:, 3] + len(self.links)]).astype(np.int64)
        self.links = np.concatenate([self.links, np.repeat(a, many) << 32 | b[other]])
        self.held += sum(map(len, new))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each text (tokens of A and B, groups, links), the digests of its groups, its distinct links (a << 32 | b), how often it has each, and where each text's links begin."""
        if len(self.codes) > self.remembered or self.held > self.chars:
            self.forget()
        look, codes, sizes = self.codes.__getitem__, [], []
        for text in texts:
            before = len(codes)
            if text:
                first, *rest = cut_before_words(text) if self.parted else [text]
                codes.append(look(first))
                codes.extend([look(chunk[1:]) for chunk in rest])
            sizes.append(len(codes) - before)
        if self.codes.new:
            self._learn()
        code, size = np.array(codes, np.int64), np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(texts)), size)
        edges = np.concatenate([[0], np.cumsum(size)])
        bad = np.bincount(row, weights=1 - self.counts[code, 4], minlength=len(texts)) > 0
        kept = ~bad[row]
        code, row = code[kept], row[kept]
        counts = np.stack([np.bincount(row, weights=self.counts[code, k], minlength=len(texts)).astype(np.int64) for k in range(4)], 1)
        groups = self.groups
        digests = ["" if bad[k] or not size[k] else hashlib.sha256(";".join([groups[c] for c in codes[edges[k] : edges[k + 1]]]).encode()).hexdigest() for k in range(len(texts))]
        many = self.counts[code, 3]
        at = np.arange(int(many.sum())) + np.repeat(self.first[code] - (np.cumsum(many) - many), many)
        link, of = self.links[at], np.repeat(row, many)
        order = np.lexsort((link, of))
        link, of = link[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (link[1:] != link[:-1]) | (of[1:] != of[:-1])])) if len(link) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(link)))
        return counts, digests, link[new], times, np.searchsorted(of[new], np.arange(len(texts) + 1))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One for each worker process; Spark keeps the process for later tasks."""
    if (byte_bpe, piece_bpe) not in _aligners:
        _aligners[byte_bpe, piece_bpe] = Aligner(byte_bpe, piece_bpe)
    return _aligners[byte_bpe, piece_bpe]


def aligned(documents: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """_ALIGNED of every whole text. links: distinct pairs of ids that share a group, and how often. Null and empty texts, and texts whose bytes do not come back from either tokenizer, have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_bpe, piece_bpe).texts
        for batch in (part for whole in batches for part in slices(whole, 256)):
            counts, digests, link, times, first = align(batch.column("text").to_pylist())
            pairs = pa.StructArray.from_arrays([pa.array((link >> 32).astype(np.int32)), pa.array((link & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int32))], names=["a", "b", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def link_counts(links: DataFrame) -> DataFrame:
    """a, b, n, best: in how many documents two ids are linked, and whether that is the highest count of a."""
    counts = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counts, "link_counts")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A: fewer than its vocabulary
    return counted.join(F.broadcast(best), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(documents: DataFrame, byte_bpe: str, piece_bpe: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Repeated rows are documents of their own, also those with one id or none; an empty table gives an empty one. Counts of pairs of which at most broadcast_pairs are broadcast, those
    of the most documents, meet the links where they are; what is left is joined.
    """
    found = materialize(aligned(documents, byte_bpe, piece_bpe).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = found.select("row", F.explode("links").alias("l")).select("row", "l.a", "l.b", "l.times")
    counts = materialize(link_counts(links), "pair_counts")
    # The least power of two over which so few pairs lie.
    over = counts.agg(*[F.count_if(F.col("n") >= 2**k).alias(f"_{k}") for k in range(63)]).first()
    least = 2 ** next((k for k in range(63) if over[k] <= broadcast_pairs), 62)
    named = counts.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best")
    links = links.select("row", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "times")
    seen = links.join(F.broadcast(named.filter(F.col("n") >= least)), "pair", "left")
    known = seen.filter("n IS NOT NULL")
    if least > 1:
        known = known.unionByName(seen.filter("n IS NULL").select("pair", "row", "times").join(named.filter(F.col("n") < least), "pair"))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
