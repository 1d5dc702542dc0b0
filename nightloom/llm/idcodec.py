"""Token ids in range-coded files.

A file holds documents in ascending order of doc_id. Its ids are cut into blocks that are coded on their own, each with a
checksum and with a model that starts anew from the file's tables. The model mixes predictions of three orders: order 2 is
the id that followed the two ids before it when the block last had them; order 1 is the id that followed the one before it, at
first the one that most often does so in the file; order 0 is the frequencies of the file's ids, which code whatever the other two
miss. How much of the range orders 2 and 1 get is estimated adaptively in two ways, by what either has achieved lately and by
how sure the file's successor is, and mixed by weights that each block learns from the errors of both. All blocks of a file are
coded side by side, one id of each at a time, so the arithmetic runs over whole arrays, and in whole numbers throughout.

Layout: MAGIC, then for four parts (header as JSON, documents, tables, blocks) a length (u32) and a CRC-32 (u32) and the bytes. Documents:
doc_id (i64), null flags (u8) and counts (u32), deflated. Tables: by rank the id (u32), frequency (u32), successor's rank (u32) and sureness
(u8), deflated. Blocks: for each block ids (u32), bytes (u32) and the ids' CRC-32 (u32), then the code.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder
from .wordhash import slices

MAGIC = b"NLIDS02\n"
#: Ids of a block: as many as leave a file LANES blocks, within these bounds.
BLOCK_IDS = (256, 2048)
LANES = 512
#: A task rolls its file after so many ids.
FILE_IDS = 8_000_000
END_ID = 1

_ORDER1, _ORDER2 = 1024, 2048  # slots of a block
_CONTEXTS = 16
_FREQUENCIES = 22  # bits of the frequencies' total
_SURE = 16  # grades of sureness
_HITS_MOST = 61440  # of 65536; the rest keeps every id codable
_FINE = 12  # bits of the range's total beyond the 16 of a hit
_TOTAL = np.uint64(16 + _FINE)
_WORD = np.uint64(32)
_TOP = np.uint64(2**32)
_RATE = 5

MANIFEST_SCHEMA = "file string, part int, roll int, first_doc bigint, documents bigint, ids bigint, bytes bigint"


class Tables:
    """What a file's blocks start from. Ids are known by their rank among the file's distinct ids."""

    def __init__(self, ids: np.ndarray, frequency: np.ndarray, successor: np.ndarray, sure: np.ndarray):
        self.ids, self.frequency, self.successor, self.sure = ids, frequency, successor, sure
        self.running = np.concatenate([[0], np.cumsum(frequency, dtype=np.int64)])

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Tables, np.ndarray]:
        """The tables of a file's ids, and the ids as ranks."""
        known, count = np.unique(ids, return_counts=True)
        n, m = len(ids), len(known)
        if n and known[-1] < 2**24:  # a vocabulary's ids are small numbers: a list of ranks is faster than a search
            ranks = np.zeros(int(known[-1]) + 1, np.int64)
            ranks[known] = np.arange(m)
            rank = ranks.take(ids)
        else:
            rank = np.searchsorted(known, ids)
        if not n:
            return cls(*(np.zeros(0, np.uint32),) * 3, np.zeros(0, np.uint8)), np.zeros(0, np.int32)
        frequency = 1 + count * (2**_FREQUENCIES - m) // n
        frequency[count.argmax()] += 2**_FREQUENCIES - frequency.sum()
        pair, seen = np.unique(rank[:-1] * m + rank[1:], return_counts=True)
        order = np.lexsort((seen, pair // m))
        last = order[np.append((pair // m)[order][1:] != (pair // m)[order][:-1], np.ones(min(len(order), 1), bool))]
        successor, sure = np.zeros(m, np.uint32), np.zeros(m, np.uint8)
        successor[pair[last] // m] = pair[last] % m
        sure[pair[last] // m] = seen[last] * (_SURE - 1) // count[pair[last] // m]
        return cls(known.astype(np.uint32), frequency.astype(np.uint32), successor, sure), rank.astype(np.int32)

    def pack(self) -> bytes:
        gaps = np.diff(self.ids, prepend=np.uint32(0))
        return zlib.compress(b"".join([x.astype("<u4").tobytes() for x in (gaps, self.frequency, self.successor)] + [self.sure.tobytes()]))

    @classmethod
    def unpack(cls, data: bytes) -> Tables:
        raw = zlib.decompress(data)
        m = len(raw) // 13
        gaps, frequency, successor = np.frombuffer(raw, "<u4", 3 * m).reshape(3, m)
        return cls(np.cumsum(gaps, dtype=np.uint32), frequency, successor, np.frombuffer(raw, np.uint8, m, 12 * m))


class _Model:
    """The state of all lanes (blocks); n is the number of lanes still running."""

    def __init__(self, lanes: int, tables: Tables):
        lane = np.arange(lanes)
        self.successor, self.sure = tables.successor.astype(np.int64), tables.sure.astype(np.int64)
        self.table1 = np.zeros(lanes * _ORDER1, np.int32)  # (rank + 1) << 2 | confidence from 1 to 3; 0: nothing yet
        self.table2 = np.zeros(lanes * _ORDER2, np.int32)
        self.base1, self.base2 = lane * _ORDER1, lane * _ORDER2
        # Estimates of hits, of 65536, of order 2 above those of order 1 in a number: by the confidences of both tables, and by sureness.
        state = np.arange(_CONTEXTS)
        by_confidence = np.array([64, 16000, 30000, 42000])[state // 4] << 16 | np.array([6000, 5000, 20000, 34000])[state % 4]
        by_sureness = np.full(_CONTEXTS, 4000) << 16 | np.minimum(state * 65536 // _SURE + 1024, 60000)
        self.hits = np.concatenate([np.tile(by_confidence, lanes), np.tile(by_sureness, lanes)]).astype(np.int64)
        self.base = np.stack([lane * _CONTEXTS, (lane + lanes) * _CONTEXTS])
        self.weight2, self.weight1 = np.full(lanes, 192, np.int64), np.full(lanes, 128, np.int64)  # of the first estimate, of 256
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        last = self.last[:n]
        spread = last * 0x9E3779B1
        self.at1 = (spread >> 9 & (_ORDER1 - 1)) + self.base1[:n]
        spread += self.before[:n] * 0x6A09E667
        self.at2 = (spread >> 11 & (_ORDER2 - 1)) + self.base2[:n]
        one, two = self.table1.take(self.at1).astype(np.int64), self.table2.take(self.at2).astype(np.int64)
        self.id1 = np.where(one > 0, (one >> 2) - 1, self.successor.take(last))
        self.id2 = (two >> 2) - 1
        self.conf1, self.conf2 = one & 3, two & 3
        self.at = self.base[:, :n].copy()
        self.at[0] += self.conf2 << 2 | self.conf1
        self.at[1] += self.sure.take(last)
        both = self.hits.take(self.at)
        self.old2, self.old1 = both >> 16, both & 65535
        self.gap2, self.gap1 = self.old2[0] - self.old2[1], self.old1[0] - self.old1[1]
        self.f2 = np.minimum((self.gap2 * self.weight2[:n] >> 8) + self.old2[1], _HITS_MOST - 4096) + 1
        share1 = (self.gap1 * self.weight1[:n] >> 8) + self.old1[1]
        self.covered = self.f2 + ((_HITS_MOST - self.f2) * share1 >> 16) + 1
        self.miss = 65536 - self.covered

    def update(self, n: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        fresh = (x << 2) + 5
        self.table1[self.at1] = fresh + np.minimum(self.conf1, 2) * (self.id1 == x)
        self.table2[self.at2] = fresh + np.minimum(self.conf2, 2) * hit2
        two, one = hit2.astype(np.int64), hit1.astype(np.int64)
        open_ = 1 - two  # order 1 learns only where order 2 has missed
        new2 = self.old2 + ((two * 65535 - self.old2) >> _RATE)
        new1 = self.old1 + ((one * 65535 - self.old1) >> _RATE) * open_
        self.hits[self.at] = new2 << 16 | new1
        # Whichever estimate was nearer to what came gains weight.
        for weight, gap, sign in ((self.weight2[:n], self.gap2, two * 2 - 1), (self.weight1[:n], self.gap1, (one * 2 - 1) * open_)):
            weight += gap * sign >> 12
            np.maximum(weight, 8, out=weight)
            np.minimum(weight, 248, out=weight)
        self.before[:n] = self.last[:n]
        self.last[:n] = x


def block_size(n_ids: int) -> int:
    return min(max(n_ids // LANES, BLOCK_IDS[0]), BLOCK_IDS[1])


def _narrow(low: np.ndarray, size: np.ndarray, start: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Narrows the ranges of the first n lanes; returns the lanes whose upper word is settled. A range that is short but straddles a word's edge is cut there."""
    unit = size[:n] >> _TOTAL
    low[:n] += unit * start.astype(np.uint64)
    size[:n] = unit * width.astype(np.uint64)
    out = np.flatnonzero(size[:n] < _TOP)
    begin, length = low[out], size[out]
    straddles = (begin ^ (begin + length)) >= _TOP
    if straddles.any():
        size[out[straddles]] = (~begin[straddles] + np.uint64(1)) & (_TOP - np.uint64(1))
    return out


def encode_blocks(ranks: np.ndarray, tables: Tables, block_ids: int = BLOCK_IDS[1]) -> list[bytes]:
    """The code of each block of ranks."""
    lanes = -(-len(ranks) // block_ids)
    if not lanes:
        return []
    short = len(ranks) - (lanes - 1) * block_ids
    padded = np.zeros(lanes * block_ids, np.int32)
    padded[: len(ranks)] = ranks
    grid = np.ascontiguousarray(padded.reshape(lanes, block_ids).T)
    model, running = _Model(lanes, tables), tables.running
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, count = np.zeros((lanes, block_ids + 16), np.uint32), np.zeros(lanes, np.int64)
    for t in range(min(block_ids, len(ranks)) if lanes == 1 else block_ids):
        n = lanes if t < short else lanes - 1
        x = grid[t, :n].astype(np.int64)
        model.predict(n)
        hit2 = model.id2 == x
        hit1 = ~hit2 & (model.id1 == x)
        fine, miss = model.covered << _FINE, model.miss
        start, end = fine + (miss * running.take(x) >> _FREQUENCIES - _FINE), fine + (miss * running.take(x + 1) >> _FREQUENCIES - _FINE)
        f2 = model.f2 << _FINE
        start = np.where(hit2, 0, np.where(hit1, f2, start))
        end = np.where(hit2, f2, np.where(hit1, fine, end))
        out = _narrow(low, size, start, end - start, n)
        words[out, count[out]] = low[out] >> _WORD
        count[out] += 1
        low[out] <<= _WORD
        size[out] <<= _WORD
        model.update(n, x, hit2, hit1)
    lane = np.arange(lanes)
    words[lane, count], words[lane, count + 1] = low >> _WORD, low & np.uint64(0xFFFFFFFF)
    return [words[k, : count[k] + 2].astype("<u4").tobytes() for k in range(lanes)]


def decode_blocks(codes: list[bytes], sizes: np.ndarray, tables: Tables) -> np.ndarray:
    """The ranks of all blocks in a row; only the last block may be shorter than the others."""
    lanes = len(codes)
    if not lanes:
        return np.zeros(0, np.int32)
    block_ids, short = int(sizes[0]), int(sizes[-1])
    n_words = np.array([len(c) // 4 for c in codes])
    words = np.zeros((lanes, int(n_words.max()) + 2), np.uint32)
    for k, c in enumerate(codes):
        words[k, : n_words[k]] = np.frombuffer(c, "<u4")
    model, running = _Model(lanes, tables), tables.running
    rank_at = np.repeat(np.arange(len(tables.ids), dtype=np.int32), tables.frequency)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code, at = words[:, 0].astype(np.uint64) << _WORD | words[:, 1], np.full(lanes, 2)
    out = np.zeros((block_ids, lanes), np.int32)
    for t in range(block_ids):
        n = lanes if t < short else lanes - 1
        model.predict(n)
        v = np.minimum((code[:n] - low[:n]) // (size[:n] >> _TOTAL), np.uint64(2 ** int(_TOTAL) - 1)).astype(np.int64)
        f2, fine, miss = model.f2 << _FINE, model.covered << _FINE, model.miss
        hit2 = v < f2
        hit1 = ~hit2 & (v < fine)
        place = ((np.maximum(v - fine, 0) + 1 << _FREQUENCIES - _FINE) - 1) // miss  # the last frequency that begins at or before v
        x = np.where(hit2, model.id2, np.where(hit1, model.id1, rank_at.take(place, mode="clip").astype(np.int64)))
        start, end = fine + (miss * running.take(x) >> _FREQUENCIES - _FINE), fine + (miss * running.take(x + 1) >> _FREQUENCIES - _FINE)
        start = np.where(hit2, 0, np.where(hit1, f2, start))
        end = np.where(hit2, f2, np.where(hit1, fine, end))
        k = _narrow(low, size, start, end - start, n)
        code[k] = code[k] << _WORD | words[k, np.minimum(at[k], words.shape[1] - 1)]
        at[k] += 1
        low[k] <<= _WORD
        size[k] <<= _WORD
        model.update(n, x, hit2, hit1)
        out[t, :n] = x
    flat = np.ascontiguousarray(out.T).reshape(-1)
    return flat[: (lanes - 1) * block_ids + short]


def pack_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    block_ids = block_size(len(ids))
    header = json.dumps({"documents": len(doc_ids), "ids": len(ids), "block_ids": block_ids}).encode()
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    documents = zlib.compress(known.tobytes() + null.tobytes() + counts.astype("<u4").tobytes())
    tables, ranks = Tables.of(ids)
    codes = encode_blocks(ranks, tables, block_ids)
    table = b"".join(
        np.array([len(part), len(code), zlib.crc32(part.astype("<u4"))], "<u4").tobytes()
        for code, part in zip(codes, (ids[k : k + block_ids] for k in range(0, len(ids), block_ids)), strict=True)
    )
    out = [MAGIC]
    for part in (header, documents, tables.pack(), table + b"".join(codes)):
        out += [np.array([len(part), zlib.crc32(part)], "<u4").tobytes(), part]
    return b"".join(out)


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a file; raises ValueError where any checksum fails."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of ids")
    at, parts = len(MAGIC), []
    for _ in range(4):
        size, crc = np.frombuffer(data, "<u4", 2, at).tolist()
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(part) != crc:
            raise ValueError("a part differs from its checksum")
        parts.append(part)
        at += 8 + size
    header = json.loads(parts[0])
    n = header["documents"]
    raw = zlib.decompress(parts[1])
    known, null, counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u4", n, 9 * n)
    lanes = -(-header["ids"] // header["block_ids"])
    tables, code = Tables.unpack(parts[2]), parts[3]
    table = np.frombuffer(code, "<u4", 3 * lanes).reshape(-1, 3).astype(np.int64)
    ends = 12 * lanes + np.cumsum(table[:, 1])
    ids = tables.ids.take(decode_blocks([code[e - s : e] for s, e in zip(table[:, 1].tolist(), ends.tolist(), strict=True)], table[:, 0], tables))
    edges = np.cumsum(table[:, 0])
    for size, end, crc in zip(table[:, 0].tolist(), edges.tolist(), table[:, 2].tolist(), strict=True):
        if zlib.crc32(ids[end - size : end].astype("<u4")) != crc:
            raise ValueError("a block differs from its checksum")
    return [None if gone else x for x, gone in zip(known.tolist(), null.tolist(), strict=True)], counts.astype(np.int64), ids


def write(documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents(doc_id, text) under folder, each with end_id after its own, and returns the manifest.

    A null text is an empty one; null doc_ids come first, repeated ones follow each other. Files get their names when whole; the
    manifest, written last, lists those that count.
    """
    spark = documents.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        encode = tokens.encoder(tokenizer, tokens.cut_at_whitespace).encode
        part = TaskContext.get().partitionId()  # ranges in order
        docs: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        done: list[tuple] = []

        def close() -> None:
            if docs:
                all_ids = np.concatenate(held)
                data = pack_file(docs, np.concatenate(counts), all_ids)
                name = f"ids-{uuid.uuid4().hex}.bin"
                with store.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
                    out.write(data)
                store.move(f"{root}/{name}.tmp", f"{root}/{name}")
                done.append((name, part, len(done), docs[0], len(docs), len(all_ids), len(data)))
                docs.clear(), held.clear(), counts.clear()

        for batch in (part for whole in batches for part in slices(whole, 256)):
            ids, count = tokens.append_end(*encode(batch.column("text").to_pylist()), end_id)
            docs += batch.column("doc_id").to_pylist()
            held.append(ids)
            counts.append(count)
            if sum(map(len, held)) >= file_ids:
                close()
        close()
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MANIFEST_SCHEMA.split(", ")])

    rows = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(run, MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the manifest alone, in the order in which they were written."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    before = W.orderBy("part", "roll").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    docs, counts, ids = unpack_file(source.read())
                start = np.cumsum(counts) - counts
                data = ids.astype("<u4")
                crc = [zlib.crc32(data[a : a + n]) for a, n in zip(start.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + base), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_documents(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of documents in the shared folder and reads them back."""
    folder = new_folder(documents.sparkSession, "ids")
    write(documents, tokenizer, folder)
    return read(documents.sparkSession, folder)
