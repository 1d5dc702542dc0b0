"""Bound-certified packing of documents into sequences.

Pieces are packed by best-fit decreasing in partitions of bounded size. Lower bounds by dual feasible functions say
how few bins a partition needs, and, from the counts of all lengths, how few all need together. Where the bins of all
partitions meet the common bound the packing is certified as a whole. Until then, partitions with a gap (over their own
bound or their volume) keep their fuller bins and exchange the documents of the emptiest ones, half of their pieces, in half
as many partitions, where best fit runs again; partitions without a gap give up their emptiest bin. Each round has half of the pieces
of the one before, so all rounds together cost twice the first, and the last is one partition that all gaps have come down to.
Only narrow rows (key, length, checksum) are moved; the driver sees counts by length and two counts for each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import materialize
from .wordhash import slices

CAPACITY = 2048
#: Pieces that one task packs.
PER_PARTITION = 60_000

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The bound for items of these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(have: np.ndarray, capacity: int) -> int:
    """How many bins items need at least; have: the number of items of each length up to the capacity. The largest of three families of dual-feasible-function bounds on the number of bins.

    Sizes; sizes with those over capacity - e rounded to the capacity and those under e to 0,
    for each e up to half the capacity; sizes rounded down to multiples of 1/k, k up to 32.
    """
    have = have.astype(np.int64)
    size = np.arange(capacity + 1)
    up_to = np.concatenate([[0], np.cumsum(have)])
    sums = np.concatenate([[0], np.cumsum(have * size)])
    e = np.arange(0, capacity // 2 + 1)
    large = up_to[-1] - up_to[capacity - e + 1]
    middle = sums[capacity - e + 1] - sums[e]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((have * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: the fullest bin with room, else a new one; longest items first, ties in input order."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        if left := room - size:
            open_bins[left].append(at)
            rooms |= 1 << left
        bins[i] = at
    return bins


def _pack_partition(table: pa.Table, capacity: int) -> pa.Table:
    """Adds the bin of each piece, its place there, whether it is the first of its bin, and whether the bin is given up: of a partition with a gap the emptiest bins with half of its pieces, of others the emptiest one."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    lengths = table["length"].to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    released = np.zeros(len(filled), bool)
    order = np.argsort(filled, kind="stable")
    if len(filled) > min(lower_bound(lengths, capacity), -(-int(filled.sum()) // capacity)):
        pieces_up_to = np.cumsum(np.bincount(bins)[order])
        released[order[: int(np.searchsorted(pieces_up_to, len(bins) / 2)) + 1]] = True
    else:
        released[order[:1]] = filled[order[:1]] < capacity
    # The pieces of a bin lie in it in the order in which they are sorted.
    by_bin = np.argsort(bins, kind="stable")
    ahead = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]])
    offset = np.empty(len(bins), np.int64)
    offset[by_bin] = ahead - np.maximum.accumulate(np.where(first, ahead, 0))
    opens = np.zeros(len(bins), bool)
    opens[by_bin[first]] = True
    for name, values in (("bin", bins), ("offset", offset), ("first", opens), ("released", released[bins])):
        table = table.append_column(name, pa.array(values))
    return table


def _packed(pieces: DataFrame, round_no: int, capacity: int, parts: int, total: int, position: str | None) -> DataFrame:
    if position:
        part = F.expr(f"cast(coalesce(`{position}`, 0) as decimal(38, 0)) * {parts} div {max(total, 1)}").cast("long")
    else:  # repeated rows differ by where they lie in the table that is read
        part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no), F.monotonically_increasing_id()), F.lit(parts))
    dealt = pieces.select(*pieces.columns, part.alias("part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", bin bigint, offset bigint, first boolean, released boolean"
    out = dealt.groupBy("part").applyInArrow(lambda table: _pack_partition(table, capacity), schema)
    # By where the partition begins among those of the first round, then by round.
    return out.withColumn("sequence_id", (F.col("part") * F.lit(2 ** (36 + round_no)) + F.lit(round_no) * F.lit(2**31) + F.col("bin")).cast("long")).drop("bin", "part")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, position: str | None = None) -> DataFrame:
    """pieces (PIECE_SCHEMA; lengths 1 to capacity) with sequence_id and offset; further columns are left out, but for position.

    position: a column (0 to the number of documents - 1, null as 0) of which partitions are consecutive stretches; neighbours exchange, and
    sequence_id follows it stretch by stretch. Without one pieces are dealt by a hash. Repeated rows are packed as rows of their own, over all partitions; an empty table gives an empty table.
    sequence_id is unique, not dense. Pieces as long as the capacity are sequences of their own.
    """
    columns = [f.split()[0] for f in PIECE_SCHEMA.split(", ")] + ([position] if position else [])
    pieces = pieces.select(*columns)
    sequences = pieces.filter(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("offset"), (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"))
    current = pieces.filter(F.col("length") < capacity)
    total = pieces.agg(F.coalesce(F.max(position), F.lit(0)) + 1).first()[0] if position else 0
    have = np.zeros(capacity + 1, np.int64)
    for r in current.groupBy("length").count().collect():  # a row for each length, fewer than the capacity
        have[r.length] = r["count"]
    parts, round_no, left = max(1, -(-int(have.sum()) // per_partition)), 0, bound_of_counts(have, capacity)
    while True:
        packed = materialize(_packed(current, round_no, capacity, parts, total, position), "packed")
        bins, given_up = packed.agg(F.count_if("first"), F.count_if(F.col("first") & F.col("released"))).first()
        if parts == 1 or bins <= left or not given_up:  # nobody to exchange with, or nothing to gain
            return sequences.unionByName(packed.drop("first", "released"))
        sequences = sequences.unionByName(packed.filter("NOT released").drop("first", "released"))
        current, left = packed.filter("released").select(*columns), left - (bins - given_up)
        parts, round_no = -(-parts // 2), round_no + 1


def document_pieces(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, position: str | None = None) -> DataFrame:
    """The pieces of every whole text; only documents longer than the capacity are cut, the first piece being the short one.

    A null or empty text is the end id alone. position: a column of documents that is kept beside the pieces, as position.
    """
    kept = ["position"] if position else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, tokens.cut_before_words).encode
        for batch in (part for whole in batches for part in slices(whole, 256)):
            ids, count = tokens.append_end(*encode(batch.column("text").to_pylist()), end_id)
            pieces = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = count - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (np.cumsum(count) - count)[row] + start
            data = ids.astype("<u4")
            crc = [zlib.crc32(data[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *(batch.column(c).take(pa.array(row)) for c in kept)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *kept],
            )

    beside = [F.col(f"`{position}`").cast("long").alias("position")] if position else []
    return documents.select("doc_id", "text", *beside).mapInArrow(run, ", ".join([PIECE_SCHEMA, *(f"{c} bigint" for c in kept)]))


def in_written_order(documents: DataFrame) -> tuple[DataFrame, str | None]:
    """doc_id, text and position of documents read from a Parquet table of Spark's, and that column's name: rows count on from file to file in the order of the parts. Without files behind them there is no position."""
    try:
        rows = documents.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return documents.select("doc_id", "text"), None
    rows = rows.withColumn("file", F.expr("try_cast(file AS bigint)"))
    counts = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))  # a row for each file
    ahead = counts.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(ahead), F.expr("file <=> f")).select("doc_id", "text", (F.col("ahead") + F.col("row")).alias("position")), "position"


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, position: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there; position as in pack()."""
    pieces = materialize(document_pieces(documents, tokenizer, end_id, capacity, position), "pieces")
    out = pack(pieces, capacity, position="position" if position else None)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
