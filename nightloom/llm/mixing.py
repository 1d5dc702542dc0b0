"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of about equal bytes. A source of weight w gets for its
j-th block the window from floor(j / w) to ceil((j + 1) / w); giving every slot to the
released block of the earliest deadline meets all deadlines, so after any number of slots each source has its
share to within less than one block. Weights are whole numbers of 2**-40, so windows follow the targets
themselves and are exact. When a source has no block left, a new phase begins with the weights of the others scaled
up: every document is mixed in exactly once. The driver schedules blocks, never documents: there are at most
SCHEDULE_BLOCKS of them (and one for each source), so blocks grow with the input. Documents are placed by narrow rows of id, hash and size;
texts are moved only to be written in the order of the mixture.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a block at least, and how many blocks the driver schedules (besides one for each source).
BLOCK_BYTES = 256 * 1024
SCHEDULE_BLOCKS = 2**18
#: Without given weights those of the sources' sizes to this power.
TEMPERATURE = 0.5
#: Pieces of the hash range by which documents of one source are added up.
PIECES = 4096
#: Weights are whole numbers that add up to this.
UNIT = 2**40

SLOTS = pa.schema([("source", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])


def shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole-number weights that add up to UNIT, by largest remainder; at least 1 each."""
    total = sum(weights.values())
    exact = {s: max(w / total * UNIT, 1.0) for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    over = UNIT - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(over, 0)]:
        out[s] += 1
    if over < 0 or over > len(out):  # minimal weights, or the rounding of a float, at the cost of the heaviest
        out[max(out, key=lambda s: (out[s], s))] += UNIT - sum(out.values())
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> pa.Table:
    """The slot of each block (SLOTS); release and deadline count from the start of the mixture. Weights must be over 0."""
    if any(not weights.get(s, 0) > 0 for s in blocks):
        raise ValueError("each source needs a weight over 0")
    left = {s: n for s, n in blocks.items() if n}
    names = sorted(left)
    number = {s: k for k, s in enumerate(names)}
    rows: list[tuple[int, int, int, int, int, int]] = []
    done, slot, phase = dict.fromkeys(left, 0), 0, 0
    while left:
        share, base = shares({s: weights[s] for s in left}), slot
        waiting = [(0, s, 0) for s in sorted(left)]  # release, source, block of the phase
        ready: list[tuple[int, str, int]] = []
        ended = False
        while not ended:
            now = slot - base
            while waiting and waiting[0][0] <= now:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * UNIT // share[s]), s, j))
            deadline, s, j = heapq.heappop(ready)
            if deadline <= now:
                raise AssertionError("a block is late")
            rows.append((number[s], done[s], phase, slot, base + j * UNIT // share[s], base + deadline))
            done[s], slot = done[s] + 1, slot + 1
            heapq.heappush(waiting, ((j + 1) * UNIT // share[s], s, j + 1))
            ended = done[s] == left[s]
        del left[s]
        phase += 1
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    source = pa.array(names, pa.string()).take(pa.array(columns[0])) if names else pa.array([], pa.string())
    return pa.table([source, *(pa.array(c).cast(f.type) for c, f in zip(columns[1:], list(SLOTS)[1:], strict=True))], schema=SLOTS)


def _places(documents: DataFrame, pieces: int) -> DataFrame:
    """doc_id, fp, _source, _order and _begin (bytes of the source's documents before it) of each document, repeated rows once.

    Documents follow each other in the order of a hash of their ids. Bytes are added up in pieces of the hash range, so no task
    adds up a whole source. A null source is a source of its own, a null text has no bytes; each row counts one byte more.
    """
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null")))
    rows = (
        documents.select("doc_id", F.xxhash64("text").alias("fp"), F.coalesce(F.col("source"), F.lit("\x00null")).alias("_source"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("_bytes"))
        .groupBy("doc_id", "fp", "_source").agg(F.sum("_bytes").alias("_bytes"))
        .withColumn("_order", order).withColumn("_piece", F.shiftrightunsigned("_order", 64 - (pieces - 1).bit_length()))
    )
    before = W.partitionBy("_source").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("_source", "_piece").agg(F.sum("_bytes").alias("_sum")).select("_source", "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("_source", "_piece").orderBy("_order", "doc_id", "fp").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_ahead", F.coalesce(F.sum("_bytes").over(within), F.lit(0))).join(base, ["_source", "_piece"])
        .select("doc_id", "fp", "_source", "_order", (F.col("_base") + F.col("_ahead")).alias("_begin"))
    )


def place_documents(documents: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES, pieces: int = PIECES) -> DataFrame:
    """doc_id, fp (hash of the text), _source, _order, block, phase, slot, release, deadline of each document, repeated rows once.

    weights: by source, by default the power TEMPERATURE of its bytes; only ratios count. A document belongs to the block that it begins
    in; a block within a longer document stays empty, and its slot unused. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    totals = (
        documents.groupBy(F.coalesce(F.col("source"), F.lit("\x00null")).alias("s"))
        .agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("n")).collect()  # a row for each source
    )
    block_bytes = max(block_bytes, -(-sum(r.n for r in totals) // SCHEDULE_BLOCKS))
    blocks = {r.s: -(-r.n // block_bytes) for r in totals}
    wanted = {s: weights.get(s, 0) for s in blocks} if weights is not None else {r.s: float(r.n) ** TEMPERATURE for r in totals}
    slots = spark.createDataFrame(schedule(blocks, wanted)).withColumnRenamed("source", "_source")
    placed = _places(documents, pieces).withColumn("block", F.floor(F.col("_begin") / F.lit(block_bytes)).cast("long")).drop("_begin")
    return placed.join(slots, ["_source", "block"])


def _with_places(documents: DataFrame, places: DataFrame) -> tuple[DataFrame, str]:
    """documents beside a struct of their places, and its name, which no column of documents begins with."""
    name = "_p"
    while any(c.startswith(name) for c in documents.columns):
        name += "_p"
    at = places.select(F.col("doc_id").alias(f"{name}1"), F.col("fp").alias(f"{name}2"), F.col("_source").alias(f"{name}3"), F.struct("_order", "fp", "block", "phase", "slot", "release", "deadline").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(f"{name}1")) & (F.xxhash64("text") == F.col(f"{name}2")) & (F.coalesce("source", F.lit("\x00null")) == F.col(f"{name}3"))
    return documents.join(at, same), name


def schedule_documents(documents: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with block, phase, slot, release and deadline; columns of these names are replaced. Every row is kept; repeated rows share their place."""
    documents = documents.drop("block", "phase", "slot", "release", "deadline")
    both, p = _with_places(documents, place_documents(documents, weights, block_bytes))
    return both.select(*documents.columns, f"{p}.block", f"{p}.phase", f"{p}.slot", f"{p}.release", f"{p}.deadline")


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents, each once, in the order of the mixture."""
    both, p = _with_places(documents, place_documents(documents, weights, block_bytes))
    return both.orderBy(f"{p}.slot", f"{p}._order", "doc_id", f"{p}.fp").select(*documents.columns)


def document_slots(documents: DataFrame) -> DataFrame:
    """doc_id, source, block, phase, slot, release, deadline of every document. No text is moved."""
    rows = documents.select("doc_id", "source", F.xxhash64("text").alias("fp"), F.coalesce("source", F.lit("\x00null")).alias("key"))
    at = place_documents(documents).select(F.col("doc_id").alias("id"), F.col("fp").alias("text_fp"), "_source", "block", "phase", "slot", "release", "deadline")
    return rows.join(at, F.expr("doc_id <=> id AND fp = text_fp AND key = _source")).select("doc_id", "source", "block", "phase", "slot", "release", "deadline")
