"""Sharding by rendezvous hashing over weighted shards.

Each (key, shard) pair gets a uniform draw from a hash; the shard with the least
``-ln(draw) / weight`` holds the key. A shard that is added can only take keys
to itself, and takes its share of the total weight of them. All of it is SQL expressions on one row,
so the only shuffle numbers the rows of each shard.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh

#: Pieces into which every shard is cut to number its rows.
PIECES = 4096
_BITS = 52


def hash52(text: Column) -> Column:
    """The first 52 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of each key. A null key is a key of its own; shards of weight 0 or less get nothing."""
    name = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = [
        F.struct(
            (-F.log((hash52(F.concat(name, F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(float(2**_BITS))) / F.lit(float(weight))).alias("score"),
            F.lit(int(shard)).alias("shard"),
        )
        for shard, weight in sorted(weights.items())
        if weight > 0
    ]
    if not scores:
        raise ValueError("no shard has a weight over 0")
    return F.array_min(F.array(*scores))["shard"]


def assign(
    rows: DataFrame,
    key: str,
    weights: Mapping[int, float],
    grown: Mapping[int, float] | None = None,
    ties: tuple[str, ...] = (),
    pieces: int = PIECES,
) -> DataFrame:
    """rows with shard int, slot long (0, 1, ... in each shard) and grown_shard int.

    grown: the weights after a change of the shards (null column without it).
    Rows of one key go to one shard; repeated rows get slots of their own, by the
    columns in ties. Rows are numbered in pieces of the hash range, so no task holds a
    whole shard; what is broadcast has at most shards x pieces rows. Rows of one
    hot key share a piece. An empty table gives an empty table. Columns of rows
    named like the new ones are replaced, all others are kept.
    """
    own = fresh(rows.columns, "_at")
    order, piece, rank, ahead = (f"{own}{k}" for k in range(4))
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    placed = rows.withColumns(
        {
            "shard": rendezvous(F.col(key), weights),
            "grown_shard": rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int"),
            order: hash52(name),
        }
    ).withColumn(piece, F.shiftright(order, _BITS - (pieces - 1).bit_length()))
    before = W.partitionBy("shard").orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    base = (
        placed.groupBy("shard", piece)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    )
    within = W.partitionBy("shard", piece).orderBy(order, key, *ties)
    return (
        placed.withColumn(rank, F.row_number().over(within) - 1)
        .join(F.broadcast(base), ["shard", piece])
        .withColumn("slot", (F.col(ahead) + F.col(rank)).cast("long"))
        .drop(order, piece, rank, ahead)
    )


def document_shards(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """The shards of documents by doc_id under equal weights, with one more shard to compare.

    A null text counts as empty (size 1, checksum 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    one = dict.fromkeys(range(n_shards), 1.0)
    out = assign(rows, "doc_id", one, one | {n_shards: 1.0}, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SHARDS_SQL = """
WITH draws AS (
  SELECT doc_id, text, s, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM documents, range(9) AS r(s)),
placed AS (
  SELECT doc_id, any_value(text) AS text, arg_min(s, score) FILTER (s < 8) AS shard, arg_min(s, score) AS grown_shard
  FROM draws GROUP BY doc_id),
bytes AS (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM placed),
steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(b))),
rolled AS (
  SELECT bytes.*, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c
  FROM bytes, steps)
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, xor(c, 4294967295)::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT, doc_id) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM rolled
"""
