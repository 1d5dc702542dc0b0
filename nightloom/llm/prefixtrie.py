"""The trie of conversation prefixes, by fingerprints that can be composed.

A turn is an affine map of 64-bit numbers with an odd factor (two of them, from the turn's digest), a sequence of turns the product
of its maps. Products can be inverted, so the fingerprint of any stretch of a conversation follows from two running products, and that of a
rebuilt conversation (the head of another one and a stretch of its own) from products alone: no text is moved. A node of the trie is a group
of equal fingerprints and depths; that its members are equal is verified by the 256-bit digests of the turns that they refer to and by
their parents, node by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Turns of one conversation under one key, and ids that are hashed from one string.
BLOCK = 1024
#: A node with more than 1 of so many children is broadcast to them; there are fewer such nodes than this.
HOT = 10_000

_MAPS = ["a0", "b0", "a1", "b1"]
_DIGEST = ["d0", "d1", "d2", "d3"]
_NODE = ["depth", "f0", "f1", "f2", "f3"]


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of odd numbers modulo 2**64, by Newton's method."""
    x = a * np.uint64(3) ^ np.uint64(2)
    for _ in range(4):
        x = x * (np.uint64(2) - a * x)
    return x


def compose(first: list[np.ndarray], then: list[np.ndarray]) -> list[np.ndarray]:
    """The map x -> a x + b of one sequence and then another, two of them side by side."""
    (a, b, c, d), (p, q, r, s) = first, then
    return [a * p, b * p + q, c * r, d * r + s]


def invert(maps: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d = maps
    i, j = _inverse(a), _inverse(c)
    return [i, np.uint64(0) - b * i, j, np.uint64(0) - d * j]


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


def _running(maps: list[np.ndarray]) -> list[np.ndarray]:
    """The products of the first 1, 2, ... maps of a batch."""
    out = []
    for a, b in (maps[:2], maps[2:]):
        product = np.multiply.accumulate(a)
        out += [product, product * np.cumsum(b * _inverse(product))]
    return out


def _turn_maps(digest: list[np.ndarray], seed: int) -> list[np.ndarray]:
    salt = np.frombuffer(hashlib.sha256(str(seed).encode()).digest(), np.uint64) | np.uint64(1)
    mixed = [d * k for d, k in zip(digest, salt, strict=True)]
    mixed = [d ^ (d >> np.uint64(29)) for d in mixed]
    return [mixed[0] | np.uint64(1), mixed[1], mixed[2] | np.uint64(1), mixed[3]]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_words and digest of every turn; null roles and texts are empty. Rows without a conv_id are left out. Texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.size(words_of(text)).cast("long").alias("n_words"), digest.alias("digest"))


def placed_turns(turns: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, pos (from 1), n_words, digest columns, and in the map columns the product of the conversation's first pos turns.

    Turns are ordered by turn (null first), then by digest. They are dealt in ranges of that order, so a conversation of any length is spread over
    tasks; each task multiplies its own stretch, and what lies ahead of it follows from one product for each task, which the driver sees.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    # Rows that are alike in all of the order may lie in either of two ranges.
    ranged = turns.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any")
    names = ["part", "conv_id", "pos", "n_words", *_DIGEST, *_MAPS]

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, product = None, 0, [np.uint64(1), np.uint64(0)] * 2  # of the conversation that the batch before ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            digest = list(np.ascontiguousarray(np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 4).T))
            running = _running(_turn_maps(digest, seed))
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            begin = np.repeat(first, np.diff(np.concatenate([first, [len(conv)]])))
            # What the batch holds ahead of a conversation is taken off, what the batch before holds of it is put on.
            ahead = [np.where(begin > 0, x[begin - 1], one) for x, one in zip(running, [np.uint64(1), np.uint64(0)] * 2, strict=True)]
            own = compose(invert(ahead), running)
            pos = np.arange(len(conv)) - begin + 1
            if last == conv[0]:
                on = begin == 0
                own = [np.where(on, j, o) for j, o in zip(compose([np.full(len(conv), x) for x in product], own), own, strict=True)]
                pos = np.where(on, pos + at, pos)
            last, at, product = int(conv[-1]), int(pos[-1]), [x[-1] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(pos), batch.column("n_words"), *(pa.array(x.view(np.int64)) for x in [*digest, *own])], names=names)

    kinds = ", ".join(f"{c} {'int' if c == 'part' else 'bigint'}" for c in names)
    local = materialize(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "n_words", "digest").mapInArrow(stretch, kinds), "stretches")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "pos", *_MAPS)).alias("end")).orderBy("part").collect()  # a row for each task
    ahead: dict[int, tuple[int, int, list[int]]] = {}
    carried = None  # conversation, turns and product up to here
    as_maps = lambda values: [np.array([v], np.int64).view(np.uint64) for v in values]
    for r in ends:
        end = (r.end.conv_id, r.end.pos, [r.end[c] for c in _MAPS])
        if carried and carried[0] == r.low:
            ahead[r.part] = carried
            if end[0] == r.low:
                end = (end[0], carried[1] + end[1], [int(x.view(np.int64)[0]) for x in compose(as_maps(carried[2]), as_maps(end[2]))])
        carried = end

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            pos, own = batch.column("pos").to_numpy().copy(), _columns(batch, _MAPS)
            for p in np.unique(part).tolist():
                if p in ahead:
                    c, n, product = ahead[p]
                    on = (part == p) & (conv == c)
                    pos[on] += n
                    own = [np.where(on, j, o) for j, o in zip(compose(as_maps(product), own), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos), batch.column("n_words"), *(batch.column(c) for c in _DIGEST), *(pa.array(x.view(np.int64)) for x in own)], names=names[1:])

    return local.mapInArrow(join, ", ".join(f"{c} bigint" for c in names[1:]))


def rebuilt(placed: DataFrame, seed: int = 0) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth (from 0), its fingerprint f0 to f3, p0 to p3 of the prefix before it, n_words and digest of its last turn.

    A conversation's turns are joined to what is rebuilt ahead of them in blocks of BLOCK turns.
    """
    # Heads are three turns at most.
    head = placed.filter("pos <= 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n_words", *_DIGEST, *_MAPS))).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).join(head, "conv_id").withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    joined = convs.join(head.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head")), "base", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("base_head"), F.lit(0)))
    info = materialize(joined.select("conv_id", "n", "h", taken.alias("taken"), F.slice(F.coalesce("base_head", F.slice("head", 1, 0)), F.lit(1), taken).alias("base_head"), F.slice("head", F.lit(1), "h").alias("cut")), "rebuilt")

    names = ["conv_id", "depth", *(f"f{k}" for k in range(4)), *(f"p{k}" for k in range(4)), "n_words", *_DIGEST]
    one = [F.lit(1 if m[0] == "a" else 0).cast("long") for m in _MAPS]
    maps = lambda t, letter: [F.coalesce(t[m], one[k]).alias(f"{letter}{k}") for k, m in enumerate(_MAPS)]
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), *[o.alias(f"{x}{k}") for x in "fp" for k, o in enumerate(one)], *[F.lit(0).cast("long").alias(c) for c in ("n_words", *_DIGEST)])
    heads = info.select("conv_id", F.posexplode("base_head").alias("at", "t"), F.when(F.col("at") > 0, F.get("base_head", F.col("at") - 1)).alias("b"))
    heads = heads.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), *maps(F.col("t"), "f"), *maps(F.col("b"), "p"), "t.n_words", *[f"t.{d}" for d in _DIGEST])

    # The head's product and that of the own turns that are left out, then the product of the own turns up to here.
    ahead = info.filter("n > h").select("conv_id", "h", "taken", *maps(F.get("base_head", F.col("taken") - 1), "x"), *maps(F.get("cut", F.col("h") - 1), "c"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    own = placed.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}")).join(ahead, ["conv_id", "block"]).filter("pos > h")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = compose(_columns(batch, [f"x{k}" for k in range(4)]), invert(_columns(batch, [f"c{k}" for k in range(4)])))
            whole = compose(before, _columns(batch, _MAPS))
            parent = compose(whole, invert(_turn_maps(_columns(batch, _DIGEST), seed)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), *(pa.array(x.view(np.int64)) for x in [*whole, *parent]), batch.column("n_words"), *(batch.column(d) for d in _DIGEST)], names=names)

    tails = own.select("conv_id", "depth", "n_words", *_DIGEST, *_MAPS, *[f"{x}{k}" for x in "xc" for k in range(4)]).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return root.unionByName(heads.select(*names)).unionByName(tails)


def _grouped(members: DataFrame) -> DataFrame:
    """A row for each node: smallest member conv_id, n_convs, n_words of its last turn, its parent, and same: whether all members agree in their last turn and parent."""
    agreed = [*_DIGEST, *(f"p{k}" for k in range(4))]
    found = members.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"), *[F.min(c).alias(c) for c in agreed], *[F.max(c).alias(f"{c}_") for c in agreed])
    same = F.lit(True)
    for c in agreed:
        same = same & (F.col(c) == F.col(f"{c}_"))
    return found.select(*_NODE, "conv_id", "n_convs", "n_words", *[f"p{k}" for k in range(4)], same.alias("same"))


def _ids_hashed(ends: DataFrame) -> DataFrame:
    """_NODE columns and ends_sha256 of ends(_NODE, conv_id): ids are joined in ranges of their order, strings of up to BLOCK ids; a node's strings are then hashed one after the other, never held together."""
    order = [*_NODE, "conv_id"]
    kinds = ", ".join(f"{c} bigint" for c in _NODE)
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.stack([batch.column(c).to_numpy() for c in _NODE])
            conv = batch.column("conv_id").to_pylist()
            first = np.flatnonzero(np.concatenate([[True], (node[:, 1:] != node[:, :-1]).any(0)]))
            cuts = [a for x, y in zip(first.tolist(), [*first[1:].tolist(), len(conv)], strict=True) for a in range(x, y, BLOCK)]
            texts = [",".join(map(str, conv[a:b])) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(n[cuts]) for n in node), pa.array([conv[a] for a in cuts], pa.int64()), pa.array(texts, pa.string())], names=[*_NODE, "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"]), strict=True):
                if key != node:
                    if node is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield _batch(rows)
        if node is not None:
            yield _batch([(*node, digest.hexdigest())])

    joined = ranged.mapInArrow(pieces, f"{kinds}, conv_id bigint, ids string")
    return joined.repartition(*_NODE).sortWithinPartitions(*order).select(*_NODE, "ids").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[*_NODE, "ends_sha256"])


def trie(conversations: DataFrame, hot: int | None = None) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id with depth names a node, by its smallest member. Repeated rows are turns of their own; turns alike in turn are ordered by the SHA-256 of role and text. Rows without a
    conv_id are left out; a table without others gives an empty trie. Extra columns are left out. hot: children beyond which a node is broadcast to them (by default so many that fewer
    than HOT nodes are).

    A node's sums over its subtree: the nodes with one smallest member make up a chain, and a subtree is the chains of its members, less what its own chain has above it. So they
    follow from chains' sums, added up over members; nothing is done depth by depth.
    """
    turns = turns_of(conversations)
    for seed in count():
        members = materialize(rebuilt(materialize(placed_turns(turns, seed), "placed"), seed), "members")
        nodes = materialize(_grouped(members), "grouped")
        if nodes.filter("NOT same").isEmpty():  # else two prefixes share a fingerprint: once more with other maps
            break
    parent = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(f"f{k}") for k in range(4)]]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_words"), "leaf": (F.col("n_children") == 0).cast("long"), "block": F.expr(f"depth div {BLOCK}")})

    # What a chain has above each of its nodes: by blocks, then within a block.
    parts = ["saved", "leaf"]
    blocks = nodes.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"{c}_block") for c in parts], F.min("depth").alias("top"))
    over = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.min("top").over(W.partitionBy("conv_id")).alias("top"), *[F.coalesce(F.sum(f"{c}_block").over(over), F.lit(0)).alias(f"{c}_ahead") for c in parts])
    within = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    nodes = nodes.withColumns({f"{c}_within": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in parts}).join(blocks, ["conv_id", "block"])
    nodes = materialize(nodes.withColumns({f"{c}_above": F.col(f"{c}_ahead") + F.col(f"{c}_within") for c in parts}), "nodes")

    chains = nodes.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in parts])
    ends = members.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("end"))  # the whole conversation
    sums = ends.join(chains, "conv_id").select("conv_id", *parts, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"end.depth div {BLOCK}"))).alias("block"))
    below = members.select("conv_id", *_NODE, F.expr(f"depth div {BLOCK}").alias("block")).join(sums, ["conv_id", "block"]).groupBy(*_NODE).agg(*[F.sum(c).alias(f"{c}_below") for c in parts])

    # A chain's first node hangs on another chain: the smallest member of its parent. Parents of very many chains are broadcast.
    top = nodes.filter("depth = top AND depth > 0").select("conv_id", "depth", *[F.col(f"p{k}") for k in range(4)])
    by = ["depth", *(f"p{k}" for k in range(4))]
    named = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(f"f{k}").alias(f"p{k}") for k in range(4)], F.col("conv_id").alias("parent_conv_id"), "n_children")
    limit = max(1000, nodes.count() // HOT) if hot is None else hot
    many = F.broadcast(named.filter(F.col("n_children") > limit).drop("n_children"))
    few = named.filter(F.col("n_children") <= limit).drop("n_children")
    hung = top.join(many, by).unionByName(top.join(many, by, "left_anti").join(few, by)).select("conv_id", "depth", "parent_conv_id")

    out = nodes.join(below, _NODE).join(_ids_hashed(ends.select("end.*", "conv_id")), _NODE, "left").join(hung, ["conv_id", "depth"], "left")
    parent_id = F.when(F.col("depth") == 0, None).otherwise(F.coalesce("parent_conv_id", "conv_id"))
    return out.select(
        "conv_id", "depth", parent_id.cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaf_below") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("saved_below") - F.col("saved_above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(b))),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM turns GROUP BY conv_id), steps),
heads AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
built AS (
  SELECT * FROM heads
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + coalesce(k.n, 0), t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id) k ON k.conv_id = c.conv_id),
paths AS (
  SELECT conv_id, depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path, text FROM built
  UNION ALL SELECT conv_id, 0, [], '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS n_words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY depth, path),
members AS (SELECT p.conv_id AS member, n.conv_id, n.depth FROM paths p JOIN nodes n USING (depth, path)),
above AS (SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM above WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM above a LEFT JOIN children USING (conv_id, depth)),
sums AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.n_words) AS saved_tokens
  FROM whole u JOIN members m ON m.member = u.conv_id AND m.depth <= u.depth GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM whole JOIN sums USING (conv_id, depth)
"""
