"""Cropped and edited copies of images by local descriptors.

Corners (Harris) are found on several scales; each gets an orientation from its patch's centre of brightness and
256 binary tests in a pattern turned by it. Each of the tables holds one band of the bits; descriptors that differ in fewer bits than
there are tables agree on a band for certain, others mostly. Those that meet in a table match if their Hamming distance on all bits is
small enough. A pair of matched corners proposes a turn, a scale and a shift; images are linked where enough distinct corners propose
the same. In a table's bucket images are first held against hubs: against the smallest image, then against the smallest of what is not
yet in its class. What still lies in different classes is then held all against all: by single corners where few rows share a bucket, elsewhere
by pairs of an image's corners, of which unlike images share few. So classes are those of all pairs that meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, release, small
from .components import connected

SIDE = 64
#: Scales, and how many of the strongest corners are described on each.
SCALES = {1.0: 16, 0.75: 12, 0.5: 8}
BITS, BANDS, WORDS = 256, 8, 4
#: Bits in which matching descriptors differ at most.
DISTANCE = 28
RADIUS = 14
MIN_VOTES = 4
#: Rounds against hubs before the rest of the buckets is compared.
ROUNDS = 2
#: Rows of a bucket that all meet each other, at least, and how often they are doubled at most; in larger buckets pairs of corners meet.
LIGHT_ROWS, LIGHT_DOUBLINGS = 16, 8
#: Meetings of rows, counted for both orders, that cost as much as a pair of an image's rows; about as measured.
PAIR_COST = 64
#: Parts of the larger buckets. MIN_VOTES - 1 corners in them leave two in one part.
HALVES = MIN_VOTES - 2
#: Rows of a key that are held at once against as many others.
BLOCK_ROWS = 512
#: Tables that are joined at once where corners are many.
TABLES_AT_ONCE = 2
#: Bins of a proposal: degrees, halves of scale doublings, pixels.
TURN_BIN, SCALE_BIN, SHIFT_BIN = 30.0, 0.5, 10.0

#: Of each image the corners' places and their bits, WORDS in a row.
_POINTS = "image_id bigint, digest string, places array<int>, bits array<bigint>"


def _pattern() -> np.ndarray:
    """The pairs of points of the binary tests: (BITS, 2, 2) within RADIUS, by a fixed linear congruence."""
    x = np.empty(BITS * 4)
    state = 12345
    for i in range(len(x)):
        state = (1103515245 * state + 12345) % 2**31
        x[i] = state / 2**31
    radius, turn = RADIUS * np.sqrt(x[::2]), 2 * np.pi * x[1::2]
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], 1).reshape(BITS, 2, 2)


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
    p = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 16


def _window_max(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, ((0, 0), (r, r), (r, r)), mode="constant", constant_values=-np.inf)
    rows = np.maximum.reduce([p[:, k : k + a.shape[1]] for k in range(2 * r + 1)])
    return np.maximum.reduce([rows[:, :, k : k + a.shape[2]] for k in range(2 * r + 1)])


def describe(images: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """x, y, angle, scale and bits of the corners of each image (n, h, w), in pixels of the image given; flat images have none."""
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in images]
    pattern = _pattern()
    grid = np.arange(-5, 6)
    disc = (grid[:, None] ** 2 + grid[None, :] ** 2) <= 30
    for scale, most in SCALES.items():
        a = images if scale == 1 else _scaled(images, scale)
        a = _blur(a)
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = (_blur(_blur(v)) for v in (gx * gx, gy * gy, gx * gy))
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        margin = 6
        inner = np.full(strength.shape, False)
        inner[:, margin:-margin, margin:-margin] = True
        peak = inner & (strength >= _window_max(strength, 2)) & (strength > 1e-4 * np.maximum(strength.max(axis=(1, 2), keepdims=True), 1e-3))
        n, y, x = np.nonzero(peak)
        order = np.lexsort((x, y, -strength[n, y, x], n))
        n, y, x = n[order], y[order], x[order]
        rank = np.arange(len(n)) - np.searchsorted(n, n)
        n, y, x = (v[rank < most] for v in (n, y, x))
        if not len(n):
            continue
        patch = a[n[:, None, None], y[:, None, None] + grid[:, None], x[:, None, None] + grid[None, :]] * disc
        angle = np.arctan2((patch * grid[:, None]).sum((1, 2)), (patch * grid[None, :]).sum((1, 2)))
        turned = np.stack(
            [
                np.cos(angle)[:, None, None] * pattern[None, :, :, 0] - np.sin(angle)[:, None, None] * pattern[None, :, :, 1],
                np.sin(angle)[:, None, None] * pattern[None, :, :, 0] + np.cos(angle)[:, None, None] * pattern[None, :, :, 1],
            ],
            -1,
        )
        px = np.clip(np.rint(x[:, None, None] + turned[..., 0]).astype(int), 0, a.shape[2] - 1)
        py = np.clip(np.rint(y[:, None, None] + turned[..., 1]).astype(int), 0, a.shape[1] - 1)
        value = a[n[:, None, None], py, px]
        bits = np.packbits(value[..., 0] < value[..., 1], axis=1)
        for k in np.unique(n):
            own = n == k
            found[k].append((x[own] / scale, y[own] / scale, angle[own], np.full(own.sum(), scale), bits[own]))
    nothing = (np.zeros(0),) * 4 + (np.zeros((0, BITS // 8), np.uint8),)
    return [tuple(np.concatenate(v) for v in zip(*f, strict=True)) if f else nothing for f in found]


def _scaled(images: np.ndarray, scale: float) -> np.ndarray:
    def matrix(n: int) -> np.ndarray:
        m = max(16, round(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), n - 2)
        out = np.zeros((m, n))
        out[np.arange(m), low] = 1 - (at - low)
        out[np.arange(m), low + 1] += at - low
        return out

    return matrix(images.shape[1]) @ images @ matrix(images.shape[2]).T


def render(values: np.ndarray) -> np.ndarray:
    """Images (n, SIDE, SIDE) of 0 to 255 from square grids of brightness given row by row (n, k * k)."""
    k = int(round(values.shape[1] ** 0.5))
    a = np.repeat(np.repeat(values.reshape(-1, k, k), SIDE // k, 1), SIDE // k, 2)
    a = _blur(_blur(a))
    low, high = a.min((1, 2), keepdims=True), a.max((1, 2), keepdims=True)
    return np.rint(255 * (a - low) / np.maximum(high - low, 1e-9))


def placed_bits(corners: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The places (x, y, angle and scale in one number) and the bits of an image's corners."""
    x, y, angle, scale, bits = corners
    step = np.array([list(SCALES).index(s) for s in scale], np.int64)
    turn = np.rint(angle / (2 * np.pi) * 256).astype(np.int64) % 256
    places = ((np.rint(x).astype(np.int64).clip(0, 127) * 128 + np.rint(y).astype(np.int64).clip(0, 127)) * 256 + turn) * 4 + step
    return places.astype(np.int32), np.ascontiguousarray(bits).view(">i8").astype(np.int64).ravel()


def _buckets() -> Column:
    """The keys of a corner's bits in all tables: a half of a word, and which."""
    halves = [half for k in range(WORDS) for half in (F.shiftrightunsigned(f"w{k}", 32), F.col(f"w{k}").bitwiseAND(F.lit(2**32 - 1)))]
    return F.array(*[half * BANDS + k for k, half in enumerate(halves)])


def points(rows: DataFrame, image_id: str = "image_id", grid: str = "grid") -> DataFrame:
    """_POINTS of images that are given as grids of brightness; null or broken grids (other than 64 finite numbers) have no points and no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            lists = batch.column(1).to_pylist()
            good = [k for k, v in enumerate(lists) if v is not None and len(v) == 64 and all(x is not None and abs(x) < 1e30 for x in v)]
            out: list[tuple] = [(None, [], [])] * len(lists)
            if good:
                shown = render(np.array([lists[k] for k in good], float))
                for k, image, corners in zip(good, shown, describe(shown), strict=True):
                    out[k] = (hashlib.sha256(image.astype(np.uint8).tobytes()).hexdigest(), *placed_bits(corners))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in _POINTS.split(", ")])

    return rows.select(F.col(image_id).cast("long"), grid).mapInArrow(run, _POINTS)


def _bins(place_u: str, place_v: str, half: Column) -> list[Column]:
    """The bins of turn, scale and shift that a match proposes; those of the two halves overlap."""

    def part(place: str, low: int, size: int) -> Column:
        return F.expr(f"({place} div {low}) % {size}").cast("double")

    size = F.create_map(*[F.lit(v) for k, scale in enumerate(SCALES) for v in (float(k), scale)])
    turn = (part(place_v, 4, 256) - part(place_u, 4, 256)) * (360 / 256)
    ratio = size[part(place_u, 1, 4)] / size[part(place_v, 1, 4)]
    cos, sin = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    x_u, y_u, x_v, y_v = part(place_u, 1024 * 128, 128), part(place_u, 1024, 128), part(place_v, 1024 * 128, 128), part(place_v, 1024, 128)
    return [
        F.pmod(F.floor(F.pmod(turn, F.lit(360.0)) / TURN_BIN + half), F.lit(int(360 / TURN_BIN))).alias("t"),
        F.floor(F.log2(ratio) / SCALE_BIN + half).alias("r"),
        F.floor((x_v - ratio * (cos * x_u - sin * y_u)) / SHIFT_BIN + half).alias("bx"),
        F.floor((y_v - ratio * (sin * x_u + cos * y_u)) / SHIFT_BIN + half).alias("by"),
    ]


def _consensus(matches: DataFrame) -> DataFrame:
    """Links (u, v) of matches (place_u, place_v) of which MIN_VOTES distinct corners propose one turn, scale and shift; bins overlap by half."""
    proposed = matches.select("u", "v", "place_u", "place_v", F.expr("place_u div 1024").alias("corner"), F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("half"))
    bins = _bins("place_u", "place_v", F.col("half"))
    votes = proposed.select("u", "v", "corner", "half", *bins).distinct().groupBy("u", "v", "half", "t", "r", "bx", "by").agg(F.count(F.lit(1)).alias("votes"))
    return votes.filter(F.col("votes") >= MIN_VOTES).select("u", "v").distinct()


def _near(u: str, v: str) -> Column:
    """Whether two corners of one bucket match: their bits differ little enough, and no earlier table has them in one bucket, so a pair comes once."""
    apart = [f"({u}.w{k} ^ {v}.w{k})" for k in range(WORDS)]
    halves = [half for x in apart for half in (f"shiftrightunsigned({x}, 32)", f"({x} & {2**32 - 1})")]
    first = " AND ".join(f"({u}.bucket % {BANDS} <= {k} OR {half} <> 0)" for k, half in enumerate(halves))
    return F.expr(" + ".join(f"bit_count({x})" for x in apart) + f" <= {DISTANCE} AND {first}")


def _matched(met: DataFrame) -> DataFrame:
    """u, v, place_u, place_v of rows a and b that meet in a bucket, lie in different components and match."""
    near = met.filter(F.expr("a.component <> b.component") & _near("a", "b"))
    return near.select(F.col("a.image_id").alias("u"), F.col("b.image_id").alias("v"), F.col("a.place").alias("place_u"), F.col("b.place").alias("place_v"))


def _some_tables(rows: DataFrame) -> list[DataFrame]:
    """rows of a few tables at a time, of few corners those of all."""
    step = BANDS if small(rows) else TABLES_AT_ONCE
    return [rows.filter(f"bucket % {BANDS} BETWEEN {k} AND {k + step - 1}") for k in range(0, BANDS, step)]


def _by_tables(shared: DataFrame, matches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links from the matches in the buckets of all tables, worked out a few tables at a time (of few corners all) and written, so only theirs are shuffled at once."""
    parts = []
    for rows in _some_tables(shared):
        parts.append(materialize(matches(rows), "matches"))
        release(shared.sparkSession, shared)
    found = reduce(DataFrame.unionByName, parts)
    # Each match is one pair of corners; only images with enough of them can agree on a proposal.
    enough = found.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_VOTES).select("u", "v")
    links = materialize(_consensus(found.join(enough, ["u", "v"])), "links")
    release(shared.sparkSession, shared)
    discard(*parts)
    return links


def _live(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their component and the number n of the bucket's rows."""
    written = None
    for rows in _some_tables(shared):
        placed = _placed(rows, parts)
        bucket = W.partitionBy("bucket")
        among = placed.withColumns({"a": F.min("component").over(bucket), "b": F.max("component").over(bucket), "n": F.count("component").over(bucket)})
        live = among.filter("a <> b").drop("a", "b")
        if written is None:
            written = materialize(live, "live")
        else:
            live.write.mode("append").parquet(written._written)
        release(shared.sparkSession, shared)
    out = shared.sparkSession.read.schema(written.schema).parquet(written._written)
    out._written = written._written
    return out


def _each_with_each(rows: DataFrame, key: str, near: Column) -> DataFrame:
    """Rows a and b of one key, of which there are n. A large key's rows are cut into blocks by a hash, and each block meets each other one by a key of its own."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.col("blocks")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    one = rows.select("*", F.col("block").alias("i"), blocks.alias("j"))
    two = rows.select("*", blocks.alias("i"), F.col("block").alias("j"))
    return one.alias("a").join(two.alias("b"), F.expr(f"a.{key} = b.{key} AND a.i = b.i AND a.j = b.j AND a.component <> b.component") & near)


def _light_rows(live: DataFrame) -> int:
    """Rows of a bucket that all meet each other: the least of LIGHT_ROWS, doubled so often, that costs least by the counts of what meets.

    Buckets grow with the images; at one limit for all the pairs of an image's rows in larger ones would grow with the square of its rows in them, up to all it has.
    """
    levels = [LIGHT_ROWS * 2**k for k in range(LIGHT_DOUBLINGS + 1)]
    own = live.groupBy("image_id").agg(*[f(level) for level in levels for f in (lambda n: F.count_if(F.col("n") > n).alias(f"h{n}"), lambda n: F.sum(F.when(F.col("n") <= n, F.col("n"))).alias(f"c{n}"))])
    cost = [(F.sum(F.col(f"h{n}").cast("double") ** 2) / (2 * HALVES) + F.coalesce(F.sum(f"c{n}"), F.lit(0)) / PAIR_COST).alias(str(n)) for n in levels]
    found = own.agg(*cost).first()
    return min(levels, key=lambda n: (found[str(n)] or 0.0, n))


def _by_light_buckets(live: DataFrame, most: int) -> DataFrame:
    """u, v with two distinct corners of u that match in buckets of at most so many rows, so a row meets a bounded number of others."""
    parts = []
    for rows in _some_tables(live):
        light = rows.filter(F.col("n") <= most)
        matches = _matched(light.alias("a").join(light.alias("b"), F.expr("a.bucket = b.bucket AND a.image_id < b.image_id")))  # each pair once, for both its orders
        parts.append(materialize(matches.select("u", "v", F.expr("place_u div 1024").alias("one"), F.expr("place_v div 1024").alias("two")), "met"))
        release(live.sparkSession, live)
    corners = reduce(DataFrame.unionByName, parts).groupBy("u", "v").agg((F.min("one") < F.max("one")).alias("one"), (F.min("two") < F.max("two")).alias("two")).filter("one OR two")
    ordered = F.expr("explode(array_compact(array(if(one, struct(u, v), NULL), if(two, struct(v AS u, u AS v), NULL))))").alias("p")
    found = materialize(corners.select(ordered).select("p.u", "p.v"), "candidates")
    discard(*parts)
    release(live.sparkSession, live)
    return found


def _by_pairs_of_corners(live: DataFrame, part: int, most: int) -> DataFrame:
    """u, v with two distinct corners of u that match in larger buckets of one of the HALVES and propose the same: what meets are pairs of an image's rows, by both their buckets."""
    heavy = live.filter((F.col("n") > most) & (F.pmod(F.xxhash64("bucket"), F.lit(HALVES)) == part))
    own = heavy.groupBy("image_id", "component").agg(F.collect_list(F.struct("bucket", "place")).alias("own"))
    # A row is a pair with itself as well, as corners of u may all match one corner of v.
    two = "flatten(transform(own, x -> transform(filter(own, y -> y.bucket >= x.bucket), y -> struct(xxhash64(x.bucket, y.bucket) AS key, x.place AS one, y.place AS two))))"
    pairs = own.select("image_id", "component", F.explode(F.expr(two)).alias("p")).select("image_id", "component", "p.*").repartition("key")
    # All columns are used here, so the shuffle is shared with the join below.
    several = (
        pairs.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max(F.expr("one div 1024 <> two div 1024")).alias("apart"), F.count("image_id").alias("n"))
        .filter("a <> b AND apart").select("key", "n")
    )
    kept = materialize(pairs.join(several.hint("merge"), "key"), "pairs")
    release(live.sparkSession, live)
    words = [f"w{k}" for k in range(WORDS)]
    corners = heavy.select("image_id", "place", *words).distinct()
    rows = kept
    for place in ("one", "two"):
        rows = rows.join(corners.select("image_id", F.col("place").alias(place), *[F.col(w).alias(f"{place}_{w}") for w in words]), ["image_id", place])
    rows = materialize(rows, "pairs")
    discard(kept)
    near = [" + ".join(f"bit_count(a.{place}_{w} ^ b.{place}_{w})" for w in words) + f" <= {DISTANCE}" for place in ("one", "two")]
    halves = (zip(_bins("a.one", "b.one", F.lit(half)), _bins("a.two", "b.two", F.lit(half)), strict=True) for half in (0.0, 0.5))
    agree = reduce(Column.__or__, (reduce(Column.__and__, (one == two for one, two in bins)) for bins in halves))
    met = _each_with_each(rows, "key", F.expr(" AND ".join([*near, "a.one div 1024 <> a.two div 1024"])) & agree)
    found = materialize(met.select(F.col("a.image_id").alias("u"), F.col("b.image_id").alias("v")).distinct(), "candidates")
    discard(rows)
    release(live.sparkSession, live)
    return found


def _rest(live: DataFrame) -> DataFrame:
    """Links of all images that share a bucket and lie in different components, without the matches of all of them.

    Of the MIN_VOTES corners of a link two match in light buckets, or all but one in larger ones: then two of those in buckets of one of
    the HALVES. Images of which neither holds are not linked; all matches of the others are then voted on.
    """
    most = _light_rows(live)
    parts = [_by_light_buckets(live, most), *(_by_pairs_of_corners(live, part, most) for part in range(HALVES))]
    candidates = materialize(reduce(DataFrame.unionByName, parts).distinct(), "candidates")

    def matches(rows: DataFrame) -> DataFrame:
        one = rows.join(candidates, F.col("image_id") == F.col("u")).drop("u")
        return _matched(one.alias("a").join(rows.alias("b"), F.expr("a.v = b.image_id AND a.bucket = b.bucket")))

    links = _by_tables(live, matches)
    discard(candidates, *parts)
    return links


def _placed(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """shared with the component of each image, itself as long as it has no links."""
    if parts is None:
        return shared.withColumn("component", F.col("image_id"))
    return shared.join(parts, F.col("image_id") == F.col("key"), "left").withColumn("component", F.coalesce("component", "image_id")).drop("key")


def _with_hubs(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Matches of the rows of a bucket with its hub, one row: in the first round the smallest image's, later that of the smallest outside of the smallest component."""
    placed = _placed(shared, parts)
    row, bucket = F.struct("image_id", "place", *[f"w{k}" for k in range(WORDS)], "component"), W.partitionBy("bucket")
    if parts is not None:
        placed = placed.withColumn("least", F.min("component").over(bucket))
        row = F.when(F.col("component") != F.col("least"), row)
    near = placed.withColumn("hub", F.min(row).over(bucket)).alias("a").filter(F.expr("a.component <> hub.component") & _near("a", "hub"))
    return near.select(F.col("image_id").alias("u"), F.col("hub.image_id").alias("v"), F.col("place").alias("place_u"), F.col("hub.place").alias("place_v"))


def classes(described: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """image_id, class_id (the smallest image_id linked to it) and n_points of every image.

    Images of equal pixels are one image from the start; images without corners are linked with equal ones only; rows of null id follow
    the class of their pixels, or have none.
    """
    same = described.groupBy("digest").agg(F.min("image_id").alias("one")).filter("digest IS NOT NULL AND one IS NOT NULL")
    ids = materialize(described.join(same.withColumnRenamed("digest", "d"), F.expr("digest = d AND image_id = one"), "left_semi").select("image_id").distinct(), "images")
    lone = described.join(ids, "image_id", "left_semi").select("image_id", F.posexplode("places").alias("corner", "place"), "bits")
    lone = lone.select("image_id", "corner", "place", *[F.get("bits", F.col("corner") * WORDS + k).alias(f"w{k}") for k in range(WORDS)]).dropDuplicates(["image_id", "corner"])
    narrow = lone.select("image_id", "corner", F.explode(_buckets()).alias("bucket")).repartition("bucket")
    bucket = W.partitionBy("bucket")  # an image has few rows of a bucket, so one holds a small part of all rows
    among = narrow.withColumns({"a": F.min("image_id").over(bucket), "b": F.max("image_id").over(bucket)})
    keys = materialize(among.filter("a <> b").drop("a", "b"), "keys")
    release(described.sparkSession, keys)
    # The bits come only to corners whose keys are shared.
    shared = materialize(keys.join(lone, ["image_id", "corner"]).drop("corner"), "corners")
    discard(keys)
    release(described.sparkSession, shared)
    links = parts = None
    for _ in range(rounds):
        new = _by_tables(shared, lambda rows, parts=parts: _with_hubs(rows, parts))
        links = new if links is None else links.unionByName(new)
        parts = connected(links)
        release(described.sparkSession, shared)
    live = _live(shared, parts)
    discard(shared)
    release(described.sparkSession, live)
    new = _rest(live)
    discard(live)
    parts = connected(new if links is None else links.unionByName(new))
    rows = described.select("image_id", "digest", F.size("places").cast("long").alias("n_points")).join(same, "digest", "left")
    return rows.join(parts, F.col("one") == F.col("key"), "left").select("image_id", F.coalesce("component", "one", "image_id").alias("class_id"), "n_points")


def embedding_images(embeddings: DataFrame) -> DataFrame:
    """The class of every row of embeddings(vec_id, embedding), each shown as an 8 x 8 grid of brightness."""
    described = materialize(points(embeddings, "vec_id", "embedding"), "points")
    return classes(described).withColumnRenamed("image_id", "vec_id")
