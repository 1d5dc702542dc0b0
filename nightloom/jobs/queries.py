"""Every registered query of the sky part on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import wcs
from nightloom.functions.resample import affine
from nightloom.operators import frames, geometry, resample, sky, stack, stars
from nightloom.sources import catalog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_PIXELS = "SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)"
_SAMPLES = f"SELECT image_id, y + image_id % 9 AS y, x + (image_id // 9) % 9 AS x, v FROM ({_PIXELS})"
_STARS = "SELECT c_custkey AS star_id, (c_custkey * 7919 % 36000) / 100 AS ra, (c_custkey * 104729 % 17999) / 100 - 90 AS dec, c_acctbal::DOUBLE / 1000 AS vmag FROM customer"
_FRAMES = "SELECT p_partkey AS image_id, p_brand AS camera, (p_partkey * 611953 % 36000) / 100 AS ra0, (p_partkey * 15485863 % 16000) / 100 - 80 AS dec0, p_size / 10.0::DOUBLE AS half FROM part"
_OBLIQUE = wcs.CarGrid((180.5, 25.5), (90.0, 30.0), (1.0, 1.0), (50, 360))
_SKY = wcs.default_grid(1.0)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    """Doubles rounded, with infinite and missing ones as null."""
    return df.withColumns({n: F.when(stack.finite(F.col(n)), stack.rounded(F.col(n), digits)) for n in names})


@query(f"SELECT y::INT AS y, x::INT AS x, round(quantile_cont(v, 0.05), 8) AS value, count(*) AS frame_count FROM ({_SAMPLES}) GROUP BY y, x")
def map_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.percentile_map(tables.samples(spark, sf_dir), [5]).drop("output_idx"), "value")


@query(
    f"""SELECT y::INT AS y, x::INT AS x, k::INT AS output_idx, round(q[k + 1], 8) AS value, n AS frame_count
    FROM (SELECT y, x, quantile_cont(v, [0.1, 0.5, 0.9]) AS q, count(*) AS n FROM ({_SAMPLES}) GROUP BY y, x), range(3) AS r(k)"""
)
def map_multi_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.percentile_map(tables.samples(spark, sf_dir), [10, 50, 90]), "value")


@query(
    f"""WITH s AS ({_SAMPLES}), m AS (SELECT y, x, quantile_cont(v, 0.05) AS q FROM s GROUP BY y, x)
    SELECT y::INT AS y, x::INT AS x, round(q, 8) AS value, image_id AS attribution FROM s JOIN m USING (y, x)
    QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY abs(v - q), image_id) = 1"""
)
def map_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.samples(spark, sf_dir)
    return _round(stack.attribution(samples, stack.percentile_map(samples, [5])), "value")


def _clip_sql(samples: str, key: str, n_sigma: float, min_size: int) -> str:
    """The sigma clip at its fixed point, by recursion over what is kept."""
    return f"""WITH RECURSIVE s AS ({samples}),
    c AS (SELECT 0 AS it, {key}, v, false AS done FROM s
      UNION ALL
      SELECT it + 1, {key}, v, all_kept FROM (
        SELECT *, bool_and(keep) OVER (PARTITION BY {key}) AS all_kept FROM (
          SELECT it, {key}, v, abs(v - avg(v) OVER w) < {n_sigma} * stddev_pop(v) OVER w AS keep FROM c WHERE NOT done WINDOW w AS (PARTITION BY {key})))
      WHERE keep),
    f AS (SELECT {key}, avg(v) AS m, count(*) AS n FROM c WHERE done GROUP BY {key})"""


@query(
    _clip_sql(_SAMPLES, "y, x", 2.0, 10)
    + " SELECT p.y::INT AS y, p.x::INT AS x, round(CASE WHEN f.n >= 10 THEN m END, 8) AS value, p.n FROM (SELECT y, x, count(*) AS n FROM s GROUP BY y, x) p LEFT JOIN f USING (y, x)"
)
def map_clip_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.kernel_map(tables.samples(spark, sf_dir), "clipped_mean", n_sigma=2.0, min_size=10), "value")


@query(_clip_sql("SELECT event_type, value AS v FROM events", "event_type", 3.0, 10) + " SELECT event_type, round(CASE WHEN n >= 10 THEN m END, 6) AS value, n AS kept FROM f")
def clip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("v"))
    return _round(stack.clip_by_rounds(rows, "event_type", 3.0, 10), "value", digits=6)


@query(
    _clip_sql("SELECT l_suppkey AS k, l_extendedprice::DOUBLE AS v FROM lineitem", "k", 2.0, 10)
    + " SELECT p.k AS l_suppkey, round(CASE WHEN f.n >= 10 THEN m END, 4) AS value, p.n FROM (SELECT k, count(*) AS n FROM s GROUP BY k) p LEFT JOIN f USING (k)"
)
def clip_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("v"))
    found = stack.clip_by_rounds(rows, "l_suppkey", 2.0, 10).join(rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey")
    return _round(found.select("l_suppkey", "value", "n"), "value", digits=4)


@query(
    """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
    SELECT event_type, least(floor((value - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY ALL"""
)
def stack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.histogram(tables.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("v")), "event_type", 20)


@query()
def map_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.kernel_map(tables.samples(spark, sf_dir), "gaussian"), "value", digits=5)


@query()
def map_gaussian_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.kernel_map(tables.samples(spark, sf_dir), "gaussian_amplitude"), "value", digits=5)


@query()
def map_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stack.kernel_map(tables.samples(spark, sf_dir), "skew_gaussian"), "value", digits=4)


@query(
    f"""WITH m AS (SELECT y, x, avg(v) AS mean, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.5) AS median FROM ({_SAMPLES}) GROUP BY y, x)
    SELECT y::INT AS y, x::INT AS x, reducer_id, round(value, 8) AS value FROM (UNPIVOT m ON mean, low, median INTO NAME reducer_id VALUE value)"""
)
def multi_reducer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _round(stack.reducers_map(tables.samples(spark, sf_dir), {"mean": F.avg(v), "low": F.percentile(v, F.lit(0.05)), "median": F.median(v)}), "value")


@query(f"SELECT y::INT AS y, x::INT AS x, count(*) FILTER (v > 0) AS frame_count FROM ({_SAMPLES}) GROUP BY y, x")
def frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = tables.samples(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    return lit.groupBy("y", "x").agg(F.count_if(stack.finite(F.col("v"))).alias("frame_count"))


_POINTS = f"""SELECT image_id, camera, ((ra0 + dx) % 360 + 360) % 360 AS ra, dec0 + dy AS dec FROM (
  SELECT f.*, unnest([{{'dx': t, 'dy': -half}}, {{'dx': half, 'dy': t}}, {{'dx': t, 'dy': half}}, {{'dx': -half, 'dy': t}}], recursive := true)
  FROM (SELECT *, (2 * k / 99.0::DOUBLE - 1) * half AS t FROM ({_FRAMES}), range(100) AS r(k)) f)"""
_BOUNDS = f"""WITH p AS (SELECT image_id, camera, round(((ra - 180 + 180) % 360 + 360) % 360 - 180 + 179.5, 9) AS x, round(dec + 89.5, 9) AS y FROM ({_POINTS})),
  e AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM p WINDOW w AS (PARTITION BY image_id)),
  g AS (SELECT *, count(*) FILTER (least(floor((x - lo) / (hi - lo) * 11), 10) = 5) OVER (PARTITION BY image_id) = 0 AS gap FROM e),
  b AS (SELECT image_id, camera, CASE WHEN gap AND x >= lo + (hi - lo) * 5 / 11 THEN 1 ELSE 0 END AS part,
    floor(min(x))::BIGINT AS xmin, ceil(max(x))::BIGINT AS xmax, floor(min(y))::BIGINT AS ymin, ceil(max(y))::BIGINT AS ymax FROM g GROUP BY ALL)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.frame_boxes(tables.footprints(spark, sf_dir), 100, _SKY)


@query(_BOUNDS + " SELECT image_id, camera, part, xmin, xmax, ymin, ymax FROM b")
def footprint_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@query(_BOUNDS + " SELECT camera, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM b GROUP BY camera")
def collective_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.collective_bounds(_boxes(spark, sf_dir), "camera")


@query(_BOUNDS + " SELECT image_id, count(*) AS n_boxes, max(xmax) - min(xmin) AS spread FROM b GROUP BY image_id HAVING count(*) > 1")
def wrap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_boxes"), (F.max("xmax") - F.min("xmin")).alias("spread")).filter("n_boxes > 1")


@query(
    _BOUNDS
    + """, c AS (SELECT image_id, greatest(xmin, 0) AS x0, least(xmax, 360) AS x1, greatest(ymin, 0) AS y0, least(ymax, 180) AS y1 FROM b)
    SELECT image_id, tx AS tile_x, ty AS tile_y, sum((least(x1, (tx + 1) * 30) - greatest(x0, tx * 30)) * (least(y1, (ty + 1) * 30) - greatest(y0, ty * 30)))::BIGINT AS n_pixels
    FROM c, range(12) AS a(tx), range(6) AS d(ty) WHERE x0 < x1 AND y0 < y1 AND x0 < (tx + 1) * 30 AND x1 > tx * 30 AND y0 < (ty + 1) * 30 AND y1 > ty * 30 GROUP BY ALL"""
)
def image_tile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.tiles_of(_boxes(spark, sf_dir), 30, _SKY)


@query(f"SELECT star_id, round(((ra - 180 + 180) % 360 + 360) % 360 - 180 + 179.5, 8) AS x, round(dec + 89.5, 8) AS y FROM ({_STARS})")
def wcs_car_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = wcs.world_to_pixel(F.col("ra"), F.col("dec"), _SKY)
    return _round(tables.stars(spark, sf_dir).select("star_id", x.alias("x"), y.alias("y")), "x", "y")


@query(f"SELECT image_id, round((x * 45 + 180.5) % 360, 8) AS ra, round(y * 22.5 - 89.5 + 90 - 90, 8) AS dec FROM ({_PIXELS})")
def wcs_car_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = wcs.pixel_to_world(F.col("x") * 45.0 + 180 - 0, F.col("y") * 22.5, wcs.CarGrid((180.5, 90.5), (180.0, 0.0), (1.0, 1.0), (180, 360)))
    return _round(tables.pixels(spark, sf_dir).select("image_id", ra.alias("ra"), dec.alias("dec")), "ra", "dec")


@query(
    f"""WITH n AS (SELECT star_id, radians(dec) AS t, radians(ra + 90) AS d, radians(60) AS p FROM ({_STARS}))
    SELECT star_id, round(degrees(atan2(-cos(t) * sin(d), sin(t) * cos(p) - cos(t) * sin(p) * cos(d))) + 179.5, 6) AS x,
      round(degrees(asin(greatest(-1, least(1, sin(t) * sin(p) + cos(t) * cos(p) * cos(d))))) + 24.5, 6) AS y FROM n"""
)
def wcs_oblique(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = wcs.world_to_pixel(F.col("ra"), F.col("dec"), _OBLIQUE)
    return _round(tables.stars(spark, sf_dir).select("star_id", x.alias("x"), y.alias("y")), "x", "y", digits=6)


@query(f"SELECT floor((ra % 360) / 3)::INT AS ra_bin, least(floor((dec + 90) / 3), 59)::INT AS dec_bin, count(*) AS n_stars, round(min(vmag), 8) AS brightest FROM ({_STARS}) GROUP BY ALL")
def star_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra_bin, dec_bin = stars.bin_keys(F.col("ra"), F.col("dec"))
    return _round(tables.stars(spark, sf_dir).groupBy(ra_bin.alias("ra_bin"), dec_bin.alias("dec_bin")).agg(F.count(F.lit(1)).alias("n_stars"), F.min("vmag").alias("brightest")), "brightest")


@query(
    f"""SELECT image_id, star_id, round(dx, 8) AS dx, round(dec - dec0, 8) AS dy, round(vmag, 8) AS vmag
    FROM (SELECT *, ((ra - ra0 + 180) % 360 + 360) % 360 - 180 AS dx FROM ({_STARS}), ({_FRAMES}) WHERE vmag > 2 AND vmag < 8)
    WHERE round(abs(dx), 9) < half AND round(abs(dec - dec0), 9) < half"""
)
def stars_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stars.in_frames(tables.stars(spark, sf_dir), tables.footprints(spark, sf_dir), 2.0, 8.0), "dx", "dy", "vmag")


@query(
    """SELECT c_custkey::VARCHAR AS star_id, round((c_custkey % 24 + c_custkey % 60 / 60.0::DOUBLE + c_custkey % 59 / 3600.0::DOUBLE) * 15, 8) AS ra,
      round(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 90 + c_custkey % 58 / 60.0::DOUBLE + c_custkey % 57 / 3600.0::DOUBLE), 8) AS dec, round(c_acctbal::DOUBLE, 8) AS vmag
    FROM customer WHERE c_custkey % 7 <> 0"""
)
def catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        """concat(c_custkey, '; ', c_custkey % 24, ' ', c_custkey % 60, ' ', c_custkey % 59, '; ', if(c_custkey % 2 = 0, '+', '-'), c_custkey % 90, ' ', c_custkey % 58, ' ', c_custkey % 57,
        '; ', if(c_custkey % 7 = 0, '~', cast(c_acctbal AS string)))"""
    )
    return _round(catalog.parse(tables.table(spark, sf_dir, "customer").select(line.alias("value"))), "ra", "dec", "vmag")


@query(
    f"""WITH o AS (SELECT dy, dx, dx * dx + dy * dy <= 1 AS disc FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx) WHERE dx * dx + dy * dy <= 4)
    SELECT image_id, image_id AS star_id, round(sum(v) FILTER (disc) - median(v) FILTER (NOT disc) * count(*) FILTER (disc), 8) AS flux, round(median(v) FILTER (NOT disc), 8) AS background
    FROM ({_PIXELS}) p JOIN o ON p.y = 4 + dy AND p.x = 4 + dx GROUP BY image_id"""
)
def aperture_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tables.pixels(spark, sf_dir)
    at = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("star_id"), F.lit(4.2).alias("x"), F.lit(3.9).alias("y"))
    return _round(stars.aperture_flux(pixels, at, (8, 8), 1, 0, 1), "flux", "background")


def _taps(kernel: list[tuple[int, int, float]]) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in kernel) + ") AS k(dy, dx, w)"


_BLURRED = f"SELECT image_id, p.y + k.dy AS y, p.x + k.dx AS x, sum(v * w) AS v FROM ({_PIXELS}) p, {_taps(frames.blur_kernel())} WHERE p.y + k.dy BETWEEN 0 AND 7 AND p.x + k.dx BETWEEN 0 AND 7 GROUP BY ALL"


@query(f"SELECT image_id, y::INT AS y, x::INT AS x, round(v, 8) AS v FROM ({_BLURRED})")
def blur_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(resample.convolve_images(_images(spark, sf_dir), frames.blur_kernel(), (8, 8)), "v")


@query(
    f"""WITH m AS (SELECT y AS my, x AS mx, quantile_cont(v, 0.05) AS e FROM ({_SAMPLES}) GROUP BY y, x)
    SELECT image_id, y::INT AS y, x::INT AS x, round(v, 8) AS blurred, round(e, 8) AS estimate, round(v - e, 8) AS remnant
    FROM ({_BLURRED}) b LEFT JOIN m ON my = y + image_id % 9 AND mx = x + (image_id // 9) % 9"""
)
def subtract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = stack.percentile_map(tables.samples(spark, sf_dir), [5])
    blurred = resample.convolve_images(_images(spark, sf_dir), frames.blur_kernel(), (8, 8))
    placed = blurred.select("*", (F.col("y") + F.col("image_id") % 9).cast("int").alias("map_y"), (F.col("x") + F.expr("image_id div 9") % 9).cast("int").alias("map_x"))
    return _round(frames.subtract(placed, sky), "blurred", "estimate", "remnant")


@query(
    f"""SELECT image_id, y::INT AS y, x::INT AS x, round(v, 8) AS v FROM (
    SELECT image_id, p.y - k.dy AS y, p.x - k.dx AS x, sum(v * w) AS v, count(*) AS n FROM ({_PIXELS}) p, {_taps(frames.shift_weights(0.25, -0.5))} GROUP BY ALL) WHERE n = 25"""
)
def resample_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(resample.shift_images(_images(spark, sf_dir), frames.shift_weights(0.25, -0.5), (8, 8)), "v")


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice::DOUBLE, 0.98) AS t FROM orders),
    c AS (SELECT 0 AS image_id, o_custkey % 20 AS block_y, o_orderkey % 17 AS block_x, bool_or(o_totalprice::DOUBLE > t) AS hit FROM orders, q GROUP BY ALL),
    r AS (SELECT *, block_x - row_number() OVER (PARTITION BY image_id, block_y ORDER BY block_x) AS run FROM c WHERE hit)
    SELECT image_id::INT AS image_id, block_y, min(block_x) AS x0, max(block_x) AS x1 FROM r GROUP BY image_id, block_y, run"""
)
def block_mask_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of blocks that hold a price over the 98th percentile of all."""
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    limit = stack.quantiles(orders, [0.98]).select(F.col("value").alias("t"))
    cells = orders.crossJoin(F.broadcast(limit)).select(F.lit(0).alias("image_id"), (F.col("o_custkey") % 20).alias("block_y"), (F.col("o_orderkey") % 17).alias("block_x"), "v", "t")  # one row
    return frames.block_strips(cells, F.col("v") > F.col("t"))


@query(
    f"""SELECT image_id, y::INT AS y, x::INT AS x, round(CASE WHEN (y, x) NOT IN ((0, 0), (3, 4), (7, 7)) AND v >= -0.1 THEN v END, 8) AS v FROM ({_PIXELS})"""
)
def mask_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.createDataFrame([(0, 0), (3, 4), (7, 7)], "y int, x int")
    return _round(frames.masked(tables.pixels(spark, sf_dir), bad, -0.1), "v")


@query(
    f"""WITH s AS ({_SAMPLES}), m AS (SELECT y, x, quantile_cont(v, 0.05) AS q FROM s GROUP BY y, x),
    a AS (SELECT y, x, image_id FROM s JOIN m USING (y, x) QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY abs(v - q), image_id) = 1)
    SELECT y::INT AS y, x::INT AS x, label AS encounter FROM a LEFT JOIN embeddings ON vec_id = image_id"""
)
def attribution_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.samples(spark, sf_dir)
    found = stack.attribution(samples, stack.percentile_map(samples, [5]))
    label = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("attribution"), F.col("label").alias("encounter"))
    return found.join(label, "attribution", "left").select("y", "x", "encounter")


@query(
    f"""SELECT image_id, min(y) FILTER (share <= 0.5)::INT AS first_y FROM (
    SELECT image_id, y, avg((v < 0)::INT::DOUBLE) AS share FROM ({_PIXELS}) GROUP BY image_id, y) GROUP BY image_id"""
)
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_good(tables.pixels(spark, sf_dir), F.col("v") < 0, 0.5).withColumnRenamed("first", "first_y")


@query(
    f"""WITH r AS (SELECT image_id, y, avg((v < 0)::INT::DOUBLE) AS share FROM ({_PIXELS}) GROUP BY image_id, y), c AS (SELECT image_id, x, avg((v < 0)::INT::DOUBLE) AS share FROM ({_PIXELS}) GROUP BY image_id, x),
    a AS (SELECT image_id, max(y) FILTER (share <= 0.5 AND y <= 6)::INT AS top FROM r GROUP BY image_id),
    b AS (SELECT image_id, min(x) FILTER (share <= 0.5 AND x >= 2)::INT AS left_x, max(x) FILTER (share <= 0.5)::INT AS right_x FROM c GROUP BY image_id)
    SELECT image_id, top, left_x, right_x FROM a JOIN b USING (image_id)"""
)
def edge_trim_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other three edges, two of them from a start within the image."""
    pixels, bad = tables.pixels(spark, sf_dir), F.col("v") < 0
    sides = [("top", "y", 6, -1), ("left_x", "x", 2, 1), ("right_x", "x", 7, -1)]
    top, left, right = (frames.first_good(pixels, bad, 0.5, axis, start, inward).withColumnRenamed("first", name) for name, axis, start, inward in sides)
    return top.join(left, "image_id").join(right, "image_id")


@query(
    """SELECT floor(l_discount::DOUBLE * 100)::INT AS mag_bin, floor(log10(l_extendedprice::DOUBLE * (l_quantity::DOUBLE / 50) ** 2.3) * 4)::INT AS flux_bin, count(*) AS n,
      round(avg(l_tax::DOUBLE / l_extendedprice::DOUBLE), 10) AS ratio
    FROM lineitem WHERE l_extendedprice > 0 AND l_tax > 0 GROUP BY ALL"""
)
def flux_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    flux, rest = F.col("l_extendedprice").cast("double"), F.col("l_tax").cast("double")
    rows = tables.table(spark, sf_dir, "lineitem").filter((F.col("l_extendedprice") > 0) & (F.col("l_tax") > 0))
    scaled = flux * F.pow(F.col("l_quantity").cast("double") / 50, F.lit(2.3))
    made = rows.groupBy(F.floor(F.col("l_discount").cast("double") * 100).cast("int").alias("mag_bin"), F.floor(F.log10(scaled) * 4).cast("int").alias("flux_bin"))
    return _round(made.agg(F.count(F.lit(1)).alias("n"), F.avg(rest / flux).alias("ratio")), "ratio", digits=10)


@query(f"SELECT image_id, round(quantile_cont(v, 0.001), 8) AS low, round(quantile_cont(v, 0.9999), 8) AS high, round(median(v), 8) AS middle FROM ({_PIXELS}) GROUP BY image_id")
def display_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.pixels(spark, sf_dir).groupBy("image_id").agg(F.percentile("v", F.array(F.lit(0.001), F.lit(0.9999), F.lit(0.5))).alias("p"))
    return _round(found.select("image_id", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.col("p")[2].alias("middle")), "low", "high", "middle")


@query(f"SELECT image_id, y::INT AS y, x::INT AS x, round(v, 8) AS v FROM ({_SAMPLES}) WHERE x < 4")
def stack_all_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tables.samples(spark, sf_dir).filter("x < 4"), "v")


@query(ORACLE_SQL["map_percentile"])
def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile map written as a table and read again."""
    path = f"{tables.shared_folder(spark)}/map-{uuid.uuid4().hex}"
    sky.save(map_percentile(spark, sf_dir), path, {"grid": "16 x 16"})
    return spark.read.parquet(path).filter("meta['grid'] = '16 x 16'").drop("meta")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def image_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("data"))


@query()
def resample_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images turned and scaled onto a common 12 x 12 map, each by its own mapping."""
    mapping = lambda k: affine(15.0 * (k % 7), 0.8 + 0.1 * (k % 5), (3.5, 3.5), (5.5, 5.5))
    return _round(resample.to_map(_images(spark, sf_dir), (8, 8), (12, 12), mapping, strict=False), "v", digits=6)


_CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS k(dy, dx)"


@query(
    f"""WITH d AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ({_PIXELS}), {_CROSS} WHERE v < -0.1),
    c AS (SELECT image_id, ty, tx, count(*) AS n FROM (SELECT image_id, y + dy AS ty, x + dx AS tx FROM d, {_CROSS}) GROUP BY ALL)
    SELECT vec_id AS image_id, count(n) AS n_masked FROM embeddings LEFT JOIN c ON image_id = vec_id AND n = 5 AND ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY vec_id"""
)
def closed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.closed_masks(_images(spark, sf_dir), (8, 8), -0.1, 1)
    return made.groupBy("image_id").agg(F.sum("v").cast("long").alias("n_masked"))


@query(
    f"SELECT image_id, count(*) FILTER (v < -0.1) AS n_below FROM ({_PIXELS}) GROUP BY image_id"
)
def threshold_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(spark, sf_dir).groupBy("image_id").agg(F.count_if(F.col("v") < -0.1).alias("n_below"))


_GRID = wcs.default_grid(1.0)
_TAPS = _taps(frames.shift_weights(0.0, 0.0))
_ON_SKY = """(80 + (image_id // 9) % 9 + y) AS my, (352 + image_id % 9 + x) % 360 AS mx"""
_SKY_SAMPLES = f"""SELECT image_id, {_ON_SKY}, v FROM (
    SELECT image_id, p.y - k.dy AS y, p.x - k.dx AS x, sum(v * w) AS v FROM ({_PIXELS}) p, {_TAPS} GROUP BY ALL HAVING count(*) = 25)"""


@query(
    f"""WITH s AS ({_SKY_SAMPLES}), m AS (SELECT my, mx, quantile_cont(v, [0.05, 0.5]) AS q, min(v) AS lo, max(v) AS hi, avg(v) AS a, count(*) AS n FROM s GROUP BY my, mx)
    SELECT reducer_id, output_idx::INT AS output_idx, my::INT AS y, mx::INT AS x, round(value, 8) AS value, n AS frame_count FROM (
      SELECT 'low' AS reducer_id, k AS output_idx, my, mx, q[k + 1] AS value, n FROM m, range(2) AS r(k)
      UNION ALL SELECT 'range', k, my, mx, CASE k WHEN 0 THEN lo ELSE hi END, n FROM m, range(2) AS r(k)
      UNION ALL SELECT 'mean', 0, my, mx, a, n FROM m)"""
)
def build_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to map end to end by their sky coordinates, across RA 0: two aggregates, and a user's kernel of two outputs."""
    v = F.col("v")
    reducers = {"low": F.percentile(v, F.array(F.lit(0.05), F.lit(0.5))), "mean": F.avg(v), "range": lambda samples: (samples.min(), samples.max())}
    return _round(sky.build_map(tables.sky_images(spark, sf_dir), reducers, _GRID, frame_count=True), "value")


_SUBTRACTED = f"""WITH m AS (SELECT my, mx, quantile_cont(v, 0.05) AS value FROM ({_SKY_SAMPLES}) GROUP BY my, mx),
    own AS (SELECT image_id, y, x, v AS source, {_ON_SKY} FROM ({_PIXELS})),
    taken AS (SELECT image_id, y, x, w, my + dy AS my, (mx + dx + 360) % 360 AS mx FROM own, {_TAPS}),
    e AS (SELECT image_id, y, x, sum(w * value) AS estimate FROM taken JOIN m USING (my, mx) GROUP BY ALL HAVING count(*) = 25)
    SELECT image_id, own.y::INT AS y, own.x::INT AS x, source, b.v AS blurred, estimate, b.v - estimate AS remnant
    FROM own JOIN ({_BLURRED}) b USING (image_id, y, x) LEFT JOIN e USING (image_id, y, x)"""


@query(f"SELECT image_id, y, x, round(source, 8) AS source, round(blurred, 8) AS blurred, round(estimate, 8) AS estimate, round(remnant, 8) AS remnant FROM ({_SUBTRACTED})")
def subtract_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all images, resampled back into the frame of each and taken off."""
    images = tables.sky_images(spark, sf_dir)
    made = sky.build_map(images, {"low": F.percentile("v", F.lit(0.05))}, _GRID)
    return _round(sky.subtract_map(images, made, _GRID), "source", "blurred", "estimate", "remnant")


@query(
    f"""SELECT image_id, round(low, 8) AS low, round(high, 8) AS high, round(middle - reach, 8) AS even_low, round(middle + reach, 8) AS even_high FROM (
      SELECT *, greatest(abs(high - middle), abs(low - middle)) AS reach FROM (
        SELECT image_id, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high, median(v) AS middle FROM ({_BLURRED}) GROUP BY image_id))"""
)
def comparison_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of each blurred image, and those that lie evenly about its median."""
    found = frames.comparison_limits(resample.convolve_images(_images(spark, sf_dir), frames.blur_kernel(), (8, 8)))
    return _round(found, "low", "high", "even_low", "even_high")


@query(
    f"""SELECT image_id, y::INT AS y, x::INT AS x, round(CASE WHEN abs(y - image_id % 8) > 2 OR abs(x - image_id % 5) > 2 THEN v END, 8) AS v FROM ({_PIXELS})"""
)
def box_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within two of a bright body at a place for each image are taken out."""
    at = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 8).alias("cy"), (F.col("vec_id") % 5).alias("cx"))
    return _round(frames.box_masked(tables.pixels(spark, sf_dir), at, 2), "v")


@query(f"SELECT star_id, round(3e-9::DOUBLE * pow(10, vmag / -2.5::DOUBLE) * 1e9::DOUBLE, 8) AS nano_flux FROM ({_STARS})")
def magnitude_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tables.stars(spark, sf_dir).select("star_id", (stars.flux_of(F.col("vmag")) * 1e9).alias("nano_flux")), "nano_flux")


@query("SELECT vec_id AS image_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) WHERE k % 15 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 15th image in the order of their ids."""
    return frames.every_nth(_images(spark, sf_dir).select("image_id"), "image_id", 15)


@query(f"SELECT unnest([0.001, 0.5, 0.9999])::DOUBLE AS share, round(unnest(q), 8) AS value FROM (SELECT quantile_cont(v, [0.001, 0.5, 0.9999]) AS q FROM ({_PIXELS}))")
def whole_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display limits of all pixels together: exact quantiles of one group that is never gathered."""
    return _round(stack.quantiles(tables.pixels(spark, sf_dir), [0.001, 0.5, 0.9999]), "value")


@query(
    f"""WITH s AS ({_SKY_SAMPLES}), m AS (SELECT my, mx, quantile_cont(v, 0.05) AS low, min(v) AS least, count(*) AS n FROM s GROUP BY my, mx),
    a AS (SELECT my, mx, n, reducer_id, value FROM (SELECT my, mx, n, unnest(['low', 'least']) AS reducer_id, unnest([low, least]) AS value FROM m))
    SELECT reducer_id, 0 AS output_idx, my::INT AS y, mx::INT AS x, round(value, 8) AS value, n AS frame_count, arg_min(image_id, {{'d': round(abs(v - value), 12), 'i': image_id}}) AS attribution
    FROM s JOIN a USING (my, mx) GROUP BY reducer_id, my, mx, value, n"""
)
def map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map end to end with the image that each value is nearest to, of an aggregate and of a user's kernel."""
    reducers = {"low": F.percentile("v", F.lit(0.05)), "least": lambda samples: samples.min()}
    return _round(sky.build_map(tables.sky_images(spark, sf_dir), reducers, _GRID, frame_count=True, attribution=True), "value")


@query(
    f"""WITH g AS (SELECT min(80 + (image_id // 9) % 9) - 1 AS y0 FROM ({_PIXELS}))
    SELECT (y - y0)::INT AS y, CASE WHEN x >= 351 THEN x - 351 ELSE x + 9 END::INT AS x, value, frame_count FROM (
      SELECT my::INT AS y, mx::INT AS x, round(quantile_cont(v, 0.05), 8) AS value, count(*) AS frame_count FROM ({_SKY_SAMPLES}) GROUP BY my, mx), g"""
)
def default_grid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map on the grid that all the images' boxes cover, from the rows and columns that they touch; it runs over RA 0."""
    images = tables.sky_images(spark, sf_dir)
    grid = sky.plan_grid(images, 1.0, "covered")
    made = sky.build_map(images, {"low": F.percentile("v", F.lit(0.05))}, grid, frame_count=True)
    return _round(made.select("y", "x", "value", "frame_count"), "value")


_FIELD_STARS = "SELECT o_orderkey AS star_id, ((o_orderkey * 7919 % 30000) / 1000 + 345.0003::DOUBLE) % 360 AS ra, (o_orderkey * 104729 % 30000) / 1000 - 15.0003::DOUBLE AS dec, o_totalprice::DOUBLE / 50000 AS vmag FROM orders"
_IN_IMAGES = f"""SELECT * FROM (
    SELECT vec_id AS image_id, label, star_id, ((ra - (352.5 + vec_id % 9) + 540) % 360 + 360) % 360 - 180 AS x, dec + 9.5::DOUBLE - (vec_id // 9) % 9 AS y, vmag FROM embeddings, ({_FIELD_STARS}) WHERE vmag > 1 AND vmag < 6)
    WHERE x > 0 AND x < 8 AND y > 0 AND y < 8"""


@query(f"SELECT image_id, star_id, round(x, 6) AS x, round(y, 6) AS y, round(vmag, 6) AS vmag FROM ({_IN_IMAGES}) WHERE x > 1 AND x < 6 AND y > 2 AND y < 5")
def stars_in_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogued stars in every image by its own wcs, less a trim of each side."""
    shown = lambda found: _round(found, "x", "y", "vmag", digits=6)
    return stars.in_image_frames(tables.field_stars(spark, sf_dir), tables.sky_images(spark, sf_dir), _GRID, 1.0, 6.0, (1, 2, 2, 3), 1.0, shown)


@query(
    f"""WITH s AS ({_IN_IMAGES} AND x > 3.5 AND x < 4.5 AND y > 3.5 AND y < 4.5),
    o AS (SELECT dy, dx, dx * dx + dy * dy <= 1 AS disc FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx) WHERE dx * dx + dy * dy <= 4),
    p AS (SELECT image_id, {", ".join(f"coalesce(sum({c}) FILTER (disc), 0) - median({c}) FILTER (NOT disc) * 5 AS {c}" for c in ("source", "blurred", "estimate", "remnant"))}
      FROM ({_SUBTRACTED}) q JOIN o ON q.y = 4 + dy AND q.x = 4 + dx GROUP BY image_id),
    t AS (SELECT label, min(vec_id) AS began FROM embeddings GROUP BY label)
    SELECT image_id, star_id, round(source, 6) AS orig_measured_flux, round(blurred, 6) AS blurred_measured_flux, round(estimate, 6) AS est_stellar_flux, round(remnant, 6) AS remnant_flux, round(vmag, 6) AS exp_magnitude,
      label AS encounter, image_id - began AS trel
    FROM s JOIN p USING (image_id) JOIN t USING (label) WHERE blurred > 0 AND estimate > 0"""
)
def photometric_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light of every star in the images, blurred, in the map's estimate and in what is left, by magnitude, encounter and time since the encounter's first image."""
    images = tables.sky_images(spark, sf_dir)
    made = sky.build_map(images, {"low": F.percentile("v", F.lit(0.05))}, _GRID)
    flux = stars.photometry(images, sky.subtract_map(images, made, _GRID), tables.field_stars(spark, sf_dir), _GRID, 1.0, 6.0, 1, 0, 1, size=1.0)
    known = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("encounter"))
    began = known.groupBy("encounter").agg(F.min("image_id").alias("began"))
    named = flux.filter("blurred_measured_flux > 0 AND est_stellar_flux > 0").join(known, "image_id").join(began, "encounter").withColumn("trel", F.col("image_id") - F.col("began")).drop("began")
    return _round(named, "orig_measured_flux", "blurred_measured_flux", "est_stellar_flux", "remnant_flux", "exp_magnitude", digits=6)


@query(
    f"""SELECT my::INT AS y, mx::INT AS x, round(quantile_cont(v, 0.05), 8) AS value, count(*) AS frame_count FROM (
      SELECT *, (mx // 4 * 4 + 2 - (352 + image_id % 9) + 540) % 360 - 180 AS u, my // 4 * 4 + 2 - (80 + (image_id // 9) % 9) AS w FROM ({_SKY_SAMPLES}))
    WHERE u BETWEEN 1 AND 7 AND w BETWEEN 1 AND 7 GROUP BY my, mx"""
)
def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from blocks at whose centre an image has light, and from no others."""
    made = sky.build_map(tables.sky_images(spark, sf_dir), {"low": F.percentile("v", F.lit(0.05))}, _GRID, frame_count=True, block=(4, 4))
    return _round(made.select("y", "x", "value", "frame_count"), "value")


@query(ORACLE_SQL["subtract_map"])
def subtract_stored_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a map written by tiles and loaded with its grid: only tiles that images touch are read."""
    images = tables.sky_images(spark, sf_dir)
    path = f"{tables.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    sky.save_map(sky.build_map(images, {"low": F.percentile("v", F.lit(0.05))}, _GRID), _GRID, path, 32)
    stored = sky.load_map(spark, path)
    return _round(sky.subtract_map(images, stored.around(images), stored.grid), "source", "blurred", "estimate", "remnant")


@query(f"SELECT image_id, my::INT AS y, mx::INT AS x, round(v, 8) AS v FROM ({_SKY_SAMPLES}) WHERE mx >= 352 AND mx < 357")
def raw_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of five columns of the map, by image."""
    return _round(sky.raw_stack(tables.sky_images(spark, sf_dir), _GRID, (352, 357)), "v")


@query(f"SELECT star_id, round(ra, 8) AS ra, round(dec, 8) AS dec, round(vmag, 8) AS vmag FROM ({_STARS}) WHERE (ra >= 351 OR ra < 12) AND dec >= -30 AND dec < 33")
def stars_about_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars of the bins that a field over RA 0 touches."""
    return _round(stars.stars_between(tables.stars(spark, sf_dir), [(353.0, 359.9), (0.0, 10.5)], -28.5, 30.2), "ra", "dec", "vmag")
