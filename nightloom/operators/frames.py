"""Operations within image frames: convolution, resampling by a shift, subtraction, masks and blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.functions.resample import KERNEL_WIDTH, gaussian_taps
from nightloom.sources import tables


def blur_kernel(width: float = KERNEL_WIDTH * math.sqrt(2)) -> list[tuple[int, int, float]]:
    """The 5 x 5 kernel exp(-2 r^2 / width^2), of sum 1."""
    return gaussian_taps(width)


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]], shape: tuple[int, int]) -> DataFrame:
    """image_id, y, x, v of pixels in long form convolved within each frame, zero outside; a missing pixel spreads over the kernel.

    Each pixel is spread over its targets and added up there: one shuffle with partial sums. Images in one row each go through
    nightloom.operators.resample.convolve_images, which moves nothing.
    """
    taps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in kernel])).alias("k")
    spread = pixels.select("image_id", "y", "x", "v", taps).select("image_id", (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), (F.col("v") * F.col("k.w")).alias("t"), F.col("v").isNull().alias("gone"))
    inside = F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1)
    summed = spread.filter(inside).groupBy("image_id", "y", "x").agg(F.sum("t").alias("s"), F.max("gone").alias("gone"))
    return summed.select("image_id", "y", "x", F.when(~F.col("gone"), F.col("s")).alias("v"))


def shift_weights(shift_y: float, shift_x: float, width: float = KERNEL_WIDTH, reach: int = 2) -> list[tuple[int, int, float]]:
    """What a translated pixel takes from its neighbours (the Jacobian is the identity, so flux is conserved)."""
    return gaussian_taps(width, shift_y, shift_x, reach)


def subtract(blurred: DataFrame, sky: DataFrame) -> DataFrame:
    """image_id, y, x, blurred, estimate, remnant: the map's sample at each pixel (map_y, map_x) taken off."""
    return blurred.join(sky.select(F.col("y").alias("map_y"), F.col("x").alias("map_x"), F.col("value").alias("estimate")), ["map_y", "map_x"], "left").select(
        "image_id", "y", "x", F.col("v").alias("blurred"), "estimate", (F.col("v") - F.col("estimate")).alias("remnant")
    )


def block_strips(cells: DataFrame, hit: Column) -> DataFrame:
    """image_id, block_y, x0, x1: runs of adjoining blocks of a row that have any hit."""
    kept = cells.groupBy("image_id", "block_y", "block_x").agg(F.max(hit).alias("hit")).filter("hit")
    row = W.partitionBy("image_id", "block_y").orderBy("block_x")
    return kept.withColumn("run", F.col("block_x") - F.row_number().over(row)).groupBy("image_id", "block_y", "run").agg(F.min("block_x").alias("x0"), F.max("block_x").alias("x1")).drop("run")


def masked(pixels: DataFrame, bad: DataFrame, threshold: float) -> DataFrame:
    """pixels with v null where the pixel is in bad(y, x) or below the threshold."""
    return pixels.join(bad.select("y", "x", F.lit(True).alias("bad")), ["y", "x"], "left").select("image_id", "y", "x", F.when(~F.coalesce("bad", F.lit(False)) & (F.col("v") >= threshold), F.col("v")).alias("v"))


def first_good(pixels: DataFrame, bad: Column, most: float, axis: str = "y", start: int = 0, inward: int = 1) -> DataFrame:
    """image_id, first: of the rows (axis y) or columns (axis x) from start on inwards (1: upwards, -1: downwards) the first of which no more than a share is bad; null where there is none."""
    lines = pixels.filter((F.col(axis) - start) * inward >= 0).groupBy("image_id", axis).agg(F.avg(bad.cast("double")).alias("share"))
    found = F.min(F.when(F.col("share") <= most, F.col(axis) * inward))
    return lines.groupBy("image_id").agg((found * inward).alias("first"))


def comparison_limits(pixels: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """image_id, low, high, even_low, even_high: percentiles of each image, and limits that reach equally far from its median to hold both."""
    p = pixels.groupBy("image_id").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100), F.lit(0.5))).alias("p"))
    named = p.select("image_id", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.col("p")[2].alias("middle"))
    reach = F.greatest(F.abs(F.col("high") - F.col("middle")), F.abs(F.col("low") - F.col("middle")))
    return named.select("image_id", "low", "high", (F.col("middle") - reach).alias("even_low"), (F.col("middle") + reach).alias("even_high"))


def box_masked(pixels: DataFrame, bodies: DataFrame, reach: int) -> DataFrame:
    """pixels with v null within reach of a body (image_id, cy, cx) in both directions. Bodies' pixels are spread out, so they are found by an equi join."""
    span = lambda c: F.explode(F.sequence((F.col(c) - reach).cast("int"), (F.col(c) + reach).cast("int")))
    bad = bodies.select("image_id", span("cy").alias("y"), "cx").select("image_id", "y", span("cx").alias("x")).distinct().withColumn("bad", F.lit(True))
    return pixels.join(bad, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("bad").isNull(), F.col("v")).alias("v"))


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every n-th row in the order of a distinct key, the first included."""
    return tables.numbered(rows, key, "_place").filter(F.col("_place") % n == 0).select(*rows.columns)
