"""Footprints of pointed images on the map, and which images touch which tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.projection import Projection
from nightloom.functions.wcs import CarGrid

_BOX = "part bigint, xmin bigint, xmax bigint, ymin bigint, ymax bigint"


def edge_points(footprints: DataFrame, per_edge: int) -> DataFrame:
    """image_id, camera, points: an array of (ra, dec) evenly along the four edges of each frame (ra0, dec0, half), ends included. Nothing leaves its row."""
    t = lambda k: (2 * k / F.lit(float(per_edge - 1)) - 1) * F.col("half")
    half = F.col("half")
    sides = [lambda k: (t(k), -half), lambda k: (half, t(k)), lambda k: (t(k), half), lambda k: (-half, t(k))]
    along = F.sequence(F.lit(0), F.lit(per_edge - 1))

    def side(at) -> Column:
        return F.transform(along, lambda k: F.struct(F.pmod(F.col("ra0") + at(k)[0], F.lit(360.0)).alias("ra"), (F.col("dec0") + at(k)[1]).alias("dec")))

    return footprints.select("image_id", "camera", F.concat(*map(side, sides)).alias("points"))


def _boxes(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The frame, part, xmin, xmax, ymin, ymax of every box of the points of several frames, the k-th of which begins at first[k]; no frame is without points."""
    x, y = x.round(9), y.round(9)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    wide = np.where(high > low, high - low, 1)[of]
    bins = np.minimum(np.floor((x - low[of]) / wide * 11), 10)
    gap = (high > low) & (np.add.reduceat((bins == 5).astype(np.int64), first) == 0)
    part = (gap[of] & (x >= (low + (high - low) * 5 / 11)[of])).astype(np.int64)
    key = of * 2 + part
    order = np.argsort(key, kind="stable")
    key, x, y = key[order], x[order], y[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = [np.floor(np.minimum.reduceat(x, at)), np.ceil(np.maximum.reduceat(x, at)), np.floor(np.minimum.reduceat(y, at)), np.ceil(np.maximum.reduceat(y, at))]
    return key[at] // 2, [key[at] % 2, *(e.astype(np.int64) for e in ends)]


def _per_frame(rows: DataFrame, points, grid: CarGrid) -> DataFrame:
    """image_id, camera and _BOX; points(batch) gives RA and Dec of the frames' points, where each frame's begin, and which rows these frames are."""
    target = Projection.of_grid(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            ra, dec, first, row = points(batch)
            if not len(first):
                continue
            frame, columns = _boxes(*target.world_to_pixel(ra, dec), first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[frame])) for c in ("image_id", "camera")), *map(pa.array, columns)], names=["image_id", "camera", "part", "xmin", "xmax", "ymin", "ymax"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"image_id {kinds['image_id']}, camera {kinds['camera']}, {_BOX}")


def bounds(edges: DataFrame, grid: CarGrid) -> DataFrame:
    """image_id, camera, part, xmin, xmax, ymin, ymax: the pixel box of each frame's points; two boxes where a frame straddles the map's edge. A frame without points has none.

    Of 11 bins of x the first and the last are filled and the middle one is empty: then the points left and right of the sixth bin make up a box each.
    """

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = batch.column("points")
        many = found.value_lengths().fill_null(0).to_numpy()
        flat = found.flatten()
        row = np.flatnonzero(many)
        return *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("ra", "dec")), (np.cumsum(many) - many)[row], row

    return _per_frame(edges.select("image_id", "camera", "points"), points, grid)


def frame_boxes(footprints: DataFrame, per_edge: int, grid: CarGrid) -> DataFrame:
    """bounds() of the points along the edges of square frames (ra0, dec0, half), which are made where they are used. Frames with a null number have none."""
    t = np.linspace(-1, 1, per_edge)
    one = np.ones(per_edge)
    right, up = np.concatenate([t, one, t, -one]), np.concatenate([-one, t, one, t])

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ra, dec, half = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("ra0", "dec0", "half"))
        row = np.flatnonzero(np.isfinite(ra + dec + half))
        ra, dec, half = (c[row, None] for c in (ra, dec, half))
        return ((ra + right * half) % 360).ravel(), (dec + up * half).ravel(), np.arange(len(row)) * len(right), row

    return _per_frame(footprints.select("image_id", "camera", "ra0", "dec0", "half"), points, grid)


def collective_bounds(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.groupBy(key).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


def tiles_of(boxes: DataFrame, tile: int, grid: CarGrid) -> DataFrame:
    """image_id, tile_x, tile_y with the box clamped to the tile (upper ends exclusive): an equi join key instead of an overlap condition."""
    ny, nx = grid.shape
    inside = boxes.select(
        "image_id", F.greatest("xmin", F.lit(0)).alias("x0"), F.least("xmax", F.lit(nx)).alias("x1"), F.greatest("ymin", F.lit(0)).alias("y0"), F.least("ymax", F.lit(ny)).alias("y1")
    ).filter("x0 < x1 AND y0 < y1")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile)))
    keyed = inside.select("*", span("x0", "x1").alias("tile_x")).select("*", span("y0", "y1").alias("tile_y"))

    def clamp(low: str, high: str, t: str) -> tuple[Column, Column]:
        return F.greatest(F.col(low), F.col(t) * tile), F.least(F.col(high), (F.col(t) + 1) * tile)

    (x0, x1), (y0, y1) = clamp("x0", "x1", "tile_x"), clamp("y0", "y1", "tile_y")
    return keyed.groupBy("image_id", "tile_x", "tile_y").agg(F.sum((x1 - x0) * (y1 - y0)).alias("n_pixels"))
