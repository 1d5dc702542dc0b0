"""Image kernels over a table of images, one row for each image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightloom.functions.resample import Mapping, closed, convolved, resample


def _per_image(images: DataFrame, shape: tuple[int, int], kernel: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, y, x, v of a kernel on each image(image_id, data: rows of numbers); images of another size give nothing, NaN gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            ids, ys, xs, vs = [], [], [], []
            for image_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None or len(data) != shape[0] * shape[1]:
                    continue
                out = kernel(image_id, np.array(data, float).reshape(shape))
                y, x = np.nonzero(np.isfinite(out))
                ids.append(np.full(len(y), image_id)), ys.append(y), xs.append(x), vs.append(out[y, x])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(ys), pa.int32()), pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(vs).astype(float))],
                    names=["image_id", "y", "x", "v"],
                )

    return images.select("image_id", "data").mapInArrow(run, "image_id bigint, y int, x int, v double")


def to_map(images: DataFrame, shape: tuple[int, int], out_shape: tuple[int, int], mapping_of: Callable[[int], Mapping], **options) -> DataFrame:
    """image_id, y, x, v: each image resampled onto the common map by its own mapping of map pixels to image pixels."""
    return _per_image(images, shape, lambda image_id, a: resample(a, mapping_of(image_id), out_shape, **options))


def convolve_images(images: DataFrame, kernel: list[tuple[int, int, float]], shape: tuple[int, int]) -> DataFrame:
    """image_id, y, x, v convolved within each image; no row where a missing pixel spreads to."""
    return _per_image(images, shape, lambda _, a: convolved(a, kernel))


def shift_images(images: DataFrame, taps: list[tuple[int, int, float]], shape: tuple[int, int]) -> DataFrame:
    """image_id, y, x, v of images moved by a fraction of a pixel, taps being what a moved pixel takes from its neighbours; strict: no row where any of them is missing. Pixels beyond the edge may be filled too."""

    def kernel(_: int, a: np.ndarray) -> np.ndarray:
        away = [(-dy, -dx, w) for dy, dx, w in taps]
        return convolved(np.where(np.isfinite(a), a, 0), away) + np.where(convolved(np.isfinite(a).astype(float), [(dy, dx, 1.0) for dy, dx, _ in away]) > len(taps) - 0.5, 0, np.nan)

    return _per_image(images, shape, kernel)


def closed_masks(images: DataFrame, shape: tuple[int, int], threshold: float, rounds: int) -> DataFrame:
    """image_id, y, x, v: 1 where an image is below the threshold after binary closing, else 0."""
    return _per_image(images, shape, lambda _, a: closed(a < threshold, rounds).astype(float))
