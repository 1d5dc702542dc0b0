"""The product: a map of the sky's fixed background from pointed images, and images less that map.

An image table has a row for each image: image_id, ny, nx, data (rows of numbers, NaN or null where there is none; several planes one
after the other) and wcs (nightloom.functions.projection.WCS_SCHEMA); a column plane, if there is one, numbers the row's first plane. Images whose wcs is null or of an
unsupported kind, or whose edge has no place in the sky, are left out. Images are resampled where they are read, each once, and the stack, map
rows of a few pixels for each image, is written; all reductions read it. A map has a row for each pixel. For subtraction rows of the map meet the images
that they touch by a key, so no task holds the map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.projection import Projection, find_bounds, with_poles
from nightloom.functions.reducers import gaussian_centre
from nightloom.functions.resample import blurred, resample
from nightloom.functions.wcs import CarGrid, default_grid
from nightloom.operators import stack
from nightloom.sources import fits, tables

Step = Callable[[DataFrame], DataFrame]
BlockTest = Callable[[np.ndarray, tuple[float, float]], bool]
#: Map pixels that a task resamples at once.
STRIP_PIXELS = 2**20

_BOXES = "image_id bigint, part int, xmin int, xmax int, ymin int, ymax int"
_IMAGES = ("image_id", "ny", "nx", "data", "wcs")


def _same(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Processor:
    """What a user does to images and samples on the way: functions of DataFrames, so that Spark plans them with the rest.

    load: from a session and a folder to an image table, where images are given as a folder. preprocess: of the image table, before anything else. postprocess_samples: of samples (image_id, plane, y, x, v) on the map.
    postprocess_estimate: of the map's samples in image frames (image_id, plane, y, x, v).
    """

    load: Callable[[SparkSession, str], DataFrame] = field(default=fits.images)
    preprocess: Step = field(default=_same)
    postprocess_samples: Step = field(default=_same)
    postprocess_estimate: Step = field(default=_same)


def _ready(images: DataFrame | str, processor: Processor) -> DataFrame:
    return processor.preprocess(processor.load(SparkSession.getActiveSession(), images) if isinstance(images, str) else images)


def image_bounds(images: DataFrame, grid: CarGrid, trim: Sequence[float] | str = (0, 0, 0, 0), sky: Sequence[float | None] | None = None, wrap_point: float = 0.0, wrap_aware: bool = True) -> DataFrame:
    """_BOXES of image_id, ny, nx, wcs: where each image lies on the grid; no row for images outside of sky. One row in, at most two out: nothing is moved.

    trim: pixels to leave out (left, right, bottom, top), or the column that holds them for each image.
    """
    own_trim = [trim] if isinstance(trim, str) else []
    target = Projection.of_grid(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = Projection.of_row_or_none(r["wcs"])
                if own is not None:
                    shape = (r["ny"], r["nx"])
                    boxes = find_bounds(own, shape, target, tuple(r[trim] or (0, 0, 0, 0)) if own_trim else tuple(trim), tuple(sky) if sky else None, wrap_point, wrap_aware)
                    boxes = boxes if sky else with_poles(boxes, own, shape, target)
                    rows += [(r["image_id"], k, *box) for k, box in enumerate(boxes)]
            kinds = [pa.int64(), *[pa.int32()] * 5]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _BOXES.split(", ")])

    return images.select("image_id", "ny", "nx", "wcs", *own_trim).mapInArrow(run, _BOXES)


def collective_bounds(lists: Sequence[DataFrame], grid: CarGrid, trims: Sequence[Sequence[float]] = ((0, 0, 0, 0),)) -> DataFrame:
    """xmin, xmax, ymin, ymax: one row, the box of all images of several image tables, each table with a trim of its own (or one for all). Nulls where no image has a place."""
    trims = list(trims) * (len(lists) if len(trims) == 1 else 1)
    boxes = [image_bounds(images, grid, trim, wrap_aware=False) for images, trim in zip(lists, trims, strict=True)]
    every = boxes[0]
    for more in boxes[1:]:
        every = every.unionByName(more)
    return every.agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


def plan_grid(images: DataFrame, scale: float = 0.04, ra_bounds: tuple[float, float] | str | None = None, dec_bounds: tuple[float, float] | None = None) -> CarGrid:
    """The sky at so many degrees a pixel, cut to RA and Dec ranges; without a Dec range to the rows that the images' boxes cover.

    ra_bounds: from and to, with to over 360 (or from under 0) for a map that runs over RA 0; "covered": the images' boxes on the circle without the largest gap between them; None: all of it.
    Ends are rounded down to whole pixel coordinates, the upper one is left out. Only image_id, ny, nx and wcs are looked at.
    """
    grid = default_grid(scale)
    ny, nx = grid.shape
    column = lambda ra: int(np.floor((ra - grid.crval[0]) / grid.cdelt[0] + grid.crpix[0] - 1 + 1e-9))
    row = lambda dec: int(np.floor((dec - grid.crval[1]) / grid.cdelt[1] + grid.crpix[1] - 1 + 1e-9))
    x0, x1 = (column(ra_bounds[0]), column(ra_bounds[1])) if isinstance(ra_bounds, tuple) else (0, nx)
    y0, y1 = (row(dec_bounds[0]), row(dec_bounds[1])) if dec_bounds is not None else (0, ny)
    if dec_bounds is None or ra_bounds == "covered":
        boxes = tables.written(image_bounds(images, grid), "boxes")
        if dec_bounds is None:
            low, high = boxes.agg(F.min("ymin"), F.max("ymax")).first()
            if low is not None:
                y0, y1 = max(low, 0), min(high, ny)
        if ra_bounds == "covered":
            x0, x1 = _covered(boxes, nx)
        tables.discard(boxes)
    if not (0 < x1 - x0 <= nx and 0 < y1 - y0):
        raise ValueError(f"no map of {x1 - x0} by {y1 - y0} pixels")
    # A map over the end of the circle is centred elsewhere, by whole pixels.
    if x0 < 0 or x1 > nx:
        away = (x0 + x1) // 2 - nx // 2
        grid = CarGrid(grid.crpix, ((grid.crval[0] + away * grid.cdelt[0]) % 360.0, grid.crval[1]), grid.cdelt, grid.shape)
        x0, x1 = x0 - away, x1 - away
    return grid.cropped(x0, y0, (y1 - y0, x1 - x0))


def _covered(boxes: DataFrame, nx: int) -> tuple[int, int]:
    """The columns of a circle of nx that boxes cover, without the largest gap. The driver sees a count for each column where boxes begin or end."""
    edges = boxes.select(F.explode(F.array(F.struct(F.col("xmin").alias("x"), F.lit(1).alias("n")), F.struct(F.col("xmax").alias("x"), F.lit(-1).alias("n")))).alias("e")).groupBy("e.x").agg(F.sum("e.n").alias("n")).collect()
    open_ = np.zeros(3 * nx + 1, np.int64)
    for x, n in edges:
        open_[min(max(x + nx, 0), 3 * nx)] += n
    covered = (np.cumsum(open_)[: 3 * nx] > 0).reshape(3, nx).any(0)
    if covered.all() or not covered.any():
        return 0, nx
    twice = np.concatenate([covered, covered])
    starts = np.flatnonzero(~twice & np.concatenate([[True], twice[:-1]]))  # where gaps begin
    ends = np.array([int(np.flatnonzero(twice[s:])[0]) + s if twice[s:].any() else 2 * nx for s in starts.tolist()])
    k = int(np.argmax(ends - starts))
    begin = int(ends[k]) % nx
    return begin, begin + nx - int(ends[k] - starts[k])


def _planes(batch: pa.RecordBatch, row: int, ny: int, nx: int) -> np.ndarray | None:
    """The planes of an image; None where its data are not whole planes."""
    data = batch.column("data").slice(row, 1)
    values = data.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) if data.is_valid()[0].as_py() else np.zeros(0)
    return values.reshape(-1, ny, nx) if len(values) and ny and nx and len(values) % (ny * nx) == 0 else None


def _placed_images(batches: Iterator[pa.RecordBatch], planes: bool) -> Iterator[tuple[dict, np.ndarray, Projection]]:
    for batch in batches:
        known = batch.drop_columns(["data"]).to_pylist()
        for k, r in enumerate(known):
            own, data = Projection.of_row_or_none(r["wcs"]), _planes(batch, k, r["ny"] or 0, r["nx"] or 0)
            if own is None or data is None:
                continue
            r["plane"] = r.get("plane") or 0
            if not planes and r["plane"] + len(data) > 1:
                raise ValueError(f"image {r['image_id']} has several planes: ask for planes, or choose one")
            yield r, data, own


def resampled(
    images: DataFrame, grid: CarGrid, block: tuple[int, int] | None = None, strict: bool = True, planes: bool = False, width: int = stack.STRIP, good_block: BlockTest | None = None
) -> DataFrame:
    """stack.ROWS of every image on the grid, flux conserved, in stretches of so many pixels; missing pixels spread over the kernel. All planes of an image share one mapping.

    block (rows, columns): only blocks of the map at whose centre the image has light are resampled, joined into strips; else the
    boxes that hold the image's edges. good_block: a test of one's own in place of light, of the image (planes, rows, columns) and the place (x, y) in it of a block's centre.
    """
    target, (ny, nx) = Projection.of_grid(grid), grid.shape
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, data, own in _placed_images(batches, planes):
            shape = data.shape[1:]
            boxes = with_poles(find_bounds(own, shape, target, wrap_aware=True), own, shape, target) if block is None else block_strips(data, own, target, (ny, nx), block, good_block)
            for xmin, xmax, ymin, ymax in boxes:
                xmin, xmax, ymin, ymax = max(xmin, 0), min(xmax, nx), max(ymin, 0), min(ymax, ny)
                if xmin >= xmax or ymin >= ymax:
                    continue
                begin, end = xmin // width * width, -(-xmax // width) * width
                step = max(1, STRIP_PIXELS // (xmax - xmin))
                for y0 in range(ymin, ymax, step):
                    size = (min(step, ymax - y0), xmax - xmin)
                    out = resample(data, lambda x, y, x0=xmin, y0=y0: own.world_to_pixel(*target.pixel_to_world(x + x0, y + y0)), size, strict=strict)
                    wide = np.full((*out.shape[:2], end - begin), np.nan)
                    wide[:, :, xmin - begin : xmax - begin] = out
                    wide = wide.reshape(len(out), size[0], -1, width)
                    plane, y, tile = np.nonzero(np.isfinite(wide).any(-1))
                    values = wide[plane, y, tile]
                    offsets = pa.array(np.arange(0, values.size + 1, width, dtype=np.int32))
                    columns = [[r["image_id"]] * len(y), plane + r["plane"], y + y0, begin + tile * width]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["image_id", "plane", "y", "x0", "values"])

    extra = ["plane"] if "plane" in images.columns else []
    return images.select(*_IMAGES, *extra).mapInArrow(run, stack.ROWS)


def block_strips(image: np.ndarray, own: Projection, target: Projection, shape: tuple[int, int], block: tuple[int, int], good_block: BlockTest | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes of adjoining blocks of the map, row by row, that pass a test of their centre's place in the image; by default that the image (planes, rows, columns) has light around it: any finite value but 0 in a window as large as a block."""
    height, width = block
    ys, xs = np.arange(0, shape[0], height), np.arange(0, shape[1], width)
    cx, cy = np.meshgrid(xs + width // 2, ys + height // 2)
    u, v = own.world_to_pixel(*target.pixel_to_world(cx.astype(float), cy.astype(float)))
    inside = np.isfinite(u) & np.isfinite(v)
    if good_block is not None:
        good = np.zeros(u.shape, bool)
        for k in zip(*np.nonzero(inside), strict=True):
            good[k] = good_block(image, (float(u[k]), float(v[k])))
    else:
        light = (np.isfinite(image) & (image != 0)).any(0)
        total = np.zeros((light.shape[0] + 1, light.shape[1] + 1), np.int64)
        total[1:, 1:] = light.cumsum(0).cumsum(1)
        u, v = np.where(inside, u, -1).astype(int), np.where(inside, v, -1).astype(int)
        inside &= (u > 0) & (u < light.shape[1]) & (v > 0) & (v < light.shape[0])
        a, b = np.clip(v - height // 2, 0, light.shape[0]), np.clip(v + height // 2, 0, light.shape[0])
        c, d = np.clip(u - width // 2, 0, light.shape[1]), np.clip(u + width // 2, 0, light.shape[1])
        good = inside & (total[b, d] - total[a, d] - total[b, c] + total[a, c] > 0)
    boxes = []
    for i, y in enumerate(ys.tolist()):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good[i].astype(int), [0]])))
        boxes += [(int(j) * width, int(k) * width, y, y + height) for j, k in edges.reshape(-1, 2)]
    return boxes


def raw_stack(images: DataFrame | str, grid: CarGrid, columns: tuple[int, int], processor: Processor = Processor(), planes: bool = False) -> DataFrame:
    """image_id, y, x, v (and plane with planes): the samples of columns from one up to another of the map, by the images that they come from. Only these are resampled."""
    x0, x1 = columns
    rows = resampled(_ready(images, processor), grid.cropped(x0, 0, (grid.shape[0], x1 - x0)), planes=planes)
    found = processor.postprocess_samples(stack.samples_of(rows).withColumn("x", (F.col("x") + x0).cast("int")))
    return found if planes else found.drop("plane")


#: The reducer of a map that asks for none.
DEFAULT_REDUCERS: Mapping[str, stack.Reducer] = {"gaussian": lambda v: gaussian_centre(v)}


def build_map(
    images: DataFrame | str, reducers: Mapping[str, stack.Reducer] | None = None, grid: CarGrid | None = None, processor: Processor = Processor(), frame_count: bool = False, attribution: bool = False,
    block: tuple[int, int] | None = None, strip: int = stack.STRIP, planes: bool = False, target_bytes: int = stack.TARGET_BYTES, good_block: BlockTest | None = None,
) -> DataFrame:
    """reducer_id, output_idx, y, x, value (and frame_count, attribution; plane with planes): each reducer's value of the samples at each pixel that any image covers.

    Without reducers the centre of a Gaussian fit; without a grid plan_grid(images). Each plane is a map of its own; without planes an image of several is refused. Results depend on
    neither the strip width nor the order of images. Where kernels would hold more than target_bytes of samples at once, as over a deep field, the stack is cut into narrower stretches. Images without an image_id take part; what is nearest to one of them is attributed to -1.
    """
    images = _ready(images, processor)
    grid = grid or plan_grid(images)
    rows = tables.written(resampled(images, grid, block, planes=planes, width=strip, good_block=good_block), "stack")
    if processor.postprocess_samples is not _same:
        rows = tables.written(stack.rows_of(processor.postprocess_samples(stack.samples_of(rows)), strip), "stack")
    made = stack.reduce_rows(rows, reducers or DEFAULT_REDUCERS, attribution, strip, target_bytes)
    return made.select("reducer_id", "output_idx", *(["plane"] if planes else []), "y", "x", "value", *(["frame_count"] if frame_count else []), *(["attribution"] if attribution else []))


def subtract_map(images: DataFrame | str, sky: DataFrame, grid: CarGrid, processor: Processor = Processor(), tile: int = 256, planes: bool = False, strict: bool = True) -> DataFrame:
    """image_id, y, x, source, blurred, estimate, remnant (and plane with planes): the map (y, x, value; plane) in each image's frame, flux conserved, off the image blurred as the map is.

    x of a map of the whole sky wraps around. estimate is null where any part of a pixel's footprint has no map; without strict where all of it has none beyond the part of the map
    that the image looks at. A map of several values at a pixel (of several reducers or outputs) is refused with ValueError. An image of several planes takes from each plane of the map, or from
    the only one that the map has.
    """
    images = _ready(images, processor)
    target, (ny, nx) = Projection.of_grid(grid), grid.shape
    cyclic = abs(nx * grid.cdelt[0] - 360.0) < 1e-9
    margin = 4

    # Stretches of map rows that an image may look at: its boxes and a margin, in columns of the map.
    boxes = image_bounds(images, grid).select("image_id", *((F.col(c) + d).alias(c) for c, d in (("xmin", -margin), ("xmax", margin), ("ymin", -margin), ("ymax", margin))))
    if cyclic:  # beyond an end lies the other one
        boxes = boxes.select("image_id", "ymin", "ymax", F.explode(F.array(*[F.struct((F.col("xmin") + k).alias("xmin"), (F.col("xmax") + k).alias("xmax")) for k in (-nx, 0, nx)])).alias("b")).select("image_id", "b.*", "ymin", "ymax")
    inside = boxes.select("image_id", F.greatest("xmin", F.lit(0)).alias("xmin"), F.least("xmax", F.lit(nx - 1)).alias("xmax"), F.greatest("ymin", F.lit(0)).alias("ymin"), F.least("ymax", F.lit(ny - 1)).alias("ymax"))
    inside = inside.filter("xmin <= xmax AND ymin <= ymax")
    spread = inside.select("image_id", "xmin", "xmax", F.explode(F.sequence(F.expr(f"xmin div {tile}"), F.expr(f"xmax div {tile}"))).alias("tile_x"), "ymin", "ymax")
    spread = spread.select("image_id", "xmin", "xmax", "tile_x", F.explode(F.sequence("ymin", "ymax")).alias("y"))
    # Both halves of an image over the map's end may look at one stretch.
    spread = spread.groupBy("image_id", "tile_x", "y").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
    plane = F.col("plane").cast("int") if planes else F.lit(0)
    stretches = sky.filter("value IS NOT NULL").select(plane.alias("plane"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value", F.expr(f"x div {tile}").alias("tile_x"))
    stretches = stretches.groupBy("plane", "y", "tile_x").agg(F.collect_list(F.struct("x", "value")).alias("pixels"))
    seen = spread.join(stretches, ["tile_x", "y"]).select("image_id", "plane", "y", F.filter("pixels", lambda p: p["x"].between(F.col("xmin"), F.col("xmax"))).alias("pixels"))

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 3]
    names = ["image_id", "plane", "y", "x", "source", "blurred", "estimate"]

    def run(image: pa.Table, seen: pa.Table) -> pa.Table:
        parts = []
        pixels = seen["pixels"].combine_chunks() if seen.num_rows else None
        flat = pixels.flatten() if pixels is not None else None
        if flat is not None and len(flat):
            many = pixels.value_lengths().to_numpy()
            at, ys = (np.repeat(seen[c].to_numpy(), many) for c in ("plane", "y"))
            xs, values = flat.field("x").to_numpy(), flat.field("value").to_numpy(zero_copy_only=False)
        else:
            at, ys, xs, values = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for r, data, own in _placed_images(iter(image.to_batches()), planes):
            out = np.full(data.shape, np.nan)
            if len(ys):
                # The part of the map that was sent, in a frame that begins half a turn before the image's middle.
                middle = target.world_to_pixel(*own.pixel_to_world(np.array([(r["nx"] - 1) / 2]), np.array([(r["ny"] - 1) / 2])))[0][0]
                begin = middle - nx / 2 if cyclic else 0.0
                place = lambda x: (x - begin) % nx + begin if cyclic else x
                px = np.rint(place(xs.astype(float))).astype(int)
                x0, y0 = px.min(), ys.min()
                canvas = np.full((int(at.max()) + 1, ys.max() - y0 + 1, px.max() - x0 + 1), np.nan)
                place_of = np.ravel_multi_index((at, ys - y0, px - x0), canvas.shape)
                if len(np.unique(place_of)) < len(place_of):
                    raise ValueError("the map has several values at a pixel: choose one reducer_id and output_idx")
                canvas.ravel()[place_of] = values

                def mapping(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    u, v = target.world_to_pixel(*own.pixel_to_world(x, y))
                    return place(u) - x0, v - y0

                back = resample(canvas, mapping, data.shape[1:], strict=strict)
                for k in range(len(data)):
                    if len(back) == 1 or r["plane"] + k < len(back):
                        out[k] = back[0 if len(back) == 1 else r["plane"] + k]
            k, y, x = (g.ravel() for g in np.indices(data.shape))
            parts.append(([r["image_id"]] * data.size, k + r["plane"], y, x, data.ravel(), np.stack([blurred(p) for p in data]).ravel(), out.ravel()))
        whole = [pa.table([pa.array(c, k, from_pandas=True) for c, k in zip(part, kinds, strict=True)], names=names) for part in parts]
        return pa.concat_tables(whole) if whole else pa.table([pa.array([], k) for k in kinds], names=names)

    whole = images.select(*_IMAGES, *(["plane"] if "plane" in images.columns else []))
    both = whole.groupBy("image_id").cogroup(seen.groupBy("image_id")).applyInArrow(run, "image_id bigint, plane int, y int, x int, source double, blurred double, estimate double")
    if processor.postprocess_estimate is not _same:
        kept = processor.postprocess_estimate(both.select("image_id", "plane", "y", "x", F.col("estimate").alias("v"))).select("image_id", "plane", "y", "x", F.col("v").alias("estimate"))
        both = both.drop("estimate").join(kept, ["image_id", "plane", "y", "x"], "left")
    out = both.withColumn("remnant", F.col("blurred") - F.col("estimate"))
    return out if planes else out.drop("plane")


@dataclass(frozen=True)
class StoredMap:
    """A map in a folder: pixels by tile, and one row of its grid."""

    rows: DataFrame
    grid: CarGrid
    tile: int
    meta: Mapping[str, str]

    def around(self, images: DataFrame, margin: int = 4) -> DataFrame:
        """The pixels of the tiles that images touch; the others' files are not read. The driver sees the tiles, no more than the map has."""
        ny, nx = self.grid.shape
        span = lambda low, high, n: F.explode(F.transform(F.sequence(F.floor((F.col(low) - margin) / self.tile), F.floor((F.col(high) + margin) / self.tile)), lambda t: F.pmod(t, F.lit(-(-n // self.tile)))))
        touched = image_bounds(images, self.grid).select(span("xmin", "xmax", nx).alias("tile_x"), "ymin", "ymax").select("tile_x", span("ymin", "ymax", ny).alias("tile_y"))
        # Tiles of one row of the map are asked for together; the ends of the circle, which need not be whole tiles, with one more.
        tiles = {(r.tile_y, x) for r in touched.distinct().collect() for x in (r.tile_x, *([0, -(-nx // self.tile) - 2] if r.tile_x in (0, -(-nx // self.tile) - 1) else []))}
        by_row: dict[int, list[int]] = {}
        for y, x in sorted(tiles):
            by_row.setdefault(y, []).append(x)
        wanted = F.lit(False)
        for y, xs in by_row.items():
            wanted = wanted | ((F.col("tile_y") == y) & F.col("tile_x").isin(xs))
        return self.rows.filter(wanted).drop("tile_y", "tile_x")


def save_map(made: DataFrame, grid: CarGrid, path: str, tile: int = 256, meta: Mapping[str, str] | None = None, overwrite: bool = False) -> None:
    """Writes a map as pixels by tile beside one row of its grid; refuses a path in use unless told to overwrite."""
    mode = "overwrite" if overwrite else "errorifexists"
    keyed = made.withColumns({"tile_y": F.expr(f"y div {tile}").cast("int"), "tile_x": F.expr(f"x div {tile}").cast("int")})
    keyed.repartition("tile_y", "tile_x").write.mode(mode).partitionBy("tile_y", "tile_x").parquet(f"{path}/pixels")
    row = (list(grid.crpix), list(grid.crval), list(grid.cdelt), list(grid.shape), tile, dict(meta or {}))
    made.sparkSession.createDataFrame([row], "crpix array<double>, crval array<double>, cdelt array<double>, shape array<int>, tile int, meta map<string,string>").coalesce(1).write.mode(mode).parquet(f"{path}/wcs")


def load_map(spark: SparkSession, path: str) -> StoredMap:
    """The map that save_map wrote, with the grid that it lies on."""
    r = spark.read.parquet(f"{path}/wcs").first()
    return StoredMap(spark.read.parquet(f"{path}/pixels"), CarGrid(tuple(r.crpix), tuple(r.crval), tuple(r.cdelt), tuple(r.shape)), r.tile, dict(r.meta))


def save(rows: DataFrame, path: str, meta: Mapping[str, str] | None = None, overwrite: bool = False) -> None:
    """Writes a map or subtracted images as a table, refusing a path in use unless told to overwrite; meta goes beside each row as a map column."""
    if meta is not None:
        rows = rows.withColumn("meta", F.create_map(*[F.lit(v) for pair in meta.items() for v in pair]))
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def subtracted_images(rows: DataFrame, images: DataFrame, column: str = "remnant") -> DataFrame:
    """image_id, name, ny, nx, data, meta, history of one column of subtract_map, for nightloom.sources.fits.write: with the images' own cards, and a line of history. name: the file's name in path, else image_id.fits."""
    has = set(images.columns)
    plane = F.col("plane") if "plane" in rows.columns else F.lit(0)
    each = rows.select("image_id", plane.alias("plane"), "y", "x", F.col(column).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        plane, y, x = (table[c].to_numpy() for c in ("plane", "y", "x"))
        data = np.full((plane.max() + 1, y.max() + 1, x.max() + 1), np.nan)
        data[plane, y, x] = table["v"].to_numpy()
        values = pa.ListArray.from_arrays(pa.array([0, data.size], pa.int32()), pa.array(data.ravel()))
        return pa.table([table["image_id"].combine_chunks().slice(0, 1), pa.array([data.shape[1]], pa.int32()), pa.array([data.shape[2]], pa.int32()), values], names=["image_id", "ny", "nx", "data"])

    made = each.groupBy("image_id").applyInArrow(run, "image_id bigint, ny int, nx int, data array<double>")
    name = F.element_at(F.split("path", "/"), -1) if "path" in has else F.concat(F.col("image_id").cast("string"), F.lit(".fits"))
    meta = F.col("meta") if "meta" in has else F.lit(None).cast("map<string,string>")
    known = images.select("image_id", name.alias("name"), meta.alias("meta")).dropDuplicates(["image_id"])
    return made.join(known, "image_id").select("*", F.array(F.lit(f"background subtracted: {column}")).alias("history"))
