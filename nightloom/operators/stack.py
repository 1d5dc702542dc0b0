"""Reduction of the stack of samples at each map pixel."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nightloom.functions.reducers import KERNELS
from nightloom.sources import tables

#: Pixels of a row whose stacks go to a kernel together.
STRIP = 16

#: Bytes of samples that a kernel's task holds at once.
TARGET_BYTES = 2**28

#: The stack: of each image the stretches of map rows that it covers, NaN where it has nothing there.
ROWS = "image_id bigint, plane int, y int, x0 int, values array<double>"

#: A user's reducer: samples of one pixel to one value or several; or an aggregate of the column v.
Kernel = Callable[[np.ndarray], float | Sequence[float]]
Reducer = Column | Kernel


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def rounded(v: Column, digits: int) -> Column:
    """F.round of finite doubles, with 0.0 for -0.0. It works on decimal text, which costs more than a row of a join, so it is asked only near ties and of very large values."""
    scaled = v * F.lit(10.0**digits)
    sure = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001)  # scaled is off by 2^-12 at most
    return F.when(sure, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(v, digits) + 0.0)


def percentile_map(samples: DataFrame, percentiles: Sequence[float], keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """keys, output_idx, value, frame_count: linear percentiles (0 to 100) of each pixel, missing samples left out."""
    v = F.nullif(F.col("v"), F.lit(float("nan")))
    found = samples.groupBy(*keys).agg(F.percentile(v, F.array(*[F.lit(p / 100) for p in percentiles])).alias("p"), F.count_if(finite(v)).alias("frame_count"))
    return found.select(*keys, F.posexplode("p").alias("output_idx", "value"), "frame_count")


def attribution(samples: DataFrame, reduced: DataFrame, keys: Sequence[str] = ("y", "x"), outputs: Sequence[str] = ()) -> DataFrame:
    """keys, outputs, value, attribution: the image whose sample is nearest to the reduced value, the smaller id on ties; -1 where the value is not finite.

    outputs: further columns of reduced that tell several values of one pixel apart.
    """
    by = [*keys, *outputs]
    near = samples.filter(finite(F.col("v"))).join(reduced.select(*by, "value"), list(keys))
    best = near.groupBy(*by).agg(F.first("value").alias("value"), F.min(F.struct(F.abs(F.col("v") - F.col("value")).alias("d"), "image_id")).alias("b"))
    return best.select(*by, "value", F.when(finite(F.col("value")), F.col("b.image_id")).otherwise(F.lit(-1)).cast("long").alias("attribution"))


def kernel_map(samples: DataFrame, kernel: str, keys: Sequence[str] = ("y", "x"), strip: int = STRIP, **options) -> DataFrame:
    """keys, value, n: a kernel of nightloom.functions.reducers on each pixel's stack; n counts its finite samples.

    The last key's values go to the kernel strip by strip, so a task holds the samples of strip pixels at most: as
    many as images for each.
    """
    reduce = KERNELS[kernel]
    found = _by_strips(samples, list(keys), {"value": lambda v: reduce(v, **options)}, strip)
    return found.select(*keys, "value", "n")


def _by_strips(samples: DataFrame, keys: list[str], kernels: Mapping[str, Kernel], strip: int) -> DataFrame:
    """keys, reducer_id, output_idx, value, n of every kernel on each pixel's stack."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        values = table["v"].to_numpy().astype(float)
        codes = [table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        new = np.ones(len(values), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        first = np.flatnonzero(new)
        row, name, index, value, n = [], [], [], [], []
        for at, stack in zip(first.tolist(), np.split(values, first[1:]), strict=True):
            count = int(np.isfinite(stack).sum())
            for reducer_id, kernel in kernels.items():
                for k, v in enumerate(np.atleast_1d(kernel(stack))):
                    row.append(at), name.append(reducer_id), index.append(k), value.append(float(v)), n.append(count)
        out = table.select(keys).take(pa.array(row, pa.int64()))
        for column, data, kind in (("reducer_id", name, pa.string()), ("output_idx", index, pa.int32()), ("value", value, pa.float64()), ("n", n, pa.int64())):
            out = out.append_column(column, pa.array(data, kind))
        return out

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "reducer_id string, output_idx int, value double, n bigint"])
    strips = F.expr(f"{keys[-1]} div {strip}") if kinds[keys[-1]] in ("int", "bigint") else F.col(keys[-1])
    return samples.select(*keys, "v").groupBy(*keys[:-1], strips.alias("_strip")).applyInArrow(run, schema)


def reduce_stack(samples: DataFrame, reducers: Mapping[str, Reducer], keys: Sequence[str] = ("y", "x"), strip: int = STRIP) -> DataFrame:
    """reducer_id, output_idx, keys, value, frame_count of several reducers at once.

    Aggregates share one pass of partial aggregation, kernels another by strips. An aggregate may give an array, a kernel a sequence: an
    output each. frame_count: finite samples of the pixel.
    """
    keys = list(keys)
    columns = ["reducer_id", "output_idx", *keys, "value", "frame_count"]
    aggregates = {k: r for k, r in reducers.items() if isinstance(r, Column)}
    kernels = {k: r for k, r in reducers.items() if not isinstance(r, Column)}
    parts = []
    if aggregates:
        clean = samples.withColumn("v", F.nullif(F.col("v"), F.lit(float("nan"))))
        wide = clean.groupBy(*keys).agg(F.count_if(finite(F.col("v"))).alias("frame_count"), *[r.alias(f"_{i}") for i, r in enumerate(aggregates.values())])
        kinds = {f.name: f.dataType.typeName() for f in wide.schema}
        outputs = [F.struct(F.lit(k).alias("reducer_id"), (F.col(f"_{i}") if kinds[f"_{i}"] == "array" else F.array(F.col(f"_{i}").cast("double"))).cast("array<double>").alias("values")) for i, k in enumerate(aggregates)]
        each = wide.select(*keys, "frame_count", F.explode(F.array(*outputs)).alias("r"))
        parts.append(each.select("r.reducer_id", *keys, "frame_count", F.posexplode("r.values").alias("output_idx", "value")).select(*columns))
    if kernels:
        parts.append(_by_strips(samples, keys, kernels, strip).withColumnRenamed("n", "frame_count").select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def samples_of(rows: DataFrame) -> DataFrame:
    """image_id, plane, y, x, v of ROWS, one for each finite sample."""
    each = rows.select("image_id", "plane", "y", "x0", F.posexplode("values").alias("_at", "v")).filter(finite(F.col("v")))
    return each.select("image_id", "plane", "y", (F.col("x0") + F.col("_at")).alias("x"), "v")


def rows_of(samples: DataFrame, width: int = STRIP) -> DataFrame:
    """ROWS of samples (image_id, plane, y, x, v), in stretches of so many pixels; of an image's repeated samples of one pixel each is kept, in rows of its own."""
    at = F.expr(f"x div {width} * {width}").cast("int")
    each = samples.filter(finite(F.col("v"))).select("image_id", F.col("plane").cast("int").alias("plane"), F.col("y").cast("int").alias("y"), at.alias("x0"), (F.col("x") - at).cast("int").alias("at"), F.col("v").cast("double").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        ids, at, v = table["image_id"], table["at"].to_numpy(), table["v"].to_numpy()
        image = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((at, image))
        key = image[order].astype(np.int64) * width + at[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        each = np.stack([image[order], nth], 1)
        own, row = np.unique(each, axis=0, return_inverse=True)
        out = np.full((len(own), width), np.nan)
        out[row.ravel(), at[order]] = v[order]
        first = np.unique(image, return_index=True)[1]
        plane, y, x0 = (pa.array(np.full(len(own), table[c][0].as_py()), pa.int32()) for c in ("plane", "y", "x0"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
        return pa.table([ids.combine_chunks().take(pa.array(first[own[:, 0]])), plane, y, x0, values], names=["image_id", "plane", "y", "x0", "values"])

    return each.groupBy("plane", "y", "x0").applyInArrow(run, ROWS)


def narrowed(rows: DataFrame, width: int, target_bytes: int) -> DataFrame:
    """ROWS whose stretches are cut in halves until those of the most images hold no more than target_bytes, or one pixel."""
    deepest = rows.groupBy("plane", "y", "x0").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    now = width
    while now > 1 and deepest * now * 8 > target_bytes:
        now = -(-now // 2)
    if now == width:
        return rows
    parts = F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(now)), lambda at: F.struct((F.col("x0") + at).alias("x0"), F.slice("values", at + 1, F.lit(now)).alias("values")))
    cut = rows.select("image_id", "plane", "y", F.explode(parts).alias("p")).select("image_id", "plane", "y", "p.x0", "p.values")
    return cut.filter(F.exists("values", finite))


def reduce_rows(rows: DataFrame, reducers: Mapping[str, Reducer], attribute: bool = False, width: int = STRIP, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """reducer_id, output_idx, plane, y, x, value, frame_count (and attribution) of several reducers over one written stack (ROWS).

    Aggregates share one pass of partial aggregation over samples, kernels one pass over stretches of map rows, which attributes on the way. attribution: the image
    whose sample is nearest to the value, the smaller id on ties; -1 where the value is not finite.
    """
    keys = ["plane", "y", "x"]
    columns = ["reducer_id", "output_idx", *keys, "value", "frame_count", *(["attribution"] if attribute else [])]
    aggregates = {k: r for k, r in reducers.items() if isinstance(r, Column)}
    kernels = {k: r for k, r in reducers.items() if not isinstance(r, Column)}
    parts = []
    if aggregates:
        samples = samples_of(rows)
        made = reduce_stack(samples, aggregates, keys)
        if attribute:
            outputs = ["reducer_id", "output_idx"]
            found = attribution(samples, made, keys, outputs).drop("value")
            made = made.join(found, [*keys, *outputs], "left").withColumn("attribution", F.coalesce("attribution", F.lit(-1).cast("long")))
        parts.append(made.select(*columns))
    if kernels:
        kinds = {"plane": pa.int32(), "y": pa.int32(), "x": pa.int32(), "reducer_id": pa.string(), "output_idx": pa.int32(), "value": pa.float64(), "frame_count": pa.int64(), "attribution": pa.int64()}

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("image_id")
            ids = table["image_id"].fill_null(-1).to_numpy()
            held = table["values"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            plane, y, x0 = (table[c][0].as_py() for c in ("plane", "y", "x0"))
            out: list[tuple] = []
            for k in np.flatnonzero(np.isfinite(held).any(0)).tolist():
                good = np.isfinite(held[:, k])
                values, of = held[good, k], ids[good]
                for name, kernel in kernels.items():
                    for i, v in enumerate(np.atleast_1d(kernel(values))):
                        nearest = int(of[np.argmin(np.abs(values - v))]) if attribute and np.isfinite(v) else -1
                        out.append((plane, y, x0 + k, name, i, float(v), len(values), nearest))
            cells = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.table([pa.array(c, k) for c, k in zip(cells, kinds.values(), strict=True)], names=list(kinds))

        schema = "plane int, y int, x int, reducer_id string, output_idx int, value double, frame_count bigint, attribution bigint"
        parts.append(narrowed(rows, width, target_bytes).groupBy("plane", "y", "x0").applyInArrow(run, schema).select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clip_by_rounds(samples: DataFrame, key: str, n_sigma: float, min_size: int, limit: int = 1000) -> DataFrame:
    """key, value, kept: the clipped mean of groups of any size.

    What a clip keeps is a range of values, so a round is one aggregation with partial sums and the state is one row for each group, written
    as a table: no group is ever gathered, and the driver sees one number a round. value is null where fewer than min_size samples are left.
    RuntimeError where the ranges have not settled within the limit.
    """
    rows = samples.filter(finite(F.col("v"))).select(key, "v")
    state, settled = None, -1
    for _ in range(limit):
        if state is None:
            ranged, inside = rows.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")}), F.lit(True)
        else:
            known = state.select(F.col(key).alias("_key"), "lo", "hi")  # a null key is a group as well
            ranged, inside = rows.join(known, F.col(key).eqNullSafe(F.col("_key"))), (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))
        kept = F.when(inside, F.col("v"))
        now = ranged.groupBy(key).agg(F.count(kept).alias("kept"), F.avg(kept).alias("mean"), F.stddev_pop(kept).alias("dev"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        reach = n_sigma * F.col("dev")
        total = Observation()
        before, state = state, tables.written(now.select(key, F.greatest("lo", F.col("mean") - reach).alias("lo"), F.least("hi", F.col("mean") + reach).alias("hi"), "kept", "mean").observe(total, F.sum("kept").alias("kept")), "clip")
        if before is not None:
            tables.discard(before)
        if total.get["kept"] == settled or not total.get["kept"]:
            return state.select(key, F.when(F.col("kept") >= min_size, F.col("mean")).alias("value"), "kept")
        settled = total.get["kept"]
    raise RuntimeError(f"the clip has not settled within {limit} rounds")


def histogram(samples: DataFrame, key: str, bins: int) -> DataFrame:
    """key, bin, n: counts of finite samples in equal bins between each group's least and greatest finite value, the last bin closed; a group of one value lies in a range of 0.5 on either side of it. A null key is a group."""
    good = samples.filter(finite(F.col("v"))).select(key, "v")
    edges = good.groupBy(F.col(key).alias("_key")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    one = F.col("lo") == F.col("hi")
    edges = edges.select("_key", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return good.join(edges, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Bins of a round of quantiles().
QUANTILE_BINS = 1024


def quantiles(rows: DataFrame, shares: Sequence[float], value: str = "v", exact_below: int = 100_000) -> DataFrame:
    """share, value: exact linear quantiles (shares 0 to 1) of all finite values, however many there are; null where there are none.

    The two order statistics that a quantile lies between are enclosed in ever smaller ranges of values: a round counts the values of each range in QUANTILE_BINS bins, with partial sums,
    until a range has few values or one value only. No group is gathered; the driver sees counts of bins, and at most exact_below values for each order statistic.
    """
    good = rows.filter(finite(F.col(value))).select(F.col(value).cast("double").alias("v"))
    n, low, high = good.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([(float(p), None) for p in shares], "share double, value double")
    ranks = sorted({r for p in shares for r in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))))})
    found: dict[int, float] = {}
    left = {r: (low, high, 0, n) for r in ranks}  # of each rank a closed range, how many values lie below it and in it
    while left:
        for r, (a, b, _, _) in list(left.items()):
            if a == b:
                found[r] = a
                del left[r]
        ranges = sorted({(a, b) for a, b, _, inside in left.values() if inside > exact_below})
        small = sorted({(a, b) for a, b, _, inside in left.values() if inside <= exact_below})
        for a, b in small:
            values = np.sort(np.array([r.v for r in good.filter(F.col("v").between(a, b)).collect()]))
            for r, (c, d, below, _) in list(left.items()):
                if (c, d) == (a, b):
                    found[r] = float(values[r - below])
                    del left[r]
        if ranges:
            share = lambda a, b: (F.col("v") - a) / (b - a) if np.isfinite(b - a) else (F.col("v") / 2 - a / 2) / (b / 2 - a / 2)
            at = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), F.least(F.floor(share(a, b) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)).alias("bin"))) for k, (a, b) in enumerate(ranges)]
            each = good.select("v", F.explode(F.array(*at)).alias("at")).filter("at IS NOT NULL")
            counted = each.groupBy("at.k", "at.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "bin").collect()
            for r, (a, b, below, _) in list(left.items()):
                for c in (c for c in counted if ranges[c.k] == (a, b)):
                    if r < below + c.n:
                        left[r] = (c.lo, c.hi, below, c.n)
                        break
                    below += c.n
    values = [(float(p), found[int(np.floor(p * (n - 1)))], found[int(np.ceil(p * (n - 1)))], p * (n - 1) - np.floor(p * (n - 1))) for p in shares]
    return spark.createDataFrame([(p, float(a + (b - a) * t)) for p, a, b, t in values], "share double, value double")


def reducers_map(samples: DataFrame, reducers: Mapping[str, Column], keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """keys, reducer_id, value: several aggregates over one stack in one pass."""
    found = samples.groupBy(*keys).agg(*[e.alias(n) for n, e in reducers.items()])
    return found.unpivot(list(keys), list(reducers), "reducer_id", "value")
