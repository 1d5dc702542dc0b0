"""Images, samples, stars and footprints as views of the driver's tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Without one only a local session has a place that all its tasks see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"file://{tempfile.gettempdir()}/nightloom"


#: Tables of this process that lie in the shared folder.
_LEFT: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, deleted when the driver's process ends if not before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*rows: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in rows:
        store, path = fs.FileSystem.from_uri(df._written)
        store.delete_dir(path)
        _LEFT.discard(df._written)


@atexit.register
def _delete_what_is_left() -> None:
    for uri in _LEFT:
        with suppress(OSError, ValueError):  # a folder that is gone, or that only Spark reaches
            store, path = fs.FileSystem.from_uri(uri)
            store.delete_dir(path)


def numbered(rows: DataFrame, key: str, name: str, pieces: int = 256) -> DataFrame:
    """rows with their number (from 0) in the order of a distinct key: within ranges of the key and by the ranges' counts, not in one task."""
    ranged = written(rows.repartitionByRange(pieces, key).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return ranged.join(F.broadcast(ahead), "_part").withColumn(name, place).drop("_part", "_ahead")


def sky_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ny, nx, data, wcs: embeddings as 8 x 8 images of one degree a pixel, dithered about RA 0 and Dec 0; some cross RA 0."""
    k = F.col("vec_id")
    ra, dec = F.pmod(F.lit(352.5) + k % 9, F.lit(360.0)), F.expr("vec_id div 9") % 9 - F.lit(9.5)
    pair = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    wcs = F.struct(
        F.lit("CAR").alias("kind"), pair(F.lit(1), F.lit(1) - dec).alias("crpix"), pair(ra, F.lit(0)).alias("crval"), pair(F.lit(1), F.lit(1)).alias("cdelt"),
        F.lit(None).cast("array<double>").alias("pc"), F.lit(None).cast("array<double>").alias("pv"),
    )
    return table(spark, sf_dir, "embeddings").select(k.alias("image_id"), F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.col("embedding").cast("array<double>").alias("data"), wcs.alias("wcs"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: embeddings as 8 x 8 images, NaN as null."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v")).select(
        "image_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.nullif(F.col("v").cast("double"), F.lit(float("nan"))).alias("v")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images dithered over a common 16 x 16 frame."""
    return pixels(spark, sf_dir).select(
        "image_id", (F.col("y") + F.col("image_id") % 9).cast("int").alias("y"), (F.col("x") + F.expr("image_id div 9") % 9).cast("int").alias("x"), "v"
    )


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """star_id, ra, dec, vmag from customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("star_id"), ((k * 7919 % 36000) / 100).alias("ra"), ((k * 104729 % 17999) / 100 - 90).alias("dec"), (F.col("c_acctbal").cast("double") / 1000).alias("vmag")
    )


def field_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """star_id, ra, dec, vmag from orders, about RA 0 and Dec 0, where sky_images() look."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("star_id"), F.pmod((k * 7919 % 30000) / 1000 + 345.0003, F.lit(360.0)).alias("ra"), ((k * 104729 % 30000) / 1000 - 15.0003).alias("dec"), (F.col("o_totalprice").cast("double") / 50000).alias("vmag")
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, group, centre and half width of pointed square frames, from parts; some cross RA 0."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"), F.col("p_brand").alias("camera"),
        ((k * 611953 % 36000) / 100).alias("ra0"), ((k * 15485863 % 16000) / 100 - 80).alias("dec0"), (F.col("p_size") / 10.0).alias("half"),
    )
