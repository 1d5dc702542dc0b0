"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever these operators speak of words.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Without one only a local session, as in tests, has a folder that all its tasks see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"file://{tempfile.gettempdir()}/nightloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of this process that lie in the shared folder.
_LEFT: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder, which is deleted when the driver's process ends if not before, and reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    _LEFT.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def fresh(columns: Iterable[str], base: str) -> str:
    """base, made longer until no column has a name that begins with it, in whatever case."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(base) for c in taken):
        base += "_"
    return base


def words_of(text: Column) -> Column:
    """The words of a text as an array; of a null text an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _store(uri: str):
    """A filesystem and a path in it. Only the driver needs it, so it is not loaded into the memory of all workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _sizes(uri: str) -> int:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return sum(i.size or 0 for i in store.get_file_info(fs.FileSelector(path)))


#: Written tables under this are small: what Spark shuffles of them is left to its own cleaning, and they are worked on in one go.
SMALL_BYTES = 2**25


def small(*tables: DataFrame) -> bool:
    """Whether tables of materialize() are small together."""
    return sum(_sizes(t._written) for t in tables) < SMALL_BYTES


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Lets Spark remove the shuffle files of plans that are done: it does so once the driver's collector has run. tables: what these plans shuffle is in proportion to; not worth the time where they are small."""
    if tables and small(*tables):
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        store, path = _store(df._written)
        store.delete_dir(path)
        _LEFT.discard(df._written)


@atexit.register
def _delete_what_is_left() -> None:
    for uri in _LEFT:
        with suppress(OSError, ValueError):  # a folder that is gone, or that only Spark reaches
            store, path = _store(uri)
            store.delete_dir(path)
