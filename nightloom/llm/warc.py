"""Deterministic sharded WARC archives of pages, and their reader.

Pages are cut into shards by ranges of page_id of about equal bytes: the exact running sum of bytes in the order of page_id
says where a shard begins, so neither gaps in the ids nor how rows are dealt matter. Within a shard
records are sorted, and files roll by compressed size, so the archives of the same
rows are the same bytes however often a task runs. Each file is written under a
temporary name and renamed when whole; the manifest, a table written last by Spark's own
committer, lists the files that count. Readers start from the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, new_folder

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 100
SHARD_BYTES = 24 * 2**20
ROLL_BYTES = 8 * 2**20
#: The date of all records: archives depend on nothing but the pages.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "file string, shard bigint, roll int, records bigint, bytes bigint, sha256 string"
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warc-page:{name}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def _page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id if page_id is not None else f"null:{digest}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
        return _member(headers, http)
    return _member(headers, http + payload)


class _ShardFiles:
    """The files of one shard, one open at a time."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.roll, self.out, self.done = shard, roll_bytes, 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:09d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.hash = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.root}/{self.name}")  # a second attempt's file has the same bytes
            self.done.append((self.name, self.shard, self.roll, self.records, self.size, self.hash.hexdigest()))
            self.out, self.roll = None, self.roll + 1


def _cuts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """Where shards begin: the smallest place of each; sizes(place, bytes): each place once. The driver sees one number for each shard."""
    ranged = materialize(sizes.repartitionByRange("place").withColumn("part", F.spark_partition_id()), "sizes")
    parts = ranged.groupBy("part").agg(F.sum("bytes").alias("sum"), F.min("place").alias("low"))  # a row for each partition
    ahead = parts.select("part", F.coalesce(F.sum("sum").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    shard = F.floor((F.col("ahead") + F.coalesce(F.sum("bytes").over(within), F.lit(0))) / F.lit(shard_bytes))
    starts = ranged.join(F.broadcast(ahead), "part").withColumn("shard", shard).groupBy("shard").agg(F.min("place").alias("place")).select("place").toArrow()
    discard(ranged)
    return np.sort(starts["place"].to_numpy())


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives of pages(page_id, url, html) under folder and returns the committed manifest.

    A null html is an empty payload, a null url an empty one. Of equal payloads of REVISIT_FROM bytes or more, the
    record of the smallest page_id is the response (so are its repeated rows and rows of null page_id), the others
    revisit it. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Rows of null page_id are placed by their digests, in shards of their own.
    by_digest = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("place", F.coalesce(F.col("page_id"), by_digest))
    sizes = rows.groupBy(F.col("page_id").isNull().alias("unknown"), "place").agg(F.sum(F.octet_length("payload") + F.lit(1)).alias("bytes"))
    known, unknown = (_cuts(sizes.filter(f"unknown = {flag}").select("place", "bytes"), shard_bytes) for flag in (False, True))
    n_shards = max(1, len(known) + len(unknown))
    cuts = spark.sparkContext.broadcast((known, unknown))  # 8 bytes for each shard

    @F.pandas_udf("long")
    def shard_of(place: pd.Series, no_id: pd.Series) -> pd.Series:
        known, unknown = cuts.value
        at = place.to_numpy()
        with_id, without = np.searchsorted(known, at, side="right") - 1, len(known) + np.searchsorted(unknown, at, side="right") - 1
        return pd.Series(np.where(no_id.to_numpy(), without, with_id))

    shard = shard_of("place", F.col("page_id").isNull())
    # What a page revisits goes beside the page through the one range shuffle; the payloads are never joined.
    keys = rows.filter(F.octet_length("payload") >= REVISIT_FROM).select("page_id", "place", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    marks = keys.join(first, "digest").filter("page_id > refers_to").select("page_id", "place", "digest", "refers_to").distinct()
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("is_page", F.lit(1)).unionByName(
        marks.withColumn("is_page", F.lit(0)), allowMissingColumns=True
    )
    dealt = (
        both.withColumn("shard", shard)
        .repartitionByRange(n_shards, "shard")
        .sortWithinPartitions("shard", "page_id", "is_page", "digest", "url")
        .select("shard", "page_id", "url", "payload", "digest", "refers_to", "is_page")
    )
    fs_, root = fs.FileSystem.from_uri(folder)
    fs_.create_dir(f"{root}/_temporary", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at, refers = None, object(), {}
        done: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for shard, page_id, url, payload, digest, refers_to, is_page in zip(*columns, strict=True):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = _ShardFiles(folder, shard, roll_bytes)
                if page_id != at:
                    at, refers = page_id, {}
                if is_page:
                    files.write(_page_member(page_id, url, payload, digest, refers.get(digest)))
                else:
                    refers[digest] = refers_to
        if files is not None:
            files.close()
            done += files.done
        if done:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MANIFEST_SCHEMA.split(", ")])

    dealt.mapInArrow(run, MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of a file."""
    data = memoryview(data)
    while data:
        unpack, pieces, step = zlib.decompressobj(31), [], 2**16
        while not unpack.eof and data:  # in steps, as what follows a member is copied
            taken = data[:step]
            pieces.append(unpack.decompress(taken))
            data = data[len(taken) - len(unpack.unused_data) :]
        if not unpack.eof:
            raise ValueError("a file ends within a record")
        head, _, rest = b"".join(pieces).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"the block of {headers['WARC-Record-ID']} differs from its digest")
        yield headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records (RECORD_SCHEMA) of the files that the manifest of folder lists; each file, block and payload is held against its digest."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    n_files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    data = source.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} differs from the manifest")
                rows = []
                for headers, block in _records(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} differs from its digest")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    rows.append((page and int(page), headers["WARC-Target-URI"], size, digest, kind, refers and int(refers)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    return manifest.select("file", "sha256").repartition(max(1, n_files)).mapInArrow(run, RECORD_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages in the shared folder and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""
