"""FITS images: the first unit with data, its sky axes and its header, one row for each file; and images written as FITS files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from nightloom.functions.projection import WCS_SCHEMA, Projection
from nightloom.sources import tables

SCHEMA = "path string, ny int, nx int, data array<double>, wcs_key string, meta map<string,string>"
HEADER_SCHEMA = f"path string, ny int, nx int, planes int, wcs {WCS_SCHEMA}, problem string, meta map<string,string>, bytes_read bigint"
_WCS = pa.struct([("kind", pa.string()), *[(k, pa.list_(pa.float64())) for k in ("crpix", "crval", "cdelt", "pc", "pv", "pole")]])
_BLOCK = 2880
_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_CARD = re.compile(r"\s*('(?:[^']|'')*'|[^/]*)")


def _header(take) -> tuple[dict[str, str], list[int], np.dtype] | None:
    """The cards, axes and number type of the unit that begins here; take(n) gives the next n bytes. None at the end of the file."""
    header: dict[str, str] = {}
    while True:
        block = bytes(take(_BLOCK)).decode("ascii", "replace")
        if len(block) < _BLOCK:
            return None
        for k in range(0, _BLOCK, 80):
            card = block[k : k + 80]
            if card[:8].rstrip() == "END":
                axes = [int(header[f"NAXIS{k}"]) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
                return header, axes, np.dtype(_TYPES[int(header.get("BITPIX", 8))])
            if card[8:10] == "= ":
                value = _CARD.match(card[10:])[1].strip()
                header[card[:8].rstrip()] = value[1:-1].replace("''", "'").rstrip() if value.startswith("'") else value


def units(raw: bytes) -> Iterator[tuple[dict[str, str], np.ndarray | None]]:
    """Header and data (None without any) of every unit of a file; integers of the BLANK value are NaN."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return raw[at - n : at]

    while (found := _header(take)) is not None:
        header, axes, kind = found
        count = int(np.prod(axes)) if axes else 0
        data = None
        if count:
            stored = np.frombuffer(raw, kind, count, at)
            data = stored.astype(float) * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
            if kind.kind in "iu" and "BLANK" in header:
                data[stored == int(header["BLANK"])] = np.nan
            data = data.reshape(axes[::-1])
        yield header, data
        at += -(-count * kind.itemsize // _BLOCK) * _BLOCK


def celestial_key(header: dict[str, str]) -> str:
    """The first version (blank, A to Z) of the coordinates whose axes are RA and DEC."""
    for key in " ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        kinds = "".join(header.get(f"CTYPE{k}{key.strip()}", "") for k in (1, 2))
        if "RA" in kinds and "DEC" in kinds:
            return key
    raise ValueError("no axes of RA and DEC")


def read(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of the files under path; a file without data or without sky axes raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = next(((h, d) for h, d in units(raw) if d is not None), None)
                if found is None:
                    raise ValueError(f"{name} has no data")
                header, data = found
                key = celestial_key(header)
                yield pa.RecordBatch.from_pylist(
                    [{"path": name, "ny": data.shape[-2], "nx": data.shape[-1], "data": data.ravel(), "wcs_key": key, "meta": list(header.items())}],
                    pa.schema([("path", pa.string()), ("ny", pa.int32()), ("nx", pa.int32()), ("data", pa.list_(pa.float64())), ("wcs_key", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))]),
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def _wcs_of(header: dict[str, str]) -> tuple[dict | None, str | None]:
    """The projection as a struct of WCS_SCHEMA, or why there is none."""
    try:
        p = Projection.of_header(header, celestial_key(header))
    except (ValueError, KeyError) as e:
        return None, str(e)
    pole = None if p.pole == (None, 90.0) else [p.pole[0] if p.pole[0] is not None else p._pole()[2], p.pole[1]]
    return {"kind": p.kind, **{k: list(getattr(p, k)) for k in ("crpix", "crval", "cdelt", "pc", "pv")}, "pole": pole}, None


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return tables.numbered(spark.read.format("binaryFile").load(path).select("path"), "path", "image_id")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """image_id and HEADER_SCHEMA of the files under path, numbered as in images(): all that bounds and grids need.

    Of a file the blocks of headers are read, up to the first unit with data, and none of the data: bytes_read doesn't grow with images. Files that can't be used have a null wcs and a problem.
    The folder has to be one that pyarrow.fs opens (local, HDFS, S3, GCS).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(name)
                row = {"path": name, "problem": "no data", "bytes_read": 0}
                with store.open_input_file(place) as file:

                    def take(n: int, file=file, row=row) -> bytes:
                        block = file.read(n)
                        row["bytes_read"] += len(block)
                        return block

                    while (found := _header(take)) is not None:
                        header, axes, kind = found
                        count = int(np.prod(axes)) if axes else 0
                        if count:
                            wcs, problem = _wcs_of(header)
                            row |= {"ny": axes[1] if len(axes) > 1 else 1, "nx": axes[0], "planes": count // (axes[0] * (axes[1] if len(axes) > 1 else 1)), "wcs": wcs, "problem": problem, "meta": list(header.items())}
                            break
                        file.seek(file.tell() + -(-count * kind.itemsize // _BLOCK) * _BLOCK)
                rows.append(row)
            kinds = pa.schema([("path", pa.string()), ("ny", pa.int32()), ("nx", pa.int32()), ("planes", pa.int32()), ("wcs", _WCS), ("problem", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("bytes_read", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    ids = _numbered(spark, path)
    return ids.select("image_id", "path").join(ids.select("path").mapInArrow(run, HEADER_SCHEMA), "path").select("image_id", *[f.split()[0] for f in ("path", "ny", "nx", "planes", "wcs", "problem", "meta", "bytes_read")])


def images(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """The image table of nightloom.operators.sky (image_id, plane, ny, nx, data, wcs) with path, meta and problem; image_id numbers the files in the order of their paths.

    Only the paths are numbered; the files are read once they are needed. Of data of several planes each is a row of its own, numbered by plane; without split they are one row, which is resampled in
    one go. A file without data or sky axes, or of a projection that isn't supported, gives a row with a null wcs and what its problem is.
    """
    names = ["path", "plane", "ny", "nx", "data", "wcs", "meta", "problem"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), _WCS, pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    header, data = next(((h, d) for h, d in units(raw.as_py()) if d is not None), ({}, None))
                    wcs, problem = _wcs_of(header) if data is not None else (None, "no data")
                except (ValueError, KeyError) as e:  # a broken file
                    header, data, wcs, problem = {}, None, None, str(e)
                if data is None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, 0, None, None, None, None, None, problem), kinds, strict=True)], names=names)
                    continue
                data = data.reshape(-1, *data.shape[-2:]) if data.ndim > 1 else data.reshape(1, 1, -1)
                parts = data if split else data.reshape(1, -1, data.shape[-1])
                for plane, part in enumerate(parts):
                    values = pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), pa.array(part.ravel()))
                    one = {"path": name, "plane": plane, "ny": data.shape[1], "nx": data.shape[2], "wcs": wcs, "meta": list(header.items()), "problem": problem}
                    yield pa.RecordBatch.from_arrays([values if n == "data" else pa.array([one[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

    made = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, plane int, ny int, nx int, data array<double>, wcs {WCS_SCHEMA}, meta map<string,string>, problem string")
    return made.join(_numbered(spark, path), "path").select("image_id", "plane", "ny", "nx", "data", "wcs", "path", "meta", "problem")


# --- writing


def _card(name: str, value: object) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value:>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{name:<8}= {text}"[:80].ljust(80)


#: Cards that say how data are stored: always those of the file that is written.
_STORED = {"SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "EXTEND", "BSCALE", "BZERO", "BLANK", "XTENSION", "PCOUNT", "GCOUNT", "EXTNAME"}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?")


def file_of(data: np.ndarray, meta: dict[str, str], history: list[str]) -> bytes:
    """One image (planes, rows, columns) as the bytes of a FITS file of 64-bit numbers: the cards of meta, and a HISTORY card for each line."""
    axes = data.shape[::-1] if len(data) > 1 else data.shape[:0:-1]
    cards = [_card("SIMPLE", True), _card("BITPIX", -64), _card("NAXIS", len(axes)), *(_card(f"NAXIS{k}", n) for k, n in enumerate(axes, 1))]
    for name, value in meta.items():
        if name not in _STORED and not name.startswith("NAXIS"):
            plain = f"{name:<8}= {value:>20}"[:80].ljust(80)
            cards.append(plain if value in ("T", "F") or _NUMBER.fullmatch(value) else _card(name, value))
    cards += [f"HISTORY {line[at : at + 72]}".ljust(80) for line in history for at in range(0, max(len(line), 1), 72)]
    head = "".join([*cards, "END".ljust(80)]).encode("ascii", "replace")
    body = data.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // _BLOCK) * _BLOCK) + body.ljust(-(-len(body) // _BLOCK) * _BLOCK, b"\0")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FitsWriter(DataSourceArrowWriter):
    """Each task writes its files under temporary names; when all tasks have ended the driver renames them, or removes all."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/_temporary-{self.run}")
        files = []
        for batch in iterator:
            for k, r in enumerate(batch.drop_columns(["data"]).to_pylist()):
                data = batch.column("data").slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, r["ny"], r["nx"])
                temporary = f"{root}/_temporary-{self.run}/{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as out:
                    out.write(file_of(data, dict(r["meta"] or []), list(r["history"] or [])))
                files.append((temporary, f"{root}/{r['name']}"))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        taken = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if not self.overwrite:
            taken += [i.path for i in store.get_file_info(sorted(set(names))) if i.type != fs.FileType.NotFound]
        if taken:
            self.abort(messages)
            raise ValueError(f"files exist or would be written twice: {taken[:5]}")
        for temporary, name in files:
            store.move(temporary, name)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/_temporary-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary-{self.run}")


class FitsSink(DataSource):
    """Format "fits" for writing: name (of the file), ny, nx, data (rows of numbers, plane by plane), meta (cards) and history (lines)."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FitsWriter(self.options["path"], overwrite)


def write(images: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes images (name, ny, nx, data, meta, history) as a file each under a folder's URI. A name in use, or given twice, fails unless told to overwrite, and then nothing is written; nor is it when a task fails for good."""
    spark = images.sparkSession
    spark.dataSource.register(FitsSink)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    made = images.select("name", "ny", "nx", "data", "meta", "history")
    made.write.format("fits").mode("overwrite" if overwrite else "append").save(path)
