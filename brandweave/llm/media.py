"""Media columns: payloads stored as images in archives, and a data source that reads them back.

A payload is stored losslessly as an 8-bit greyscale PNG, 576 samples wide. Tasks write members into
ZIP archives in the shared folder, without compressing them again, and return a manifest of the
archives they finished; an attempt that is lost leaves a file that no manifest names.

The data source ``media_archives`` plans byte ranges over the archives of a manifest. A task reads
the directory of its archive, takes the members whose offset lies in its range, and streams them in
Arrow batches of bounded size. Members are read by their offsets on one open handle; each is retried
by itself, on a new handle, when reading fails or its checksum does not match. Paths go through Arrow's file systems, so
any shared store they know will do; only names and sizes pass through the driver.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brandweave.llm.common import fresh_path, slices, small_batches, table, utf8

WIDTH = 576
FILL = 255
ARCHIVE_BYTES = 128 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
MAGIC = b"\x89PNG\r\n\x1a\n"
MANIFEST = "archive string, bytes long, members long"
MEMBERS = "archive string, offset long, name string, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, archive string, offset long"
)


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of 576."""
    return text + bytes([FILL]) * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A greyscale PNG of 8-bit samples; the payload's length is a positive multiple of 576."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError("the payload is not a positive number of whole rows")
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of such a PNG, row by row; every checksum is verified."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum does not match")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a greyscale image of 576 samples a row")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:].tobytes()


def write_archives(documents: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every text's payload into archives under ``folder``; gives the manifest, not yet run.

    A null text is empty, and so is a payload of 576 fill bytes. Rows with the same or a null doc_id
    are members of their own. The result must be written once and read from there: each evaluation
    writes new archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        target = archive = name = None
        members, done = 0, []

        def close() -> None:
            archive.close()
            done.append((name, target.tell(), members))
            target.close()

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if archive is None:
                    name = f"{folder}/{uuid.uuid4().hex}.zip"
                    target = store.open_output_stream(f"{path}/{name.rpartition('/')[2]}")
                    archive, members = zipfile.ZipFile(target, "w", zipfile.ZIP_STORED), 0
                archive.writestr(zipfile.ZipInfo(f"{members}-{'null' if doc_id is None else doc_id}.png"), encode_png(padded(text)))
                members += 1
                if target.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["archive", "bytes", "members"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, MANIFEST)


@dataclass
class ByteRange(InputPartition):
    """Members of one archive whose local headers start from ``start`` to before ``end``."""

    archive: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


#: What reading a damaged or cut archive may raise, besides what stores raise.
UNREADABLE = (OSError, EOFError, zipfile.BadZipFile, struct.error)


def _member(file: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
    """The stored bytes at a member's offset, checked against the directory, in one read: the members
    are written here, so their local headers have the names of the directory and nothing more."""
    size = 30 + len(info.filename.encode())
    file.seek(info.header_offset)
    own = file.read(size + info.compress_size)
    if own[:4] != b"PK\x03\x04" or size != 30 + sum(struct.unpack("<HH", own[26:30])):
        raise OSError("no member of this name starts at this offset")
    data = own[size:]
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise OSError("a member's checksum does not match")
    return data


class ArchiveReader(DataSourceReader):
    """Plans the ranges and reads them."""

    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.attempts = int(options.get("attempts", 4))
        self.pause = float(options.get("pause", 0.5))

    def partitions(self) -> list[ByteRange]:
        store, path = pafs.FileSystem.from_uri(self.manifest)
        rows = pq.read_table(path, filesystem=store).to_pylist()
        return [ByteRange(r["archive"], a, min(r["bytes"], a + self.split_bytes)) for r in rows for a in range(0, r["bytes"], self.split_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition where none is planned
            return
        store, path = pafs.FileSystem.from_uri(partition.archive)
        for attempt in range(self.attempts):
            try:
                with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    infos = sorted((i for i in archive.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
                break
            except UNREADABLE:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)
        held, size, file = [], 0, None
        for info in infos:
            for attempt in range(self.attempts):
                try:
                    file = file or store.open_input_file(path)
                    data = _member(file, info)
                    break
                except UNREADABLE:
                    if attempt + 1 == self.attempts:
                        raise
                    file = _closed(file)
                    time.sleep(self.pause * 2**attempt)
            held.append((partition.archive, info.header_offset, info.filename, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _members(held)
                held, size = [], 0
        if held:
            yield _members(held)
        _closed(file)


def _closed(file: pa.NativeFile | None) -> None:
    """Closes a handle that may be broken."""
    if file is not None:
        with contextlib.suppress(OSError):
            file.close()


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(manifest)``: one row for each member.

    The path is a folder of Parquet files with the columns of MANIFEST. Options: splitBytes,
    attempts (of each member), pause (seconds before the second attempt, then doubling).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()})


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    """The members of the archives that a stored manifest names."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(manifest)


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean brightness, mean step between neighbours and the share of ink, of 8-bit samples."""
    values = samples.astype(np.int64)
    steps = int(np.abs(np.diff(values)).sum())
    ink = int((values < 128).sum())
    return f"rows={len(values) // WIDTH};mean={values.sum() / len(values):.4f};step={steps / max(1, len(values) - 1):.4f};ink={ink / len(values):.4f}"


def features(members: DataFrame) -> DataFrame:
    """Decodes members and describes payload, stored form and samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, offset, name, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = decode_png(media)
                found = re.fullmatch(r"\d+-(null|-?\d+)\.png", name)[1]
                rows.append(
                    (
                        None if found == "null" else int(found),
                        len(payload.rstrip(bytes([FILL]))),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature_of(np.frombuffer(payload, dtype=np.uint8)),
                        archive.rpartition("/")[2],
                        offset,
                    )
                )
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 3 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.mapInArrow(run, FEATURES)


def media_features(documents: DataFrame, **options) -> DataFrame:
    """Stores the documents' payloads as images, reads them back and describes them.

    UTF-8 never holds byte 255, so a text's length is the payload's without the trailing fill.
    """
    spark = documents.sparkSession
    folder = fresh_path(spark, "media")
    write_archives(documents, f"{folder}/archives").write.parquet(f"{folder}/manifest")
    return features(read_archives(spark, f"{folder}/manifest", **options))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored form and features."""
    return media_features(table(spark, sf_dir, "documents")).drop("archive", "offset")
