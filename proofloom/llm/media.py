"""Operator 10: media columns, read by a Python data source that plans byte ranges over archive folders.

Each payload (a text's UTF-8 bytes, then 1 to 64 zero bytes up to a multiple of 64) becomes an 8-bit greyscale PNG, 64
samples wide. A writing task appends its images to one archive: members back to back, then a directory of (offset,
length, crc32, doc_id, n_bytes) and a footer. The source lists archives by size alone, cuts them into byte ranges, and a
reading task takes the members that begin in its range, in Arrow batches. A member that can't be read or whose crc32 is
wrong is tried again by its own offset; one that stays bad gives a row with `error` set and no media.

Null and empty texts have a payload of 64 zero bytes; very long ones are one member. A null doc_id is read back as null. Repeated rows are members of
their own; an empty table makes an empty folder. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_folder, table
from .files import AtomicFile, opened

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FOOTER = "<QQ8s"
MAGIC = b"MEMBERS1"
NO_DOC = -(2**63)
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("crc", "<u4"), ("doc_id", "<i8"), ("n_bytes", "<u8")])
BATCH_BYTES = 4_000_000


def padded(data: bytes) -> bytes:
    return data + bytes(WIDTH - len(data) % WIDTH) if len(data) % WIDTH or not data else data


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an 8-bit greyscale image whose rows are unfiltered."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, entries = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out = out or AtomicFile(f"{folder}/part-{TaskContext.get().partitionId():05d}.members")
                data = (text.as_py() or "").encode()
                media = to_png(padded(data))
                entries.append((out.size, len(media), zlib.crc32(media), NO_DOC if doc_id is None else doc_id, len(data)))
                out.write(media)
        if out:
            start, directory = out.size, np.array(entries, ENTRY).tobytes()
            out.write(directory + struct.pack(FOOTER, start, len(entries), MAGIC))
            out.commit()
        yield pa.RecordBatch.from_pydict({"members": [len(entries)]})

    return run


def write_archives(docs: DataFrame, folder: str) -> int:
    """Stores every text of docs in archives under folder, one for each task that has rows; returns how many it stored."""
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_writer(folder), "members long").agg(F.sum("members")).collect()
    return rows[0][0] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split, self.tries = options["path"], int(options.get("splitBytes", 16_000_000)), int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        import pyarrow.fs as pafs

        fs, path = opened(self.folder)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".members"))
        return [ByteRange(p, size, a, min(a + self.split, size)) for p, size in found for a in range(0, size, self.split)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs = opened(self.folder)[0]
        file = fs.open_input_file(partition.path)
        start, n, magic = struct.unpack(FOOTER, file.read_at(struct.calcsize(FOOTER), partition.size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"no member directory in {partition.path}")
        entries = np.frombuffer(file.read_at(n * ENTRY.itemsize, start), ENTRY)
        entries = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
        rows: list[tuple] = []
        held = 0
        for e in entries:
            offset, length, media, error = int(e["offset"]), int(e["length"]), None, None
            for attempt in range(self.tries):
                try:
                    if attempt:
                        file = fs.open_input_file(partition.path)
                    media = file.read_at(length, offset)
                    if zlib.crc32(media) != e["crc"]:
                        raise OSError("wrong crc32")
                    error = None
                    break
                except OSError as why:
                    media, error = None, f"{partition.path}@{offset}: {why}"
            rows.append((None if e["doc_id"] == NO_DOC else int(e["doc_id"]), int(e["n_bytes"]), media, error))
            held += length
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("member_archive").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("member_archive").load(folder)


def feature(payload: bytes) -> str:
    """Height, mean, deviation, entropy in bits and mean step between neighbouring samples, each of the whole image."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    values = np.arange(256)
    mean = float(p @ values)
    spread = float(p @ (values - mean) ** 2) ** 0.5
    p = p[p > 0]
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"{len(x) // WIDTH};{mean:.3f};{spread:.3f};{float(-(p * np.log2(p)).sum()):.3f};{step:.3f}"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")}
        for doc_id, n, media, error in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media", "error")), strict=True):
            media, payload = media.as_py(), None
            if media is not None:
                payload = from_png(media)
            row = (doc_id.as_py(), n.as_py(), *((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)) if media else (None,) * 6), error.as_py())
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def measured(media: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.mapInArrow(_measure, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), folder)
    return measured(read_archives(spark, folder))
