"""Media columns: a Spark data source over folders of zip archives.

Writing: each task writes archives of deflated members, of ``archiveBytes`` each, and reports
their names; the commit lists the archives of successful tasks, so files of lost attempts are
never read. Folders are those that pyarrow opens: local ones, ``hdfs://``, ``s3://`` and others. Reading:
the driver plans byte ranges from the archives' sizes alone. A task reads the archive's own
directory, takes the members whose header lies in its range, and streams them in Arrow
batches of bounded size. A member that fails its checksum is read again by its offset, from
a newly opened file; if it still fails, its row carries the error and the others go on.

Texts are stored as 8-bit mono WAV: bytes padded with 0 to a positive multiple of 64, the
unpadded count in the ``fact`` chunk. Null and empty texts give 64 samples of 0. A text is one
member, however long. Repeated rows give repeated members; null keys come back as null. An
empty table gives an empty list of archives and no rows. Only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.llm.common import shared_folder, table

UNIT, RATE = 64, 8000
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 16 << 20, 4 << 20, 3
#: An archive ends with the member that brings it to so many bytes.
ARCHIVE_BYTES = 128 << 20
INDEX = "_archives.json"


def _open_folder(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Wrote(WriterCommitMessage):
    archives: tuple[tuple[str, int, int], ...]  # name, members and size of each


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; rows of ``name, media`` can be written."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes archives of about ``limit`` bytes each, so that a directory has bounded size."""

    def __init__(self, folder: str, limit: int = ARCHIVE_BYTES):
        self.folder, self.limit = folder, limit

    def write(self, iterator) -> Wrote:
        fs, folder = _open_folder(self.folder)
        made: list[tuple[str, int, int]] = []
        out = stream = None
        name, members, size = "", 0, 0

        def close() -> None:
            out.close()
            stream.close()
            made.append((name, members, fs.get_file_info(f"{folder}/{name}").size))

        for batch in iterator:
            for key, media in zip(batch.column("name").to_pylist(), batch.column("media"), strict=True):
                if out is None:
                    name, members, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(key)
                info.compress_type = zipfile.ZIP_DEFLATED
                out.writestr(info, media.as_py(), compresslevel=1)
                members, size = members + 1, size + info.compress_size
                if size >= self.limit:
                    close()
                    out = None
        if out is not None:
            close()
        return Wrote(tuple(made))

    def commit(self, messages) -> None:
        fs, folder = _open_folder(self.folder)
        fs.create_dir(folder, recursive=True)
        listed = [{"archive": a, "members": m, "size": n} for w in messages if w for a, m, n in w.archives]
        with fs.open_output_stream(f"{folder}/{INDEX}") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        """Removes the archives of the tasks that had ended; a failed task's own is never listed."""
        fs, folder = _open_folder(self.folder)
        for w in messages:
            for a, _, _ in w.archives if w else ():
                fs.delete_file(f"{folder}/{a}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        fs, folder = _open_folder(self.folder)
        with fs.open_input_file(f"{folder}/{INDEX}") as f:
            listed = json.loads(f.read())
        cuts = [(x["archive"], a, min(a + self.range_bytes, x["size"])) for x in listed for a in range(0, x["size"], self.range_bytes)]
        return [Range(*c) for c in cuts] or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.archive:
            return
        fs, folder = _open_folder(self.folder)
        path = f"{folder}/{partition.archive}"
        source = fs.open_input_file(path)
        with zipfile.ZipFile(source) as directory:
            members = sorted((m for m in directory.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
        rows, size = [], 0
        source = fs.open_input_file(path)
        for m in members:
            media = error = None
            for _ in range(self.attempts):
                try:
                    media, error = read_member(source, m), None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    source = fs.open_input_file(path)
            rows.append((partition.archive, m.header_offset, m.filename, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def read_member(source, m: zipfile.ZipInfo) -> bytes:
    """The member's bytes, found by its header's offset and held against its checksum."""
    source.seek(m.header_offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    skip = sum(struct.unpack("<HH", head[26:30]))
    raw = source.read(skip + m.compress_size)[skip:]
    data = zlib.decompress(raw, -15) if m.compress_type == zipfile.ZIP_DEFLATED else bytes(raw)
    if zlib.crc32(data) != m.CRC:
        raise ValueError("checksum differs")
    return data


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "media", "error"])


def to_wav(text: str | None) -> bytes:
    raw = (text or "").encode()
    data = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"fact" + struct.pack("<II", 4, len(raw)) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data)) + head + data


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Unpadded count and samples."""
    at, count, data = 12, 0, b""
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fact":
            count = struct.unpack("<I", media[at + 8 : at + 12])[0]
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return count, data


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, zero crossings and entropy of the samples."""
    share = np.bincount(samples, minlength=256) / len(samples)
    levels = np.arange(256)
    mean = float(share @ levels)
    dev = float(np.sqrt(max(0.0, share @ (levels - mean) ** 2)))
    above = samples >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    some = share[share > 0]
    return f"mean={mean:.4f};dev={dev:.4f};crossings={crossings};entropy={float(-(some * np.log2(some)).sum()):.4f}"


def store(docs: DataFrame, folder: str, **options) -> None:
    """Writes every text of ``doc_id, text`` as a WAV member of archives in ``folder``."""

    def members(batches):
        for b in batches:
            # "-" stands for a null key
            names = pa.array(["-" if k is None else str(k) for k in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array([to_wav(t) for t in b.column(1).to_pylist()], pa.binary())], ["name", "media"])

    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    docs.select("doc_id", "text").mapInArrow(members, "name string, media binary").write.format("media_archives").options(**options).mode("append").save(folder)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def described(rows: DataFrame) -> DataFrame:
    """Digests and the feature of each member; null where a member could not be read."""

    def run(frames):
        for f in frames:
            out = []
            for name, media in zip(f["name"], f["media"], strict=True):
                key = None if name == "-" else int(name)
                if media is None:
                    out.append((key, *[None] * 7))
                    continue
                n, data = from_wav(media)
                out.append((key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(data, np.uint8))))
            yield pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in COLUMNS if c.endswith(("id", "bytes", "crc32"))})

    return rows.select("name", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    store(table(spark, sf_dir, "documents"), folder)
    return described(load(spark, folder))


QUERIES = {"op5_media": op5_media}
ORACLES: dict[str, str] = {}
